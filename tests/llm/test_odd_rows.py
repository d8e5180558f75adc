"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm.bin_sharding import sharded
from millrace.llm.circulant_minhash import minhash_components
from millrace.llm.fill_in_middle import fill_in_middle, restored
from millrace.llm.language_gru import languages
from millrace.llm.mask_search import ranked_search
from millrace.llm.prefix_tree_join import jaccard_components, one_of_each
from millrace.llm.quality_ratio import quality_rules
from millrace.llm.sequence_packing import packed
from millrace.llm.source_mixing import mixed, shuffled, source_sizes, tempered_weights, with_position
from millrace.llm.suffix_dedup import repeated_spans, without_repeats
from millrace.llm.toxicity_fm import toxicity
from tests.llm.conftest import ODD


def labels(spark, rows=((1, 1, 0), (4, 1, 1), (None, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items(spark, rows=((1, "Word and größe"), (1, "SIX"), (2, None), (None, "word"), (3, "none of these"), (4, "x"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def mix(docs):
    return mixed(docs, tempered_weights(source_sizes(docs), 0.7))


#: Each gives rows for each row of its input, or says how many it gives for ODD.
PER_ROW = {
    "components": lambda s, d: jaccard_components(d),
    "quality": lambda s, d: quality_rules(d, labels(s).filter("quality = 1")),
    "shards": lambda s, d: sharded(d),
    "toxicity": lambda s, d: toxicity(d, labels(s)),
    "languages": lambda s, d: languages(d),
    "fill in middle": lambda s, d: fill_in_middle(d),
    "minhash": lambda s, d: minhash_components(d),
}
OTHERS = {
    "one of each": lambda s, d: one_of_each(d),
    "spans": lambda s, d: repeated_spans(d),
    "without repeats": lambda s, d: without_repeats(d),
    "mixed": lambda s, d: with_position(mix(d)),
    "shuffled": lambda s, d: shuffled(mix(d)),
    "packed": lambda s, d: packed(d),
    "ranked": lambda s, d: ranked_search(d, items(s)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_odd_row(spark, documents, name):
    assert PER_ROW[name](spark, documents(ODD)).count() == len(ODD)


@pytest.mark.parametrize("name", [*PER_ROW, *OTHERS])
def test_an_empty_table_gives_an_empty_table(spark, documents, name):
    assert (PER_ROW | OTHERS)[name](spark, documents([])).collect() == []


def test_components_of_odd_rows(spark, documents):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_components(documents(ODD)).collect()}
    assert {(None, 1, None, 0), (1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0)} <= rows
    assert {(4, 1, 4, 2), (5, 1, 4, 2), (6, 6, 6, 0), (7, 1, 7, 0)} <= rows


def test_one_of_each_keeps_rows_without_words_or_id(spark, documents):
    kept = sorted(one_of_each(documents(ODD)).collect(), key=lambda r: r.doc_id or 0)
    assert [r.doc_id for r in kept] == [None, 1, 2, 3, 4, 6, 7, 8]
    assert kept[0].score == 7


def test_copies_of_one_row_are_cut_to_one(spark, documents):
    assert one_of_each(documents([(1, "a b c"), (1, "a b c"), (2, "x y z")])).count() == 2


def test_repeats_of_odd_rows(spark, documents):
    # The repeated words of text 6 overlap or lie 50 words apart; the latter count.
    spans = repeated_spans(documents(ODD)).collect()
    assert {r.doc_id for r in spans} == {6}
    assert without_repeats(documents(ODD)).count() == len(ODD)


def test_shards_of_odd_rows(spark, documents):
    rows = sharded(documents(ODD), shards=3).collect()
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {8}
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_quality_of_odd_rows(spark, documents):
    rows = quality_rules(documents(ODD), labels(spark).filter("quality = 1")).select(
        F.col("doc.doc_id").alias("i"), "n_words", "n_repeat_words", "base_failed", "kept"
    )
    found = {(r.i, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in rows.collect()}
    assert {(1, 0, 0, True, False), (6, 120_000, 120_000, True, False), (7, 1, 0, True, False)} <= found


def test_packing_of_odd_rows(spark, documents):
    rows = packed(documents(ODD)).collect()
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert {r.doc_id for r in rows} == {i for i, _ in ODD}


def test_mixing_a_null_source_and_no_weights(spark, documents):
    docs = documents([(i, "some text") for i in range(200)]).withColumn("source", F.lit(None).cast("string"))
    n = mix(docs).count()
    assert 140 < n < 260
    assert mixed(docs, tempered_weights(source_sizes(docs), 0.7).filter("false")).count() == 0


def test_languages_of_odd_rows(spark, documents):
    found = {(r.doc_id, r.lang_pred, r.score) for r in languages(documents(ODD)).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= found
    assert {(4, "en", 1.0)} <= {(i, lang, round(s, 3)) for i, lang, s in found}


def test_nothing_to_learn_from(spark, documents):
    docs = documents(ODD).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in languages(docs).collect()} == {"und"}
    none = toxicity(docs, labels(spark, [(None, None, None)])).collect()
    assert {r.predicted for r in none} == {0} and max(r.score for r in none) < 1e-6


def test_rows_that_repeat_an_id_with_other_texts(spark, documents):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    kept = one_of_each(documents([(1, a), (2, a), (2, b)])).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (2, b)]
    # Of one id's near copies one stays; unlike texts of one id are components of their own.
    kept = one_of_each(documents([(2, a), (2, a + " more"), (2, b), (3, b), (2, b)])).collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} == {2} and {r.text[0] for r in kept} == {"a", "b"}


@pytest.mark.parametrize("bits", [64, 1 << 28])
def test_keys_beyond_a_broadcast_give_the_same_rows(spark, documents, monkeypatch, bits):
    from millrace.llm import common

    docs = documents([(i % 300 if i % 7 else None, f"text {i}") for i in range(500)])
    keys = common.stored(spark.createDataFrame([(i,) for i in range(0, 300, 3)] + [(None,)], "doc_id long"))

    def all_rows():
        semi, anti = (common.by_keys(docs, keys, "doc_id", how) for how in ("left_semi", "left_anti"))
        here = common.marked(docs, keys, "doc_id", "here")
        assert semi.columns and set(semi.columns) == set(docs.columns)
        return [sorted(tuple(r) for r in x.select("text", *extra).collect()) for x, *extra in ((semi,), (anti,), (here, "here"))]

    few = all_rows()
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    assert all_rows() == few
    assert len(few[0]) + len(few[1]) == len(few[2]) == 500


def test_fill_in_middle_of_odd_rows(spark, documents):
    marked = [(20, "a <P> b\nc"), (21, "<S>"), (22, "a\nb<M>"), (23, "<Q>\n<p>\n"), (24, "\n" * 5000), (25, "é\n" * 50_000 + "end")]
    found = fill_in_middle(documents(ODD + marked))
    back = found.select("doc_id", "n", "form", "prefix_chars", "output", restored(F.col("output"), F.col("form")).alias("text"))
    rows = [(r.doc_id, r.text) for r in back.collect()]
    assert sorted(rows, key=str) == sorted(((i, t or "") for i, t in ODD + marked), key=str)
    form = {r.doc_id: (r.n, r.form, r.prefix_chars) for r in back.collect()}
    assert form[1] == form[2] == (0, "plain", None)
    assert form[20] == (2, "plain", None) and form[21] == (1, "plain", None) and form[22][1] == "plain"
    assert form[23][:2] in ((2, "spm"), (2, "psm")) and form[24][0] == 5000 and form[25][0] == 50_001


def test_minhash_of_odd_rows(spark, documents):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_components(documents(ODD)).collect()}
    assert {(None, 4, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)} <= rows
    assert {(4, 1, 4, True), (5, 1, 4, False), (6, 6, 6, True), (7, 1, 7, True)} <= rows


def brute_ranks(docs, asked, k=10):
    """item, rank, id, score from plain counts over all documents."""

    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counts = [(i, Counter(terms(t))) for i, t in docs]
    own = defaultdict(set)
    for i, t in asked:
        if i is not None:
            own[i] |= set(terms(t))
    n = sum(bool(c) for _, c in counts)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, wanted in own.items():
        scores = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n) // total
            weigh = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in wanted & set(c)}
            score = sum(w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, w in weigh.items())
            if i is not None and score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_ranks_of_odd_rows(spark, documents):
    found = ranked_search(documents(ODD), items(spark))
    expected = brute_ranks(ODD, [tuple(r) for r in items(spark).collect()])
    assert {item for item, *_ in expected} == {1} and len(expected) == 5
    assert sorted(map(tuple, found.collect())) == expected
    assert ranked_search(documents(ODD), items(spark).filter("false")).collect() == []
