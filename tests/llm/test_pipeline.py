"""The pipeline against brute force, stage by stage, and on odd and empty tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from millrace.llm.common import stored
from millrace.llm.queries import FLATTEN
from tests.llm.conftest import ODD
from tests.llm.test_queries import SMALL, brute_components, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before the first stage and after each."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL))
        rows.append(docs.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == COLUMNS
    return rows


def test_quality_keeps_rows_as_they_are_and_holds_the_rules(stages):
    before = {r.doc_id: r for r in stages[0]}
    assert 0.6 * len(before) < len(stages[1]) < len(before)
    for r in stages[1]:
        assert r == before[r.doc_id] and len(words(r.text)) >= 50


def test_near_copies_keep_the_smallest_of_each_component(stages):
    expected = sorted(d for d, (_, c, _) in brute_components(stages[1]).items() if c == d)
    assert sorted(r.doc_id for r in stages[2]) == expected
    assert set(stages[2]) <= set(stages[1])


def test_repeats_are_cut(stages):
    span, first = 50, {}
    expected = {}
    for r in sorted(stages[2], key=lambda r: r.doc_id):
        own = words(r.text)
        cut = set()
        for i in range(len(own) - span + 1):
            doc, at = first.setdefault(tuple(own[i : i + span]), (r.doc_id, i))
            if doc != r.doc_id or i - at >= span:
                cut |= set(range(i, i + span))
        left = [w for i, w in enumerate(own) if i not in cut]
        if left:
            expected[r.doc_id] = left
    assert {r.doc_id: words(r.text) for r in stages[3]} == expected
    assert all(r.n_chars == len(r.text) for r in stages[3])
    text = {r.doc_id: r.text for r in stages[2]}
    assert all(r.text == text[r.doc_id] for r in stages[3] if words(text[r.doc_id]) == expected[r.doc_id])
    assert any(r.text != text[r.doc_id] for r in stages[3])


def test_mixing_draws_what_the_hash_says(stages):
    size = Counter()
    for r in stages[3]:
        size[r.source] += max(1, len(r.text.encode()))
    weight = {s: n**FLATTEN for s, n in size.items()}
    expected = Counter()
    for r in stages[3]:
        rate = weight[r.source] / sum(weight.values()) * sum(size.values()) / size[r.source]
        parts = max(1, math.ceil(rate / 8))
        for i in range(1, parts + 1):
            u = int(hashlib.md5(f"mix:{r.doc_id}:{i}".encode()).hexdigest()[:13], 16) / 2**52
            p = cdf = math.exp(-rate / parts)
            k = 0
            while cdf <= u:
                k += 1
                p *= rate / parts / k
                cdf += p
            expected[r] += k
    assert Counter(stages[4]) == +expected
    assert [r.doc_id for r in stages[4]] != sorted(r.doc_id for r in stages[4])


def test_packing_holds_every_copy(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in stages[4]:
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
        first = n % 1024 or 1024
        expected.update([(r.doc_id, 0, 0, first)] + [(r.doc_id, 1 + k, a, 1024) for k, a in enumerate(range(first, n, 1024))])
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in stages[5]) == expected
    held = Counter()
    for r in stages[5]:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 1024


def test_run_gives_what_the_stages_give(spark, stages):
    got = queries()["pipeline"](spark, SMALL).collect()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r[k] for k in key) for r in got) == Counter(tuple(r[k] for k in key) for r in stages[5])
    assert "pipeline" not in oracle_sql()


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_stages_on_odd_rows(spark, documents, tmp_path, rows):
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        found = out.collect()
        assert bool(found) <= bool(rows), name
        if name != "packing":
            assert out.columns == docs.columns
