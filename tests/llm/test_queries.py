"""The registered queries against their SQL, or against brute force, on whole tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from millrace.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.conftest import TESTDATA

SMALL = f"{TESTDATA}/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


def test_all_are_registered():
    assert QUERIES.keys() | {"pipeline"} <= queries().keys()
    assert ORACLE_SQL.keys() <= oracle_sql().keys()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, len(QUERIES) + 1))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, rows_of_sql, name):
    frame = QUERIES[name](spark, SMALL)
    columns, expected = rows_of_sql("0.01", ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(columns)
    assert expected
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(expected)


def brute_components(docs):
    classes = defaultdict(list)
    for d in docs:
        classes[tuple(words(d.text, lower=True))].append(d.doc_id)
    keys = list(classes)
    sets = [{k[i : i + 5] for i in range(len(k) - 4)} or ({k} if k else set()) for k in keys]
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    parent, links = list(range(len(keys))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in held[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
                links[i] += len(classes[keys[j]])
                links[j] += len(classes[keys[i]])
    least = defaultdict(list)
    for i, k in enumerate(keys):
        least[root(i)] += classes[k]
    return {
        d: (len(sets[i]), min(least[root(i)]) if k else d, links[i] + len(classes[k]) - 1 if k else 0)
        for i, k in enumerate(keys)
        for d in classes[k]
    }


def test_op3_equals_brute_force(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in QUERIES["op3_ngram_join"](spark, SMALL).collect()}
    assert got == brute_components(docs)
    assert sum(c != d for d, (_, c, _) in got.items()) > 50


def test_op1_finds_nine_of_ten(spark):
    table = spark.read.parquet(f"{TESTDATA}/sf0.1/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in table])
    vectors = np.array([r.embedding for r in table], float)
    got = defaultdict(list)
    for r in QUERIES["op1_collision_search"](spark, f"{TESTDATA}/sf0.1").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        own = vectors[ids == q][0]
        scores = vectors @ own
        scores[ids == q] = -np.inf
        hits += len({v for _, v, _ in found} & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
        found.sort()
        assert [rank for rank, _, _ in found] == list(range(1, 21))
        assert sorted(found, key=lambda x: (-x[2], x[1])) == found
        for _, v, score in found:
            assert score == pytest.approx(float(scores[ids == v][0]), abs=1e-12)
    assert hits >= 0.9 * 20 * len(got)


def test_op4_shards_are_near_equal_and_hold_groups_whole(spark, docs):
    rows = QUERIES["op4_sharding"](spark, SMALL).collect()
    text = {d.doc_id: d.text for d in docs}
    total, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        body = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(body) + 8, zlib.crc32(body))
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    assert len(rows) == len(docs) and set(total) == set(range(24))
    assert max(total.values()) < 1.02 * min(total.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, where.values())) == 1


def test_op5_base_counts_and_verdict(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, SMALL).collect()}
    for d in docs:
        w = words(d.text)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(windows)
        repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
        lines = [x for x in d.text.split("\n") if words(x)]
        r = got[d.doc_id]
        expected = (
            len(w),
            sum(map(len, w)),
            sum(c in "#*$%&|<>" for c in d.text),
            len(lines) - len(set(lines)),
            len(repeated),
            len(w) < 50 or 100 * len(repeated) > 50 * len(w),
        )
        assert tuple(r[1:7]) == expected
        assert not (r.kept and r.base_failed)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    judged = [(x.quality, got[x.doc_id].kept) for x in labels if not got[x.doc_id].base_failed]
    assert sum(k for q, k in judged if q == 1) >= 0.97 * sum(q == 1 for q, _ in judged)
    assert sum(k for q, k in judged if q == 0) <= 0.2 * sum(q == 0 for q, _ in judged)


def test_op7_catches_toxic_held_out_rows(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, f"{TESTDATA}/sf0.1").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    labels = spark.read.parquet(f"{TESTDATA}/sf0.1/labels.parquet").collect()
    held = [(x.toxic, rows[x.doc_id].predicted) for x in labels if rows[x.doc_id].held_out]
    assert sum(p for t, p in held if t == 0) <= 0.002 * sum(t == 0 for t, _ in held)
    assert sum(p for t, p in held if t == 1) >= 0.8 * sum(t == 1 for t, _ in held)


def test_op8_places_every_token_once(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d.doc_id: [*tokenizer.encode(d.text, add_special_tokens=False).ids, 2] for d in docs}
    rows = QUERIES["op8_packing"](spark, SMALL).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids[i])
        assert all(r.length == 1024 for r in own[1:])
    for places in sequences.values():
        places.sort()
        assert [a for a, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 1024
    assert set(pieces) == set(ids)
    assert len(sequences) <= 1.03 * sum(map(len, ids.values())) / 1024


def test_op9_knows_held_out_languages(spark, docs):
    rows = {r.doc_id: r for r in QUERIES["op9_language"](spark, SMALL).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert sum(rows[d.doc_id].lang_pred == d.lang for d in held) >= 0.97 * len(held)


def test_op10_is_the_article(spark):
    pages = {p.page_id: p for p in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in QUERIES["op10_main_text"](spark, SMALL).collect():
        import html

        body = re.search("<article>(.*)</article>", pages[r.page_id].html, re.DOTALL)[1]
        body = re.sub("<(?:/?p|/?h1|br)>", " ", body)
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", "", body)).split())
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def test_op2_shares_come_near_their_targets(spark):
    from millrace.llm.queries import FLATTEN

    directory = f"{TESTDATA}/sf0.1"
    copies = QUERIES["op2_source_mixing"](spark, directory)
    size = F.octet_length("text").alias("size")
    docs = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", size)
    got = {r.source: r.n for r in copies.join(docs, "doc_id").groupBy("source").agg(F.sum("size").alias("n")).collect()}
    before = {
        r.source: r.n
        for r in spark.read.parquet(f"{directory}/documents.parquet").groupBy("source").agg(F.sum(size).alias("n")).collect()
    }
    weight = {s: n**FLATTEN for s, n in before.items()}
    for s, n in got.items():
        target = weight[s] / sum(weight.values()) * sum(before.values())
        assert abs(n - target) < 0.25 * target
    places = [r.position for r in copies.select("position").collect()]
    assert sorted(places) == list(range(len(places)))
