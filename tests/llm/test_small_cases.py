"""Operators on small made-up input, against brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import collision_search
from millrace.llm import sequence_packing as sp
from millrace.llm import toxicity_fm as fm
from millrace.llm.bin_sharding import best_fit_decreasing, least_capacity, near_equal, sharded
from millrace.llm.collision_search import nearest
from millrace.llm.graph import components
from millrace.llm.html_tree import labelled_pages, main_text, parse, texts, trained
from millrace.llm.language_gru import Network
from millrace.llm.prefix_tree_join import jaccard_components, tree_join
from millrace.llm.source_mixing import MOST_MEAN, mixed, source_sizes
from millrace.llm.suffix_dedup import repeated_spans, without_repeats
from tests.llm.test_queries import brute_components


def prose(rng, n):
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


@pytest.mark.parametrize("percent", [60, 75, 90])
def test_tree_join_equals_all_pairs(percent):
    rng = random.Random(percent)
    base = [rng.sample(range(300), 40) for _ in range(3)]
    sets = []
    for _ in range(120):
        s = set(rng.choice(base))
        s -= set(rng.sample(sorted(s), rng.randrange(8)))
        s |= set(rng.sample(range(300), rng.randrange(8)))
        sets.append(np.array(sorted(s)))
    sizes = np.array([len(s) + rng.randrange(4) for s in sets])  # n-grams that no other has
    got = {i: set(found.tolist()) for i, found in tree_join(sets[:50], sizes[:50], sets[50:], sizes[50:], percent)}
    for i in range(50):
        expected = set()
        for j in range(50, 120):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                expected.add(j - 50)
        assert got.get(i, set()) == expected


def test_one_of_each_of_a_large_group_compares_what_pivots_leave(spark, documents, monkeypatch):
    from millrace.llm import prefix_tree_join as join

    rng = random.Random(6)
    base, rows = prose(rng, 80), []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(80)] = f"edit{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    docs = documents(rows)
    expected = sorted(d for d, (_, c, _) in brute_components(docs.select("doc_id", "text").collect()).items() if c == d)
    assert len(expected) > 3
    for pivots, block in ((1, 300_000), (2, 1500)):
        monkeypatch.setattr(join, "PIVOTS", pivots)
        assert sorted(r.doc_id for r in join.one_of_each(docs, block=block).collect()) == expected


def test_components_of_a_large_group_do_not_depend_on_blocks(spark, documents):
    """Near copies with random edits: some pairs link, some do not."""
    rng = random.Random(5)
    base, rows = prose(rng, 80), []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(80)] = f"edit{rng.randrange(40)}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, rows[i % 3][1].upper()) for i in range(30)]
    rows += [(300 + i, " ".join(prose(rng, 60) + base[:25])) for i in range(40)]
    docs = documents(rows)
    expected = brute_components(docs.select("doc_id", "text").collect())
    for block in (300_000, 2_000):
        got = jaccard_components(docs, block=block).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == expected


def test_graph_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    edges += [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2300)] + [(7, 7)]
    least = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: r for v, r in least.items() if v in linked}


def test_repeats_within_and_across_texts(spark, documents):
    rng = random.Random(9)
    passage, other = prose(rng, 60), prose(rng, 49)
    rows = [
        (1, " ".join(prose(rng, 30) + passage + prose(rng, 30))),
        (2, " ".join(passage[:55] + prose(rng, 10) + passage[5:])),
        (3, " ".join(other + prose(rng, 5))),
        (4, " ".join(other)),
        (5, " ".join(passage)),
    ]
    spans = {(r.doc_id, r.start_word, r.n_words, r.removed) for r in repeated_spans(documents(rows)).collect()}
    assert spans == {(1, 30, 60, False), (2, 0, 55, True), (2, 65, 55, True), (5, 0, 60, True)}
    left = {r.doc_id: r for r in without_repeats(documents(rows)).collect()}
    assert set(left) == {1, 2, 3, 4}
    assert left[2].text.split() == rows[1][1].split()[55:65]
    assert left[2].n_chars == len(left[2].text) and left[2].score == 7
    assert left[1].text == rows[0][1] and left[3].n_chars == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, score string")


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0]]
    rows = [(i, v, 1, "x") for i, v in enumerate(odd)] + [
        (20, [1.0, 0.0], 1, "x"), (21, [0.5, 0.5], 1, "x"), (22, [0.5, -3.0], 1, "x"), (23, [9.0] * 3, 1, "x"),
        (24, [0.5, 0.1], 1, "x"), (40, [1.0] * 3, 1, "x"), (None, [1.0, 1.0], 1, "x"),
    ]
    found = nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert {tuple(r) for r in found} == {
        (20, 1, 21, 0.5), (20, 2, 22, 0.5), (20, 3, 24, 0.5), (40, 1, 23, 27.0)
    }
    assert nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert nearest(vectors(spark, rows), F.lit(False)).collect() == []


def test_equal_vectors_are_ranked_by_id(spark):
    rng = np.random.default_rng(1)
    same = rng.standard_normal(16).tolist()
    rows = [(i, same if i % 2 else rng.standard_normal(16).tolist(), 1, "x") for i in range(300)]
    rows[0] = (0, same, 1, "x")
    found = nearest(vectors(spark, rows), F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 41, 2))
    assert len({r.score for r in found}) == 1


def test_repeated_rows_lose_no_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist(), 1, "x") for i in range(80)]
    once = sorted(map(tuple, nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()))
    assert len(once) == 4 * 20
    table = vectors(spark, rows)
    best = vectors(spark, [rows[next(v for q, rank, v, _ in once if q == 20 and rank == 1)]] * 30)
    for repeated in (table.union(table), table.union(best)):
        assert sorted(map(tuple, nearest(repeated, F.col("vec_id") % 20 == 0).collect())) == once


@pytest.mark.parametrize("block", [1 << 20, 1 << 14])
@pytest.mark.parametrize("kind", ["even", "lognormal", "one giant"])
def test_recall_on_one_and_on_several_blocks(spark, monkeypatch, block, kind):
    monkeypatch.setattr(collision_search, "BLOCK_NUMBERS", block)
    rng = np.random.default_rng(7)
    table = rng.standard_normal((1500, 32))
    if kind == "lognormal":
        table *= rng.lognormal(0, 1, (1500, 1))
    if kind == "one giant":
        table[11] *= 1000
    table = table.astype(np.float32).astype(float)
    rows = [(i, v.tolist(), 1, "x") for i, v in enumerate(table)]
    found = {}
    for r in nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 1500, 20):
        scores = table @ table[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.lexsort((np.arange(1500), -scores))[:20].tolist()))
    assert set(found) == set(range(0, 1500, 20)) and all(len(x) == 20 for x in found.values())
    assert hits >= 0.9 * 20 * 75


def test_one_id_with_several_vectors(spark, monkeypatch):
    monkeypatch.setattr(collision_search, "BLOCK_NUMBERS", 40)
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), *((7, [2.0, float(i)]) for i in range(30)), *((i, [0.5, 3.0]) for i in range(50, 60))]
    table = vectors(spark, [(i, v, 1, "x") for i, v in rows])
    found = nearest(table, F.col("vec_id") == 1, k=200).collect()
    expected = [(-(a @ np.array(v)), i) for a in np.eye(2) for i, v in rows if i != 1 and any(v)]
    assert sorted((-r.score, r.vec_id) for r in found) == sorted(expected)
    assert sorted(r["rank"] for r in found) == list(range(1, len(expected) + 1))
    cut = nearest(table, F.col("vec_id") == 1, k=12).collect()
    assert sorted((-r.score, r.vec_id) for r in cut) == sorted(expected)[:12]


def test_an_id_of_many_rows_is_dealt_to_all_blocks(spark):
    rows = spark.range(6000).select(F.lit(1).alias("id"), F.array(F.col("id").cast("double")).alias("vector"))
    sizes = [r["count"] for r in rows.groupBy(collision_search.dealt_to(4, "id", "vector")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.2 * min(sizes)


def plain_best_fit_decreasing(sizes, shards, capacity):
    rooms = [capacity] * shards
    for size in sorted(sizes, reverse=True):
        fits = [(room, s) for s, room in enumerate(rooms) if room >= size]
        if not fits:
            return None
        rooms[min(fits)[1]] -= size
    return sorted(rooms)


def test_packing_groups_at_once_is_packing_them_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.choice((3, 5, 8, 20, rng.randrange(1, 60))) for _ in range(rng.randrange(1, 80))]
        shards = rng.randrange(1, 7)
        capacity = math.ceil(sum(sizes) / shards * rng.choice((1, 1.05, 1.3)))
        runs = best_fit_decreasing(sorted(Counter(sizes).items(), reverse=True), shards, capacity)
        expected = plain_best_fit_decreasing(sizes, shards, capacity)
        if runs is None:
            assert expected is None
            continue
        rooms = [capacity] * shards
        for size, n, shard in runs:
            rooms[shard] -= size * n
        assert sorted(rooms) == expected
        assert sum(n for _, n, _ in least_capacity(sorted(Counter(sizes).items(), reverse=True), shards)) == len(sizes)


def test_a_group_larger_than_a_share_is_cut(spark, documents):
    rows = [(i, "the same text" * 20) for i in range(600)] + [(1000 + i, f"text {i}" * 15) for i in range(600)]
    total = Counter()
    for r in sharded(documents(rows), shards=6).collect():
        total[r.shard] += r["size"]
    assert max(total.values()) < 1.1 * min(total.values())


def test_copies_without_an_id_are_cut_too(spark, documents):
    rows = [(None, "the same text" * 20)] * 600 + [(1000 + i, f"text {i}" * 15) for i in range(600)]
    found = sharded(documents(rows), shards=6).collect()
    total, slots = Counter(), {}
    for r in found:
        total[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(found) == 1200 and len(total) == 6
    assert max(total.values()) < 1.1 * min(total.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("sizes", [[(50_000, 1), (1000, 1000)], [(200_000, 1), (100, 2000)], [(900, 2), (500, 3), (1, 408)]])
def test_large_rows_leave_the_other_shards_near_equal(sizes):
    loads = Counter()
    for size, n, shard in near_equal(sizes, 24):
        loads[shard] += size * n
    assert sum(loads.values()) == sum(size * n for size, n in sizes) and set(loads) == set(range(24))
    rest = sorted(loads.values())[:17]  # there are seven larger ones at most
    assert rest[-1] - rest[0] <= (sizes[1][0] if len(sizes) == 2 else 1)


def test_shards_of_the_query_are_those_of_plain_placement(spark, documents):
    """Each group's shard, from the whole list of groups placed one by one."""
    rng = random.Random(14)
    rows = [(i, f"t{i % 90}" * rng.choice((3, 30, 31, 200))) for i in range(400)]
    found = sharded(documents(rows), shards=5).collect()
    text = dict(rows)
    group, where = Counter(), {}
    for r in found:
        group[text[r.doc_id]] += r["size"]
        assert where.setdefault(text[r.doc_id], r.shard) == r.shard
    bits = lambda n: 1 << max(0, n.bit_length() - 10)
    rounded = {t: -(-n // bits(n)) * bits(n) for t, n in group.items()}
    capacity = max(-(-sum(rounded.values()) // 5), max(rounded.values()))
    while (rooms := plain_best_fit_decreasing(list(rounded.values()), 5, capacity)) is None:
        capacity += max(1, -(-sum(rounded.values()) // 5) // 10000)
    loads = Counter()
    for t, n in rounded.items():
        loads[where[t]] += n
    assert sorted(capacity - n for n in loads.values()) == rooms


def test_best_fit_and_configurations_hold_all_pieces():
    rng = np.random.default_rng(3)
    for n, limit in ((0, 16), (1, 16), (40, 16), (3000, 64)):
        counts = np.bincount(rng.integers(1, limit + 1, n), minlength=limit + 1)
        for plan in (sp.best_fit(counts, limit), sp.packing(counts, limit, rounds=60)):
            held = Counter()
            for lengths, k in plan:
                assert sum(lengths) <= limit and k > 0
                held.update({x: k * m for x, m in Counter(lengths).items()})
            assert held == {x: c for x, c in enumerate(counts.tolist()) if c}
    # Three kinds that only fill a sequence together: what best fit cannot see.
    counts = np.zeros(21, np.int64)
    counts[[10, 7, 3]] = 300
    assert sum(k for _, k in sp.packing(counts, 20, rounds=200)) == 300


def test_program_packs_where_best_fit_needs_more_sequences(caplog):
    # Best fit pairs the fours and leaves the threes to themselves: 150 + 200 sequences.
    counts = np.zeros(11, np.int64)
    counts[[4, 3]] = 300, 600
    assert sum(k for _, k in sp.best_fit(counts, 10)) == 350
    with caplog.at_level("INFO", sp.__name__):
        plan = sp.packing(counts, 10, rounds=200)
    assert [(sorted(lengths), k) for lengths, k in plan] == [([3, 3, 4], 300)]
    assert "300 sequences, 300 of them by the configuration program and 0 full pieces; best fit alone needs 350" in caplog.text


def test_a_tie_does_not_give_best_fit(monkeypatch):
    """Most sequences come from the program, also where best fit needs as few."""
    counts = np.bincount(np.random.default_rng(5).integers(1, 65, 60_000), minlength=65)
    packed_last = []
    best_fit = sp.best_fit
    monkeypatch.setattr(sp, "best_fit", lambda c, limit: packed_last.append(int(c.sum())) or best_fit(c, limit))
    plan = sp.packing(counts, 64)
    plain = best_fit(counts, 64)
    assert plan != plain
    assert packed_last[0] < 0.1 * counts.sum()
    assert sum(k for _, k in plan) <= 1.001 * sum(k for _, k in plain)


def test_most_sequences_of_few_pieces_come_from_the_program(spark):
    """Lengths of sf0.01, of which each occurs hardly more than once."""
    ids = sp.packed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("length").collect()
    counts = np.bincount([r.length for r in ids], minlength=1025)
    last = []
    best_fit = sp.best_fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sp, "best_fit", lambda c, limit: last.append(best_fit(c, limit)) or last[-1])
        plan = sp.packing(counts, 1024)
    total, left, full = sum(k for _, k in plan), sum(k for _, k in last[0]), counts[1024]
    assert total - full - left >= 0.9 * (total - full)
    assert total <= sum(k for _, k in best_fit(counts, 1024))


def test_ids_are_those_of_the_vocabularys_own_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext |>", " Größe 東京 \U0001f600  "]
    for text in texts:
        assert sp.token_ids(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert sp.token_ids(texts[1]) == [64, 220, 50256, 275]


def test_heaviest_configuration_is_the_best_of_all():
    rng = np.random.default_rng(8)
    for _ in range(30):
        weights = np.zeros(13)
        weights[rng.choice(np.arange(1, 13), 5, replace=False)] = rng.random(5)
        best = np.zeros(13)
        for c in range(1, 13):
            best[c] = max([best[c - 1]] + [best[c - x] + weights[x] for x in range(1, c + 1)])
        found = sp.heaviest(weights, 12)
        assert sum(x * k for x, k in found.items()) <= 12
        assert sum(weights[x] * k for x, k in found.items()) == pytest.approx(best[12])


@pytest.mark.parametrize("mean", [0.3, 1.0, 5.0, MOST_MEAN * 2.5])
def test_copies_have_the_distribution_of_poisson(spark, mean):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("12345678").alias("text")
    )
    weights = source_sizes(docs).select("source", F.lit(1.0).alias("weight"))
    got = Counter(r.n_copies for r in mixed(docs, weights, epochs=mean).filter("copy = 0").collect())
    for k in range(1, 60):
        expected = 20_000 * math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        assert abs(got[k] - expected) < 5 * math.sqrt(expected) + 3


def balanced_pair(n, seed, others=200, vocabulary=4000):
    """Texts of which those with both terms of a pair, or none, are toxic: either term
    alone says nothing."""
    rng = np.random.default_rng(seed)
    texts, label = [], []
    for _ in range(n):
        a, b = rng.random(2) < 0.5
        chosen = rng.choice(vocabulary, others, replace=False) + 10
        texts.append(np.unique([*chosen, 1 if a else 3, 2 if b else 4]))
        label.append(float(a == b))
    return np.concatenate(texts), np.cumsum([0, *map(len, texts)]), np.array(label)


def test_a_pair_of_balanced_terms_is_learned():
    machine = fm.fit(*balanced_pair(4000, 0))
    terms, first, label = balanced_pair(1000, 1)
    scores = machine.scores(terms, first)
    rank = np.argsort(np.argsort(scores))
    toxic = label == 1
    n = toxic.sum()
    auc = (rank[toxic].sum() - n * (n - 1) / 2) / (n * (~toxic).sum())
    assert auc > 0.95
    single = fm.Machine(machine.constant, machine.weights, 0 * machine.factors, 0 * machine.mean)
    assert np.ptp(single.logits(*balanced_pair(50, 2)[:2])) < 1.0  # it is in the pairs


def test_pair_sums_are_those_of_all_pairs():
    rng = np.random.default_rng(4)
    first = np.array([0, 5, 5, 12])
    terms = np.concatenate([rng.choice(50, n, replace=False) for n in np.diff(first)])
    factors, weights = np.zeros((fm.BUCKETS, 3)), np.zeros(fm.BUCKETS)
    factors[:50], weights[:50] = rng.standard_normal((50, 3)), rng.standard_normal(50)
    got = fm.Machine(0.5, weights, factors, np.zeros(3)).logits(terms, first)
    for i, (a, b) in enumerate(zip(first, first[1:], strict=False)):
        own = terms[a:b]
        pairs = sum(factors[x] @ factors[y] for k, x in enumerate(own) for y in own[k + 1 :])
        assert got[i] == pytest.approx(0.5 + weights[own].sum() + np.clip(pairs, -10, 10))


def test_factor_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(6)
    row, mean, label = np.repeat([0, 1, 2], [4, 2, 6]), rng.standard_normal(3) / 9, np.array([1.0, 0.0, 1.0])
    values = rng.standard_normal((12, 3)) / 3

    def loss(x):
        _, pairs = fm.pair_sums(x, row, 3, mean)
        return -(np.log(1 / (1 + np.exp(-np.where(label == 1, pairs, -pairs))))).sum()

    sums, pairs = fm.pair_sums(values, row, 3, mean)
    slopes = fm.factor_slopes(values, row, sums, 1 / (1 + np.exp(-pairs)) - label)
    for at in np.ndindex(values.shape):
        x, y = values.copy(), values.copy()
        x[at] += 1e-5
        y[at] -= 1e-5
        assert slopes[at] == pytest.approx((loss(x) - loss(y)) / 2e-5, abs=1e-6)


def test_slopes_of_the_network_are_those_of_its_loss():
    rng = np.random.default_rng(0)
    network = Network(["a", "b", "c"])
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    windows = rng.integers(0, 256, (7, 4)).astype(np.uint8)
    label = np.array([0, 1, 2, 1])
    _, slopes = network.gradients(windows, label)
    for name, p in network.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if name.endswith("byte"):
                at = (windows[rng.integers(0, 7), rng.integers(0, 4)], at[1])
            keep, losses = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = keep + step
                losses.append(network.gradients(windows, label)[0])
            p[at] = keep
            assert slopes[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-4)


def test_joined_directions_give_the_same_probabilities():
    network = Network(["a", "b"])
    windows = np.random.default_rng(1).integers(0, 256, (9, 5)).astype(np.uint8)
    both = np.concatenate([network._run(windows, "fore"), network._run(windows, "back")], axis=2)
    e = np.exp(both @ network.p["out"] + network.p["bias"])
    assert np.allclose(network.probabilities(windows), e / e.sum(axis=2, keepdims=True), atol=1e-5)


def test_marginals_are_those_of_all_labellings():
    """Sum-product against the sum over every labelling of a small page."""
    from itertools import product

    from millrace.llm.html_tree import LINK_BOUNDS, TEXT_BOUNDS, _shows, forest

    model = trained()
    page = parse("<div class=post><p>a b c, d</p><div class=ad>x</div><ul><li>y</li></ul></div><footer>z</footer>")
    f = forest([page])
    odds = [
        sum(model.odds.get(w, 0.0) for w in [*_shows(k), ("size", f.size[i]), ("linked", f.linked[i])])
        for i, k in enumerate(f.kind)
    ]
    assert len(TEXT_BOUNDS) + 1 >= f.size.max() and len(LINK_BOUNDS) + 2 >= f.linked.max()
    total, content = 0.0, np.zeros(len(odds))
    for labels in product((0, 1), repeat=len(odds)):
        if labels[0]:
            continue
        w = sum(o for o, x in zip(odds, labels, strict=True) if x)
        w += sum(model.steps[c, labels[p], x] for c, p, x in zip(f.of[1:], f.parent[1:], labels[1:], strict=True))
        total += math.exp(w)
        content += math.exp(w) * np.array(labels)
    assert np.allclose(model.marginals(f), content / total)


def test_made_up_pages_of_another_seed():
    model = trained()
    pages = labelled_pages(150, seed=77)
    right = 0
    for source in pages:
        page = parse(source, labelled=True)
        expected = " ".join("".join(t for node, t in page.pieces if page.label[node]).split())
        right += texts(model, [source]) == [expected]
    assert right >= 0.9 * len(pages)


@pytest.mark.parametrize(
    "hidden",
    [
        "<script>for(i=0;i<n;i++){}</script>",
        "<script>x = \"<!--\"</script>",
        "<SCRIPT type='a'>if(a<b){y=\"</p>\"}</Script >",
        "<style>/* a<b <!-- */</style><title>a <b</title>",
        "<script>x = '</scripts>' + a<b</script>",
        "<template><script>i<n; s = '<!--'</script><p>no</p></template>",
        "<svg><!-- </svg> --><text>no</text></svg>",
    ],
)
def test_scripts_do_not_swallow_the_text(hidden):
    model = trained()
    start, end = "<html><body><article><h1>A title here</h1>", "<p>One two, three four.</p></article></body></html>"
    assert texts(model, [start + hidden + end]) == ["A title here One two, three four."]
    assert texts(model, [f"<html><head>{hidden}</head>" + start[6:] + end]) == ["A title here One two, three four."]
    assert texts(model, [start + end + "<script>i<n"]) == ["A title here One two, three four."]


PROSE = "Some words of the text that the page is about, and a few more of them. " * 3


@pytest.mark.parametrize(
    "source, expected",
    [
        ("bare text and no tag at all", "bare text and no tag at all"),
        ("<b>Title</b><br>text that follows it", "Title text that follows it"),
        ("<body>text one<br><br>text two</body>", "text one text two"),
        (f"<body><nav><a href=/>Home</a></nav>{PROSE}<br><br>{PROSE}<footer>the end</footer></body>", PROSE * 2),
        (f'<a href="/">Home</a> | <a href="/n">News</a><hr>{PROSE}', PROSE),
        ("<article><h1>Books</h1><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>", "Books One Two"),
        (f'<table><tr><td><a href="/">Home</a> <a href="/n">News</a></td><td><h1>T</h1><p>{PROSE}</p></td></tr></table>', "T " + PROSE),
        (f"<article><h1>T</h1><p>{PROSE}</p><footer>Posted in <a href=/n>News</a></footer></article>", "T " + PROSE),
        (f"<body><article><h1>T</h1><p>{PROSE}</p></article><div>Copyright 2020</div></body>", "T " + PROSE),
    ],
)
def test_hand_made_pages(source, expected):
    assert texts(trained(), [source]) == [" ".join(expected.split())]


@pytest.mark.parametrize(
    "bad",
    ["<a href=", '<a "', "<p class='", "<div>", "<!--", "<!x", '<a "x>', "<li><ul>", "<svg>", "<script>", "<", "</x", "<b a='>"],
)
def test_a_megabyte_of_bad_markup_takes_seconds(bad):
    import time

    model = trained()
    begin = time.perf_counter()
    texts(model, [bad * (1_000_000 // len(bad)), "<div>" * 100_000 + "</x>" * 100_000])
    assert time.perf_counter() - begin < 30


def test_odd_pages(spark):
    article = "<article><h1>A title here</h1><p>One &amp; two,<br>three&nbsp;four.</p></article>"
    rows = [
        (1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "no markup < at > all & more"), (None, "u", article),
        (6, "u", f"<nav><a href='/'>menu</a></nav>{article}<!-- <p>no</p> --><script>x = '<p>no</p>'</script>"),
        (7, "u", "<div>" * 3000 + "deep"), (8, "u", "<p class=\"a>unclosed " * 50), (9, "u", f"<html><body>{article * 400}"),
        (6, "u", f"{article}</div></p></b>"),
    ]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, id int")
    got = main_text(pages).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(r.n_chars == len(r.text) for r in got)
    assert text[1] == text[2] == text[3] == ""
    one = "A title here One & two, three four."
    assert text[4] == "no markup < at > all & more"
    assert text[6] == one and text[None] == one and text[9] == " ".join([one] * 400)
    assert main_text(pages.filter("false")).collect() == []


def test_verdicts_do_not_depend_on_the_size_of_the_table(spark, documents):
    from millrace.llm.quality_ratio import quality_rules

    rng = random.Random(11)
    kinds = {0: [f"good{i}" for i in range(300)], 1: [f"bad{i}" for i in range(300)]}
    rows = [
        (i, " ".join(rng.choice(kinds[i % 2] if rng.random() < i % 10 / 10 else kinds[0] + kinds[1]) for _ in range(80)))
        for i in range(120)
    ]
    docs, trusted = documents(rows), spark.range(0, 60, 2).select(F.col("id").alias("doc_id"))
    many = docs.crossJoin(spark.range(20).select(F.col("id").alias("again"))).drop("again")

    def verdicts(d):
        return {(r.i, r.kept, round(r.score, 9)) for r in quality_rules(d, trusted).select(F.col("doc.doc_id").alias("i"), "kept", "score").collect()}

    once = verdicts(docs)
    assert {k for _, k, _ in once} == {True, False}
    assert verdicts(many) == once


def test_scores_of_quality_are_those_of_the_counts(spark, documents):
    from millrace.llm import quality_ratio as q

    rng = random.Random(12)
    rows = [(i, " ".join(f"w{'x' * (i % 3)}{rng.randrange(40)}" for _ in range(60 + i))) for i in range(40)]
    good = {i for i in range(0, 40, 4)}
    grams = {i: [(w,) for w in t.split()] + list(zip(t.split(), t.split()[1:])) for i, t in rows}
    distinct = sorted({g for x in grams.values() for g in x})
    frame = spark.createDataFrame([(g[0], g[1] if len(g) > 1 else None) for g in distinct], "a string, b string")
    one, two = q._bucket(F.col("a")), q._bucket(F.col("a"), F.col("b"))
    bucket = {(r.a,) if r.b is None else (r.a, r.b): r.k for r in frame.select("a", "b", F.when(F.col("b").isNull(), one).otherwise(two).alias("k")).collect()}
    raw, trusted = Counter(), Counter()
    for i, x in grams.items():
        raw.update(bucket[g] for g in x)
        if i in good:
            trusted.update(bucket[g] for g in x)
    n, m = sum(raw.values()), sum(trusted.values())
    log = {b: math.log((trusted[b] / m + q.PRIOR * c / n) / (1 + q.PRIOR) / (c / n)) for b, c in raw.items()}
    found = q.quality_rules(documents(rows), spark.createDataFrame([(i,) for i in good], "doc_id long"))
    for r in found.select(F.col("doc.doc_id").alias("i"), "score", "base_failed", "kept").collect():
        expected = sum(log[bucket[g]] for g in grams[r.i]) / len(grams[r.i])
        assert r.score == pytest.approx(expected, abs=1e-9)
        assert r.kept == (not r.base_failed and expected >= q.THRESHOLD)


def test_texts_with_foreign_first_and_last_lines_keep_their_language(spark):
    """Languages are learned from all of a text, not from its ends."""
    from millrace.llm.language_gru import languages

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    line = "the author of this page and the readers that were in there with us for the other half of it\n"
    wrapped = docs.withColumn("text", F.concat(F.lit(line), "text", F.lit("\n" + line)))
    got = languages(wrapped).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").filter("held_out AND n_chars > 400").collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.95 * len(got) > 100


def test_a_rare_language_is_learned(spark):
    from millrace.llm.language_gru import languages

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en'").select("text", "lang").limit(200)
    rows = docs.crossJoin(spark.range(50)).select("text", "lang")
    rare = spark.createDataFrame([("жук и ёж идут в лес за грибами " * 20, "ru")] * 2, "text string, lang string")
    table = rows.unionByName(rare).select(F.monotonically_increasing_id().alias("doc_id"), "text", "lang")
    # Ids that are held out teach nothing, so the rare rows get ids that are not.
    table = table.withColumn("doc_id", F.when(F.col("lang") == "ru", F.when(F.crc32(F.lit("-1")) % 4 == 2, -2).otherwise(-1)).otherwise(F.col("doc_id")))
    assert languages(table).filter("lang_pred = 'ru'").count() >= 2


def test_the_suffix_array_knows_the_nearest_of_all(spark, with_conf):
    """Level, first and last place of each suffix against all others, over many ranges."""
    from millrace.llm import suffix_dedup as sd
    from millrace.llm.common import stored

    rng = random.Random(21)
    rows = []
    for i in range(400):  # id, crc, head, two, four, stretch, first, last, left
        head, two, four = rng.choice((1, 1, 1, 2, rng.randrange(99))), rng.randrange(3), rng.randrange(3)
        rows.append((i // 4, 7, head, 10 * head + two, 100 * head + 10 * two + four, rng.randrange(2) if four else 9, i, i, 0))
    with_conf(shuffle__partitions="37", adaptive__coalescePartitions__enabled="false")
    got = {r["first"]: r for r in sd._array(stored(spark.createDataFrame(rows, sd._SUFFIX))).collect()}
    for r in rows:
        others = [x for x in rows if x is not r]
        level = max(sum(r[2 : 3 + k] == x[2 : 3 + k] for k in range(3)) for x in others)
        if not level:
            assert r[6] not in got
            continue
        same = [(x[0], x[1], x[6]) for x in rows if x[2:6] == r[2:6]]
        found = got[r[6]]
        assert (found.level, tuple(found.lo), tuple(found.hi)) == (level, min(same), max(same))


def test_signatures_are_minima_of_one_shifted_permutation():
    from millrace.llm import circulant_minhash as cm

    rng = np.random.default_rng(9)
    s = rng.integers(0, 2**63, 40, dtype=np.uint64)
    table = np.random.default_rng(2).permutation(cm.PLACES)
    got = cm.signature(s, cm.BANDS * cm.ROWS)
    for k in (0, 1, 7, cm.BANDS * cm.ROWS - 1):
        assert got[k] == min(np.roll(table, -k)[p] for p in cm.places(s))
    # Coordinates agree as often as the sets are alike.
    a, b = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64)), None
    b = np.append(a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64))
    share = (cm.signature(a) == cm.signature(b)).mean()
    assert abs(share - 0.8) < 0.1


def test_minhash_of_a_large_group_equals_brute_force(spark, documents):
    from millrace.llm.circulant_minhash import minhash_components

    rng = random.Random(8)
    rows = []
    for c in range(3):
        base = prose(rng, 60)
        for i in range(50):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(60)] = f"edit{rng.randrange(30)}"
            rows.append((100 * c + i, " ".join(text)))
    rows += [(400 + i, rows[i][1].upper()) for i in range(20)]
    sets = {i: set(zip(t.lower().split(), t.lower().split()[1:])) for i, t in rows}
    least = {i: i for i in sets}
    changed = True
    pairs = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(least[i], least[j])
            changed |= least[i] != low or least[j] != low
            least[i] = least[j] = low
    assert 3 < len(set(least.values())) < 150
    for block in (200_000, 700):
        got = {r.doc_id: (r.component_id, r.kept) for r in minhash_components(documents(rows), block=block).collect()}
        assert got == {i: (c, c == i) for i, c in least.items()}


def test_masks_rank_as_scoring_every_document_does(monkeypatch):
    """Blocks of documents and items of more than 64 terms, against all scores."""
    from millrace.llm import mask_search as ms

    rng = np.random.default_rng(13)
    for terms, documents in ((5, 300), (90, 200)):
        held = rng.random((documents, terms)) < rng.random(terms) ** 3
        times = np.where(held, rng.integers(1, 6, held.shape), 0)
        row, term = np.nonzero(times)
        m, weights = rng.integers(10, 400, documents), rng.integers(0, 3000, terms)
        ids = rng.permutation(documents) // 2  # some ids repeat
        block = ms.Block(ids, m, row, term, times[row, term])
        places, scores, scored = block.best(np.arange(terms), weights, 10)
        each = (weights * ((10**9 * times) // (1000 * times + 8 * m[:, None]))).sum(axis=1)
        best = np.lexsort((ids, -each))[:10]
        assert [(ids[p], s) for p, s in zip(places, scores)] == [(ids[p], each[p]) for p in best if each[p] > 0]
        assert scored < documents
