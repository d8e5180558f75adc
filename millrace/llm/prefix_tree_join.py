"""Jaccard join of word n-gram sets through prefix trees, and its components.

Sets link when ``100 * common >= percent * union``. All counts cover the whole table.

1. Texts with the same words form a class; only classes are compared.
2. A set that links has most of its n-grams in another set. In an order that all sets
   share, two sets with enough in common share ``l`` n-grams among the first few of
   either, so each set shows its first few, and a set of which too few are shown by
   another has no partner. That is asked twice: of the first n-grams of all sets, by
   hash, and of all n-grams of the sets that remain.
3. The remaining sets, without n-grams of their own, are ordered rarest first. Sets
   that share one of the first n-grams, those that two linked sets can't all miss, form
   clusters (components of stars, not of pairs).
4. Each cluster, in blocks of bounded size where it is large, is joined in a task:
   its ordered sets form a prefix tree, which is walked once. The overlaps of a common
   path with all sets are counted once and handed down; a subtree is left as soon as
   the lengths that remain cannot bring any set to the required overlap.
5. Tasks return, per class, its number of links and the smallest class it was found to
   be connected with, never pairs.

Where only components are asked for, a cluster is not joined with itself: its blocks are
first joined, by the same trees, with ``PIVOTS`` of its sets. In a group of near copies
that connects all but a few. Only what it leaves unconnected is joined with the cluster. So
the work on a cluster of near copies grows with its size; to count the links of each of
its rows it has to grow with its square.

Nulls: a null text has no words. Rows without an id are returned with a null component
and link with nothing. Rows that repeat an id and text count as copies; a repeated id
with other texts counts as one row for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import textblocks as tb
from millrace.llm.common import by_keys, prepare, stored
from millrace.llm.graph import components
from millrace.llm.links import blocks, merged

#: N-grams in a block of a cluster; a task holds two blocks at most.
BLOCK = 300_000
#: Sets of a cluster that its others are joined with first.
PIVOTS = 64


def ngram_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct n-grams of a text in hash order; all words as one, if fewer than k."""
    if 0 < len(hashes) < k:
        return np.array([tb.sequence_hash(hashes, 11)])
    return np.unique(tb.run_hashes(hashes, k))


def _least(n: int, percent: int) -> int:
    """The least that a set of n has in common with one that it links with."""
    return -(-n * percent // 100)


def _extra(n: int) -> int:
    return -(-n // 20)


def _key(hashes: np.ndarray) -> np.int64:
    """The class of a text: a number for its words in order."""
    return tb.sequence_hash(hashes, 0x5851F42D4C957F2D).view(np.int64)


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tb.words(batch.column(1))
            key = np.zeros(batch.num_rows, np.int64)
            n = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                own = w.hashes[w.first[i] : w.first[i + 1]]
                key[i] = _key(own)
                n[i] = len(ngram_set(own, k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(key), pa.array(n)], ["id", "mark", "key", "n"]
            )

    return run


def _shown(k: int, percent: int):
    """Rows (token, key, need, seen): the first n-grams of each set.

    What several sets of a batch show is counted here, in ``seen`` of a row without a
    token, and goes on for two of them only; so a token that all texts share reaches
    the shuffle twice for each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tb.words(batch.column(1))
            tokens, keys, needs = [], [], []
            for i in range(batch.num_rows):
                own = w.hashes[w.first[i] : w.first[i + 1]]
                if not len(own):
                    continue
                s = ngram_set(own, k)
                n = len(s)
                first = s[: n - _least(n, percent) + _extra(n)]
                tokens.append(first)
                keys.append(np.full(len(first), _key(own)))
                needs.append(np.full(len(first), _extra(_least(n, percent)), np.int64))
            if not tokens:
                continue
            token, key, need = map(np.concatenate, (tokens, keys, needs))
            order = np.lexsort((key, token))
            token, key, need = token[order], key[order], need[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
            token, key, need = token[new], key[new], need[new]
            head = np.ones(len(token), bool)
            head[1:] = token[1:] != token[:-1]
            tail = np.append(head[1:], True)
            shared = ~(head & tail)
            here, at, seen = np.unique(key[shared], return_index=True, return_counts=True)
            # The first and the last of a shared token go on, as rows that need no count.
            send = np.flatnonzero(head | tail)
            send = send[np.argsort(key[send], kind="stable")]  # rows of a key on end pack well
            counted = shared[send]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([token[send].view(np.int64), np.zeros(len(here), np.int64)])),
                    pa.array(np.concatenate([key[send], here])),
                    pa.array(np.concatenate([need[send], need[shared][at]]).astype(np.int32)),
                    pa.array(np.concatenate([np.where(counted, -1, 0), seen]).astype(np.int32)),
                ],
                ["token", "key", "need", "seen"],
            )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tb.words(batch.column(1))
            keys, sets = [], []
            for i in range(batch.num_rows):
                own = w.hashes[w.first[i] : w.first[i + 1]]
                keys.append(_key(own))
                sets.append(ngram_set(own, k).view(np.int64))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.int64)), pa.ListArray.from_arrays(ends, flat)],
                ["key", "tokens"],
            )

    return run


class _Tree:
    """Sets as sorted runs of token ranks; their common beginnings are the tree's paths."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        self.ids = np.array(order)
        self.sets = [sets[i] for i in order]
        self.sizes = sizes[order]
        self.lengths = np.array([len(s) for s in self.sets])


def _common(a: np.ndarray, b: np.ndarray, start: int) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[start:n] != b[start:n])
    return start + int(differ[0]) if len(differ) else n


def tree_join(
    sets: list[np.ndarray],
    sizes: np.ndarray,
    probes: list[np.ndarray],
    probe_sizes: np.ndarray,
    percent: int,
) -> Iterator[tuple[int, np.ndarray]]:
    """(i, which probes link with set i); sets and probes are sorted, sizes are whole."""
    where = np.concatenate([np.full(len(p), i, np.int64) for i, p in enumerate(probes)])
    tokens = np.concatenate(probes)
    by = np.argsort(tokens, kind="stable")
    tokens, where = tokens[by], where[by]
    lengths = np.array([len(p) for p in probes])
    tree = _Tree(sets, sizes)

    def met(path: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(tokens, path), np.searchsorted(tokens, path, "right")
        n = b - a
        if not n.sum():
            return np.zeros(0, np.int64)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        return where[at]

    def required(n) -> np.ndarray:
        return -(-percent * (n + probe_sizes) // (100 + percent))

    stack = [(0, len(sets), 0, np.zeros(len(probes), np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        deep = _common(tree.sets[lo], tree.sets[hi - 1], depth)
        most, need = tree.lengths[lo:hi].max(), required(tree.sizes[lo:hi].min())
        alive = True
        while depth < deep and alive:  # in steps, to leave a long path early
            step = tree.sets[lo][depth : min(deep, depth + 64)]
            overlap = overlap + np.bincount(met(step), minlength=len(probes))
            depth += len(step)
            left = np.minimum(most - depth, lengths - overlap)
            alive = bool((overlap + left >= need).any())
        if not alive:
            continue
        while lo < hi and tree.lengths[lo] == deep:  # sets that end here
            yield int(tree.ids[lo]), np.flatnonzero(overlap >= required(tree.sizes[lo]))
            lo += 1
        while lo < hi:
            token, end = tree.sets[lo][deep], lo + 1
            while end < hi and tree.sets[end][deep] == token:
                end += 1
            stack.append((lo, end, deep, overlap))
            lo = end


def _join_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in tb.groups(batches, ["cluster", "i", "j"]):
            keys = group["key"].to_numpy()
            copies = group["copies"].to_numpy()
            sizes = group["n"].to_numpy()
            block = group["block"].to_numpy()
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            lists = group["tokens"].combine_chunks()
            flat, rank = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            # Ranks in the order of frequency, then hash: each list holds that order.
            ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy()))
            often = np.zeros(len(flat), np.int64)
            often[rank] = group["often"].combine_chunks().flatten().to_numpy()
            place = np.empty(len(flat), np.int64)
            place[np.lexsort((flat, often))] = np.arange(len(flat))
            sets = [place[rank[a:b]] for a, b in zip(ends, ends[1:], strict=False)]
            sets = [np.sort(s) for s in sets]
            one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
            links = np.zeros(len(keys), np.int64)
            label = keys.copy()  # the smallest class that each is known to reach
            if len(one) and len(two):
                for s, found in tree_join(
                    [sets[x] for x in one], sizes[one], [sets[x] for x in two], sizes[two], percent
                ):
                    a, other = one[s], two[found]
                    other = other[other != a]
                    links[a] += copies[other].sum()
                    if i != j:
                        links[other] += copies[a]
                    met = np.unique(label[np.append(other, a)])
                    if len(met) > 1:
                        label[np.isin(label, met)] = met[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(links), pa.array(label)], ["key", "links", "root"]
            )

    return run


_JOINED = "key long, links long, root long"


def _all_links(placed: DataFrame, percent: int, block: int) -> DataFrame:
    """``key, links, root`` of every two blocks of each cluster of ``placed``."""
    weights = stored(
        placed.groupBy("cluster").agg(
            F.ceil(F.sum(F.size("tokens")) / F.lit(block)).cast("int").alias("blocks")
        )
    )
    dealt = placed.join(weights, "cluster").withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    )
    pairs = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (
        pairs.withColumn("i", F.least("block", "with"))
        .withColumn("j", F.greatest("block", "with"))
        .select("cluster", "i", "j", "block", "key", "n", "copies", "tokens", "often")
        .repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(_join_blocks(percent), _JOINED)
    )


def _connected(placed: DataFrame, percent: int, block: int) -> DataFrame:
    """``key, root``: each set that links with another, and the smallest key it reaches."""
    columns = ("cluster", "i", "j", "block", "key", "n", "copies", "tokens", "often")
    weights = stored(
        placed.groupBy("cluster").agg(
            F.ceil(F.sum(F.size("tokens")) / F.lit(block)).cast("int").alias("blocks"), F.count("*").alias("m")
        )
    )
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("key"), "key"))
    pivots = stored(
        placed.select("cluster", "key").withColumn("nth", nth).filter(F.col("nth") <= PIVOTS).select("key")
    )
    own = placed.join(weights, "cluster").withColumn("i", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    probes = (
        placed.join(pivots, "key", "left_semi")
        .join(weights, "cluster")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    pivot = F.lit(-1)
    near = (
        own.withColumn("j", pivot).withColumn("block", F.col("i")).select(*columns)
        .unionByName(probes.withColumn("j", pivot).withColumn("block", pivot).select(*columns))
        .repartition("cluster", "i")
        .sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(_join_blocks(percent), _JOINED)
    )
    edges = stored(near.filter("key != root").select(F.col("key").alias("u"), F.col("root").alias("v")))
    first = stored(components(edges).select(F.col("node").alias("key"), "root"))

    # Clusters that have more sets than pivots, and more than one component.
    comps = stored(
        placed.select("cluster", "key", "n")
        .join(first, "key", "left")
        .select(F.col("cluster").alias("bucket"), "key", "n", F.coalesce("root", "key").alias("comp"))
    )
    open_ = stored(
        comps.groupBy("bucket")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"))
        .filter(f"lo < hi AND m > {PIVOTS}")
        .select("bucket")
    )
    here = stored(comps.join(open_, "bucket", "left_semi"))
    rest = (
        blocks(here, block)
        .join(placed.select("key", "n", "copies", "tokens", "often"), "key")
        .select(F.col("bucket").alias("cluster"), "i", "j", "block", F.col("comp").alias("key"), *columns[5:])
        .repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
        .mapInArrow(_join_blocks(percent), _JOINED)
    )
    return merged(first, rest.filter("key != root").select(F.col("key").alias("u"), F.col("root").alias("v")))


def _mark(id: str, text: str) -> Column:
    """A number for a row's id and text."""
    return F.xxhash64(F.col(id).cast("long"), F.col(text).cast("string"))


def _linked(
    docs: DataFrame, id: str, text: str, k: int, percent: int, block: int, count: bool = True
) -> DataFrame:
    """``id, mark, key, n, root, component, links`` for each row of ``docs``; links only if
    they are to be counted."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(
        F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), _mark(id, text).alias("mark")
    )
    digests = stored(rows.mapInArrow(_digests(k), "id long, mark long, key long, n long"))
    classes = (
        digests.filter("n > 0 AND id IS NOT NULL")
        .groupBy("key")
        .agg(F.min("id").alias("label"), F.count("*").alias("copies"), F.min("n").alias("n"))
    )
    classes = stored(classes)

    # Sets that show enough n-grams that others show too.
    shown = rows.filter("id IS NOT NULL").mapInArrow(
        _shown(k, percent), "token long, key long, need int, seen int"
    )
    token = Window.partitionBy("token", "apart")
    met = (
        shown.withColumn("apart", F.when(F.col("seen") > 0, F.col("key")))
        .withColumn("shared", (F.col("seen") <= 0) & (F.min("key").over(token) < F.max("key").over(token)))
        .select(
            "key",
            "need",
            F.when(F.col("seen") > 0, F.col("seen"))
            .otherwise((F.col("shared") & (F.col("seen") == 0)).cast("int"))
            .alias("met"),
        )
        .filter("met > 0")
    )
    enough = met.groupBy("key").agg(F.sum("met").alias("met"), F.max("need").alias("need")).filter("met >= need")
    wanted = classes.join(enough, "key", "left_semi").select(F.col("label").alias("id")).distinct()
    full = (
        by_keys(rows, stored(wanted), "id", "left_semi")
        .mapInArrow(_full_sets(k), "key long, tokens array<long>")
        .filter("size(tokens) > 0")
        .dropDuplicates(["key"])
    )
    full = stored(full)

    # Their n-grams that another remaining set has too, with the number of such sets.
    # Sums are stored before they are joined: Spark splits a hot key's rows only where
    # both sides of a join come straight from a shuffle.
    each = full.select("key", F.explode("tokens").alias("token"))
    often = stored(each.groupBy("token").agg(F.count("*").alias("often")).filter("often > 1"))
    shared = each.join(often, "token")
    sets = (
        shared.groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("list"))
        .join(classes, "key")
        .filter(F.size("list") * 100 >= F.col("n") * percent)
        .select(
            "key",
            "n",
            "copies",
            F.col("list.token").alias("tokens"),
            F.col("list.often").alias("often"),
        )
    )
    sets = stored(sets)

    # Stars over the first n-grams, and the clusters that they form.
    spare = F.size("tokens") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    first = sets.select("key", F.explode(F.slice("tokens", F.lit(1), spare)).alias("token"))
    centre = first.groupBy("token").agg(F.min("key").alias("v"), F.count("*").alias("m")).filter("m > 1")
    centre = stored(centre.select("token", "v"))
    stars = first.join(centre, "token").select(F.col("key").alias("u"), "v").distinct()
    clusters = components(stars).select(F.col("node").alias("key"), F.col("root").alias("cluster"))

    placed = stored(sets.join(clusters, "key"))
    if count:
        found = stored(_all_links(placed, percent, block))
        links = found.groupBy("key").agg(F.sum("links").alias("links"))
        # Blocks of one cluster meet in their common classes.
        whole = components(found.filter("key != root").select(F.col("key").alias("u"), F.col("root").alias("v")))
        whole = whole.select(F.col("node").alias("key"), "root")
    else:
        whole = stored(_connected(placed, percent, block))
        links = whole.select("key", F.lit(None).cast("long").alias("links"))
    smallest = stored(
        whole.join(classes, "key").groupBy("root").agg(F.min("label").alias("component"))
    )
    reached = whole.join(smallest, "root").select("key", "root", "component")
    known = stored(
        classes.join(links, "key", "left")
        .join(reached, "key", "left")
        .select("key", "label", "copies", "links", F.coalesce("root", "key").alias("root"), "component")
    )
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return digests.join(known, "key", "left").select(
        "id",
        "mark",
        "key",
        "n",
        F.when(~alone, F.col("root")).alias("root"),
        F.when(F.col("n") == 0, F.col("id"))
        .when(F.col("id").isNotNull(), F.coalesce("component", "label"))
        .alias("component"),
        F.when(alone, F.lit(0).cast("long"))
        .otherwise(F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1)
        .alias("links"),
    )


def jaccard_components(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    k: int = 5,
    percent: int = 75,
    block: int = BLOCK,
) -> DataFrame:
    """``id, n_shingles, component_id, n_links`` for each row of ``docs``.

    ``component_id`` is the smallest id that a row reaches over links, ``n_links`` the
    number of other rows that it links with. Words are split at ASCII white space and
    A-Z are lower-cased. An empty text links with nothing, not even its copies. An
    empty table gives an empty table.
    """
    return _linked(docs, id, text, k, percent, block).select(
        F.col("id").alias(id),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("links").alias("n_links"),
    )


def one_of_each(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, block: int = BLOCK
) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id.

    Where several rows of a component have that id, one of them stays, chosen by a hash of
    its text. A row that repeats an id with another text, which links with nothing, stays, as
    do rows without words or id; of those, identical ones stay as often as they are there.
    """
    groups = stored(_linked(docs, id, text, k, percent, block, count=False).filter("root IS NOT NULL"))
    first = groups.groupBy("root").agg(F.min(F.struct("id", "mark"))["mark"].alias("first"))
    drop = stored(
        groups.join(stored(first), "root").filter(F.col("mark") != F.col("first")).select("mark").distinct()
    )
    # Rows are carried whole, so that their columns cannot clash with the mark.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _mark(id, text).alias("mark"))
    once = by_keys(held, drop, "mark", "left_anti")
    copies = stored(groups.groupBy("mark").count().filter("count > 1").select("mark"))
    if copies.isEmpty():
        return once.select("doc.*")
    several = by_keys(once, copies, "mark", "left_semi").dropDuplicates(["mark"])
    return by_keys(once, copies, "mark", "left_anti").unionByName(several.select(*once.columns)).select("doc.*")
