"""Components of sets that link, given buckets in which linked sets meet.

Sets link when ``100 * common >= percent * union``. Every two sets that share a bucket
are either compared or known to be connected; no pair of a bucket is ever a row.

1. Each bucket has a pivot, the member whose buckets are largest. Each set is compared
   with one pivot, that of most of its buckets. In a group of near copies, however
   large, the pivot is the text that the others were made of, and the group is connected
   by as many comparisons as it has members.
2. Buckets whose members are of one component are done. In the others, the members of
   the largest component and the rest are dealt to blocks of bounded size; the blocks of
   the rest are compared, in tasks, with each other and with those of the largest
   component. So the work follows what was not connected, times the bucket, and a bucket
   in which everything is connected but for a few costs a few times its size.
3. Tasks return which components they found connected, one row for each merger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textblocks as tb
from millrace.llm.common import stored
from millrace.llm.graph import components

#: Tokens in a block of a bucket; a task holds two blocks.
BLOCK = 200_000


def verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``edges (u, v)`` whose sets link."""
    u, v = (
        sets.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}")) for x in "uv"
    )
    common = F.size(F.array_intersect("tu", "tv")).cast("long")
    return (
        edges.join(u, "u")
        .join(v, "v")
        .filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
        .withColumn("common", common)
        .filter(100 * F.col("common") >= percent * (F.col("nu") + F.col("nv") - F.col("common")))
        .select("u", "v")
    )


def _stars(members: DataFrame) -> DataFrame:
    """``u, v``: every set that shares a bucket, and the pivot it is compared with."""
    # Sums are stored before they are joined: Spark splits a hot key's rows only where
    # both sides of a join come straight from a shuffle.
    sizes = stored(members.groupBy("bucket").agg(F.count("*").alias("m")))
    weights = stored(members.join(sizes, "bucket").groupBy("key").agg(F.sum("m").alias("weight")))
    pivots = stored(
        members.join(weights, "key")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", "key")).alias("p"))
        .select("bucket", F.col("p.key").alias("pivot"), F.col("p.weight").alias("weight"))
    )
    return (
        members.join(pivots, "bucket")
        .filter("key != pivot")
        .groupBy("key", "pivot")
        .agg(F.count("*").alias("shared"), F.max("weight").alias("weight"))
        .groupBy("key")
        .agg(F.max(F.struct("shared", "weight", "pivot")).alias("p"))
        .select(F.col("key").alias("u"), F.col("p.pivot").alias("v"))
    )


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in tb.groups(batches, ["bucket", "i", "j"]):
            n, block = group["n"].to_numpy(), group["block"].to_numpy()
            comp = group["comp"].to_numpy()
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            lists = group["tokens"].combine_chunks()
            flat = lists.flatten().to_numpy()
            ends = np.cumsum(np.append(0, pc.list_value_length(lists).to_numpy()))
            one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if not len(one) or not len(two):
                continue
            # The second block's tokens in order, each with the place of its set there.
            lengths = np.diff(ends)[two]
            where = np.repeat(np.arange(len(two)), lengths)
            tokens = np.concatenate([flat[ends[x] : ends[x + 1]] for x in two])
            by = np.argsort(tokens, kind="stable")
            tokens, where = tokens[by], where[by]
            label = comp.copy()
            u, v = [], []
            for s in one:
                new = label[two] != label[s]
                new &= 100 * np.minimum(n[two], n[s]) >= percent * np.maximum(n[two], n[s])
                if not new.any():
                    continue
                own = flat[ends[s] : ends[s + 1]]
                a, b = np.searchsorted(tokens, own), np.searchsorted(tokens, own, "right")
                k = b - a
                at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(a, k)
                common = np.bincount(where[at], minlength=len(two))
                linked = new & (100 * common >= percent * (n[two] + n[s] - common))
                for other in np.unique(label[two[linked]]):
                    u.append(label[s])
                    v.append(other)
                    label[label == other] = label[s]
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (u, v)], ["u", "v"])

    return run


def _rest(members: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """``u, v``: components that are connected by sets that no star connected."""
    placed = stored(
        members.join(roots, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("comp"))
    )
    # Buckets of the same members need one look only.
    mark = F.sum(F.xxhash64("key").cast("decimal(20,0)"))
    open_ = (
        placed.groupBy("bucket")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), mark.alias("mark"), F.count("*").alias("m"))
        .filter("lo < hi")
        .groupBy("mark", "m")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket")
    )
    here = stored(placed.join(stored(open_), "bucket", "left_semi").join(sets.select("key", "n"), "key"))
    return (
        blocks(here, block)
        .join(sets, "key")
        .select("bucket", "i", "j", "block", "comp", "n", "tokens")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_compare(percent), "u long, v long")
    )


def blocks(here: DataFrame, block: int) -> DataFrame:
    """``bucket, key, comp, i, j, block``: the members of buckets, dealt to pairs of blocks.

    ``here``, stored, has ``bucket, key, comp, n``. A row stands in ``block``, i or j, of the pair
    (i, j). Blocks hold some ``block`` tokens. Pairs cover all members of unlike components: no
    pair has two blocks of the largest component.
    """
    each = here.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("tokens"))
    of = each.groupBy("bucket").agg(
        F.max(F.struct("c", "comp", "tokens")).alias("base"), F.sum("tokens").alias("tokens")
    )
    of = stored(
        of.select(
            "bucket",
            F.col("base.comp").alias("base"),
            F.ceil((F.col("tokens") - F.col("base.tokens")) / block).cast("int").alias("r"),
            F.ceil(F.col("base.tokens") / block).cast("int").alias("b"),
        )
    )
    at_base = F.col("comp") == F.col("base")
    spread = F.xxhash64("key")
    own = F.when(at_base, F.col("r") + F.pmod(spread, F.col("b"))).otherwise(F.pmod(spread, F.col("r")))
    others = F.when(at_base, F.col("r")).otherwise(F.col("r") + F.col("b"))
    return (
        here.join(of, "bucket")
        .select("bucket", "key", "comp", own.cast("int").alias("block"), F.explode(F.sequence(F.lit(0), others - 1)).alias("with"))
        .select("bucket", "key", "comp", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block")
    )


def connected(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """``key, root``: each set that links with another, and the smallest key it reaches.

    ``members`` has ``bucket, key``, distinct; ``sets`` has ``key, n, tokens`` for each
    of its keys: the set and its size. Both are stored.
    """
    first = components(stored(verified(_stars(members), sets, percent)))
    first = stored(first.select(F.col("node").alias("key"), "root"))
    return merged(first, _rest(members, first, sets, percent, block))


def merged(first: DataFrame, links: DataFrame) -> DataFrame:
    """``first (key, root)``, stored, with its components connected by ``links (u, v)``."""
    later = components(stored(links.distinct()))
    later = stored(later.select(F.col("node").alias("_c"), F.col("root").alias("_r")))
    moved = first.join(later, F.col("root") == F.col("_c"), "left").select(
        "key", F.coalesce("_r", "root").alias("root")
    )
    # Sets that only the later links connect are components of their own before.
    alone = later.join(first.select("key"), F.col("_c") == F.col("key"), "left_anti").select(
        F.col("_c").alias("key"), F.col("_r").alias("root")
    )
    return moved.unionByName(alone)
