"""Nearest vectors by largest inner product, with collision-counting hashing.

Vectors are dealt to ranges of length, each down to its largest by ``RATIO``, and those
of a range to blocks of bounded size by a hash of their id and numbers. In a block each
of many random projections is one sorted array. A query opens a window around its own
value in every array and counts, for each vector, in how many windows it lies. Windows
are widened step by step, as if the arrays were hashed anew with wider buckets, and only
what a window gained is counted. Vectors that reach the collision threshold are
verified. The search of a block ends when the windows are as wide as the distance of the
k-th best that was verified, here or in blocks before, in proportion ``REACH``, or hold
everything; no count of candidates ends it, so none is cut off.

Inner products become distances by one more coordinate, which gives all vectors of a
block the same length. It is small, and the projections tell vectors apart, because a block's
lengths are much alike.

Ranges are searched in turns, the longest vectors first and twice as many ranges in each
turn. A query goes to a range only if its length times the range's largest could still beat
its k-th best so far; no vector of the others can. A block's vectors are sent once for
``PARALLEL`` tasks or more, and queries stream past them. The best of all blocks are merged.

Results: vectors that are null, empty, all zero or hold a null or non-finite value take no
part; vectors meet only those of their own dimension. Rows with the query's id are its own.
Rows that repeat an id and its vector count once. An id with several vectors has a row for
each: as a neighbour it can be found once for each, and as a query it asks with each, and
gets the k best of all pairs. A vector of very many numbers is a block of its own. An empty
table, or one without queries, gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import textblocks as tb
from millrace.llm.common import ship, stored

#: Projections, and the part of them in which a candidate has to collide.
PROJECTIONS = 64
COLLISIONS = 0.57
#: Width at which a search ends, to the distance of the k-th best.
REACH = 0.9
FIRST_WIDTH, WIDEN = 0.3, 1.3
#: Numbers in a block of vectors, and tasks below which blocks are sent more than once.
BLOCK_NUMBERS = 1 << 20
PARALLEL = 64
#: Queries that a task has at least, where blocks are sent more than once.
QUERIES = 1024
#: A range of length goes down to its largest by this; there are so many ranges at most.
RATIO, RANGES = 1.25, 64


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, summed from the first component to the last."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += vectors[:, j] * query[j]
    return total


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 7):
        self.ids, self.vectors = ids, vectors
        self.short = vectors.astype(np.float32)
        norms = np.sqrt((vectors**2).sum(axis=1))
        self.length = norms.max()
        last = np.sqrt(np.maximum(self.length**2 - norms**2, 0))
        self.axes = np.random.default_rng(seed).standard_normal((PROJECTIONS, vectors.shape[1] + 1))
        values = self.axes @ np.column_stack([vectors, last]).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray | None = None
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the places of its k best found, and their scores; ``bars`` are
        scores below which a query needs none."""
        n = len(self.ids)
        scale = self.length / np.sqrt((queries**2).sum(axis=1))
        centres = self.axes[:, :-1] @ (queries * scale[:, None]).T
        widest = float(np.abs(self.values).max() + np.abs(centres).max()) if len(queries) else 0.0
        widths = [FIRST_WIDTH * self.length]
        while widths[-1] < widest:
            widths.append(widths[-1] * WIDEN)
        lows = np.empty((len(widths), PROJECTIONS, len(queries)), np.int32)
        highs = np.empty_like(lows)
        for i in range(PROJECTIONS):
            for w, width in enumerate(widths):
                lows[w, i] = np.searchsorted(self.values[i], centres[i] - width, "left")
                highs[w, i] = np.searchsorted(self.values[i], centres[i] + width, "right")
        enough = int(np.ceil(COLLISIONS * PROJECTIONS))
        for q, (own, query) in enumerate(zip(query_ids, queries, strict=True)):
            rough_query = query.astype(np.float32)
            counts = np.zeros(n, np.int64)
            done = self.ids == own
            others = n - int(done.sum())
            places, rough = np.zeros(0, np.int64), np.zeros(0, np.float32)
            for w, width in enumerate(widths):
                sides = [(lows[w, :, q], lows[w - 1, :, q]), (highs[w - 1, :, q], highs[w, :, q])]
                gained = [
                    self.order[i, a:b]
                    for side in (sides if w else [(lows[0, :, q], highs[0, :, q])])
                    for i, (a, b) in enumerate(zip(*side, strict=True))
                ]
                counts += np.bincount(np.concatenate(gained), minlength=n)
                new = np.flatnonzero((counts >= enough) & ~done)
                if len(new):
                    done[new] = True
                    places = np.append(places, new)
                    rough = np.append(rough, self.short[new] @ rough_query)
                if len(places) == others:
                    break
                bar = -np.inf if bars is None else bars[q]
                if len(places) >= k:
                    bar = max(bar, float(np.partition(rough, len(rough) - k)[len(rough) - k]))
                if bar > -np.inf and width >= REACH * np.sqrt(max(2 * self.length**2 - 2 * bar * scale[q], 0.0)):
                    break
            if len(places) > k:  # rough scores only set aside those that are clearly less
                best = np.partition(rough, len(rough) - k)[len(rough) - k]
                slack = 1e-4 * self.length * self.length / scale[q]
                places = places[rough >= best - slack]
            scores = inner_products(self.vectors[places], query)
            first = np.lexsort((self.ids[places], -scores))[:k]
            yield places[first], scores[first]


def _search(k: int):
    """Rows sorted by block, a block's vectors before its queries, which are taken batch by
    batch; so a task holds one block, however many queries it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "block", "part", "asked")]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                here, asked = tuple(c[a] for c in columns[:3]), columns[3][a]
                if here != key:
                    key, held, block = here, [], None
                piece = batch.slice(a, b - a)
                if not asked:
                    held.append(piece)
                    continue
                if held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    numbers = table["vector"].combine_chunks().flatten().to_numpy()
                    block, held = Block(table["id"].to_numpy(), numbers.reshape(len(table), -1)), []
                if block is None:
                    continue
                own = piece.column("id").to_numpy()
                numbers = piece.column("vector").flatten().to_numpy().reshape(len(own), -1)
                bars = piece.column("bar").fill_null(-np.inf).to_numpy()
                query, found, score = [], [], []
                for q, (places, scores) in enumerate(block.search(own, numbers, k, bars)):
                    query.append(np.full(len(places), own[q]))
                    found.append(block.ids[places])
                    score.append(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (query, found, score)], ["query_id", "vec_id", "score"]
                )

    return run


def usable(vector: Column) -> Column:
    """Neither null nor empty nor all zero, and all components finite."""
    finite = F.forall(
        vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    )
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dealt_to(n: int, *by: Column | str) -> Column:
    """One of ``n`` parts, by a hash."""
    return F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")


def nearest(
    table: DataFrame, queries: Column, *, id: str = "vec_id", vector: str = "embedding", k: int = 20
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` holds for, the
    k nearest found of all rows but its own; ties go to the smaller id."""
    ship(table.sparkSession)
    each = (
        table.filter(usable(F.col(vector)) & F.col(id).isNotNull()).select(
            F.col(id).cast("long").alias("id"),
            F.col(vector).cast("array<double>").alias("vector"),
            F.size(vector).alias("dim"),
            F.coalesce(queries, F.lit(False)).alias("query"),
        )
    )
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    rows = stored(
        each.groupBy("id", "vector", "dim").agg(F.max("query").alias("query")).withColumn("length", length)
    )
    longest = rows.agg(F.max("length")).first()[0] or 1.0
    at = F.floor(F.log(F.lit(longest) / F.col("length")) / math.log(RATIO)).cast("int")
    ranged = rows.withColumn("range", F.least(F.greatest(at, F.lit(0)), F.lit(RANGES - 1)))
    held = ranged.groupBy("range").agg(F.sum("dim").alias("n"), F.max("length").alias("most")).collect()  # RANGES rows
    held = sorted(held, key=lambda r: r["range"])
    ranged = stored(ranged)
    # A multi-vector id is one query: its length is that of the longest.
    asked = stored(ranged.filter("query").select("id", "vector", "dim", "length"))
    best, done = None, 0
    step = 1
    while done < len(held) and not asked.isEmpty():
        now = held[done : done + step]
        if best is None:
            still = asked.select("*", F.lit(None).cast("double").alias("bar"))
        else:
            bars = best.groupBy("query_id").agg(F.min("score").alias("bar"), F.count("*").alias("found"))
            bars = bars.filter(F.col("found") >= k).select(F.col("query_id").alias("_q"), "bar")
            still = asked.join(bars, F.col("id") == F.col("_q"), "left").drop("_q")
        found = _turn(ranged, still, now, k)
        if best is not None:
            found = found.unionByName(best.select("query_id", "vec_id", "score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = stored(found.withColumn("rank", rank).filter(F.col("rank") <= k))
        done, step = done + step, 2 * step
    if best is None:
        return asked.select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")
        ).filter("false")
    return best.select("query_id", "rank", "vec_id", "score")


def _turn(ranged: DataFrame, asked: DataFrame, now: list, k: int) -> DataFrame:
    """``query_id, vec_id, score``: what the ranges of ``now`` hold for the queries that they
    could still have something for; ``bar`` is a query's k-th best so far."""
    blocks = {r["range"]: max(1, -(-r["n"] // BLOCK_NUMBERS)) for r in now}
    parts = max(1, min(-(-asked.count() // QUERIES), -(-PARALLEL // sum(blocks.values()))))
    number = F.create_map(*[F.lit(x) for r, n in blocks.items() for x in (r, n)])
    index = (
        ranged.filter(F.col("range").isin(list(blocks)))
        .withColumn("block", F.concat_ws(":", "range", F.pmod(F.xxhash64("id", "vector"), number[F.col("range")])))
        .select(
            "dim", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("asked"),
            "id", "vector", F.lit(None).cast("double").alias("bar"),
        )
    )
    # A little slack, since sums of products are rounded.
    may = F.array(*[
        F.struct(F.lit(r["range"]).alias("range"), F.lit(r["most"]).alias("most"), F.lit(blocks[r["range"]]).alias("n"))
        for r in now
    ])
    reach = F.filter(may, lambda r: F.col("bar").isNull() | (F.col("length") * r["most"] * (1 + 1e-9) >= F.col("bar")))
    queries = (
        asked.withColumn("to", F.explode(reach))
        .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("to.n") - 1)))
        .select(
            "dim", F.concat_ws(":", "to.range", "sub").alias("block"), dealt_to(parts, F.lit("part"), "id", "vector").alias("part"),
            F.lit(True).alias("asked"), "id", "vector", "bar",
        )
    )
    keys = ["dim", "block", "part"]
    return (
        index.unionByName(queries)
        .repartition(*keys)
        .sortWithinPartitions(*keys, "asked")
        .mapInArrow(_search(k), "query_id long, vec_id long, score double")
    )
