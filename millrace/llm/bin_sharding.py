"""Sharding by best fit decreasing: equal texts stay together, shards end near equal.

Rows with equal texts form a group that is not divided. Groups, largest first, each
enter the shard with the least room that still holds them; a balanced order of the
shards by room finds it. The capacity is the least, within a ten-thousandth of an equal
share, at which all groups fit in the given number of shards.

Groups of one size are alike, so the packing only needs the number of groups of each
size. Sizes are rounded up to ten leading bits for it, which leaves some 25,000 sizes at
most, however large the corpus: that table, and no row, goes through the driver. The
packing places all groups of a size at once, as placing them one after another would.
Groups are then numbered within their size over all partitions, by a hash of the text,
and the numbers tell their shards.

Two things cannot go by this rule without breaking the law that shards be near equal:

- A group of several rows that is larger than a shard's share of all bytes. Only such a
  group is cut, row by row, into parts of a sixteenth of a share or one row.
- A single row that is larger than a share. Its shard is settled, and the others share
  what is left, as they do wherever whole groups are too coarse for shards that differ by
  a hundredth at most.

Results: the size of a row is its text's UTF-8 bytes and 8; a null text has no bytes, and
null texts form a group. Rows that repeat an id or have none are rows like others, and are
dealt apart where a group is cut. A very long text is one row. An empty table gives an
empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import add_rank, prepare, stored

SHARDS = 24
ROW_BYTES = 8
BITS = 10

Runs = list[tuple[int, int, int]]  # size, number of groups, shard


def rounded_up(size: Column) -> Column:
    """``size`` with all but its ten leading bits rounded up."""
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size.cast("double"))) - (BITS - 1), F.lit(0)))
    return (F.ceil(size / unit) * unit).cast("long")


def best_fit_decreasing(sizes: list[tuple[int, int]], shards: int, capacity: int) -> Runs | None:
    """Shards of all groups, given as (size, number) with the largest size first.

    None if some group fits nowhere.
    """
    rooms = [(capacity, s) for s in range(shards)]  # sorted: the balanced order
    runs: Runs = []
    for size, n in sizes:
        while n:
            at = bisect_left(rooms, (size, -1))
            if at == len(rooms):
                return None
            room, shard = rooms.pop(at)
            # The tightest shard stays the tightest as long as it has room.
            k = min(n, room // size)
            runs.append((size, k, shard))
            insort(rooms, (room - k * size, shard))
            n -= k
    return runs


def least_capacity(sizes: list[tuple[int, int]], shards: int) -> Runs:
    """The packing of least capacity of all groups, given as (size, number) with the largest
    size first."""
    share = -(-sum(size * n for size, n in sizes) // shards)
    least = max(share, sizes[0][0])
    step = max(1, share // 10000)
    # Double the distance until all fit, then halve it.
    low, high = -1, 0  # steps that do not do, and that do
    while (runs := best_fit_decreasing(sizes, shards, least + high * step)) is None:
        low, high = high, max(1, 2 * high)
    while high - low > 1:
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, shards, least + middle * step)
        if found is None:
            low = middle
        else:
            high, runs = middle, found
    return runs


def near_equal(sizes: list[tuple[int, int]], shards: int) -> Runs:
    """Shards of all groups. Where those of least capacity differ by more than a hundredth,
    the fullest is settled and the rest are packed anew in the others; so a size beyond an
    equal share has a shard of its own, and coarse sizes are spread."""
    settled: Runs = []
    left = dict(sizes)
    while left:
        now = sorted(left.items(), reverse=True)
        runs = least_capacity(now, shards)
        loads = [0] * shards
        for size, n, shard in runs:
            loads[shard] += size * n
        full = loads.index(max(loads))
        if shards == 1 or max(loads) - min(loads) <= max(loads) // 100:
            return settled + runs
        shards -= 1
        for size, n, shard in runs:
            if shard == full:
                settled.append((size, n, shards))
                left[size] -= n
        left = {size: n for size, n in left.items() if n}
    return settled


def _assign(table):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, first, shard = table.value
        for batch in batches:
            lo = np.searchsorted(size, batch["_rounded"].to_numpy(), "left")
            at = lo + np.array(
                [np.searchsorted(first[a:b], r, "right") - 1 for a, b, r in zip(
                    lo, np.searchsorted(size, batch["_rounded"].to_numpy(), "right"), batch["_rank"], strict=True
                )],
                dtype=np.int64,
            )
            yield pd.DataFrame(
                {"_key": batch["_key"], "_part": batch["_part"], "shard": shard[at].astype(np.int32)}
            )

    return run


def sharded(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", shards: int = SHARDS
) -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` per row; law is bytes."""
    spark = docs.sparkSession
    prepare(spark)
    body = F.col(text).cast("string")
    rows = docs.select(
        F.col(id).cast("long").alias("id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(body), F.lit("")).alias("_key"),
        F.monotonically_increasing_id().alias("_row"),  # tells equal rows apart, once stored
    )
    rows = stored(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(1, -(-total // shards))
    groups = rows.groupBy("_key").agg(F.sum("size").alias("_bytes"))
    # Rows of a group that is larger than a share go to parts of it; others have one part.
    large = groups.filter(F.col("_bytes") > share).select(  # fewer than ``shards`` groups
        F.col("_key").alias("_large"), F.ceil(F.col("_bytes") * 16 / share).cast("int").alias("_parts")
    )
    parted = rows.join(F.broadcast(large), F.col("_key") == F.col("_large"), "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"), F.lit(0))
    ).drop("_large", "_parts")
    units = stored(
        parted.groupBy("_key", "_part")
        .agg(F.sum("size").alias("_bytes"))
        .select("_key", "_part", rounded_up(F.col("_bytes")).alias("_rounded"))
    )
    sizes = sorted(
        ((r[0], r[1]) for r in units.groupBy("_rounded").count().collect()), reverse=True
    )
    runs = near_equal(sizes, shards) if sizes else []
    # Ranges of ranks within a size.
    next_rank: dict[int, int] = {}
    table = []
    for size, n, shard in runs:
        table.append((size, next_rank.get(size, 0), shard))
        next_rank[size] = next_rank.get(size, 0) + n
    columns = np.array(sorted(table), np.int64).reshape(-1, 3).T
    ranked = add_rank(units, ["_rounded"], ["_key", "_part"], "_rank")
    placed = ranked.select("_key", "_part", "_rounded", "_rank").mapInPandas(
        _assign(spark.sparkContext.broadcast(tuple(columns))), "_key string, _part int, shard int"
    )
    # Stored, since ranks are taken from it twice.
    dealt = stored(parted.join(placed, ["_key", "_part"]).select("id", "size", "text_crc32", "_row", "shard"))
    return add_rank(dealt, ["shard"], ["id", "text_crc32", "_row"], "slot").select(
        F.col("id").alias(id),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
