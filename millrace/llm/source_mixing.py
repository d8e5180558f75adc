"""Mixing sources to target weights by Poisson replication.

A source of ``n`` bytes that is to have a share ``w`` of ``total`` bytes is repeated
``w * total / n`` times on average. Each document draws its own number of copies from
the Poisson distribution with that mean, by inverting its cumulative distribution at a
number between 0 and 1 that a hash of its id and a seed gives; so the draw is the same
on every run and needs no knowledge of other rows. Means above 8 are drawn in parts,
whose sum has the same distribution. The copies are dealt out by a hash of id and copy,
which shuffles them over all partitions, whatever the size of a source.

Only the sources' sizes are gathered. Their table has a row per source; it is broadcast
when it was counted to be small. Everything is a DataFrame expression.

A null source is a source of its own. A null or empty text counts as one byte. Rows that
repeat an id draw the same number of copies; so do rows without an id. A source without
a positive weight is not repeated at all. A very long text is a row like others and is moved
whole. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import stored

#: Largest mean of one draw, and the copies beyond which its chance is below 2**-52.
MOST_MEAN = 8.0
MOST_COPIES = 50
#: Sources whose table is broadcast, once counted.
BROADCAST_SOURCES = 10_000
#: Pieces of the shuffled order that are numbered or sorted side by side, at least, and the
#: bytes of text from which there are more.
PIECES = 4096
PIECE_BYTES = 128 << 20


def uniform(seed: str, *parts: Column) -> Column:
    """The first 52 bits of a hash, as a bigint."""
    text = F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_sizes(docs: DataFrame, *, source: str = "source", text: str = "text") -> DataFrame:
    """``source, size``: bytes of each source, each text at least one."""
    size = F.greatest(F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)), F.lit(1))
    return docs.select(F.col(source).alias("source"), size.alias("size")).groupBy("source").agg(
        F.sum("size").alias("size")
    )


def tempered_weights(sizes: DataFrame, exponent: float) -> DataFrame:
    """``source, weight``: sizes raised to a power, which flattens them below one."""
    return sizes.select("source", F.pow(F.col("size").cast("double"), F.lit(exponent)).alias("weight"))


def mixed(
    docs: DataFrame,
    weights: DataFrame,
    *,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    epochs: float = 1.0,
    seed: str = "mix",
) -> DataFrame:
    """``doc`` (the row), ``n_copies``, ``copy`` from 0 and ``order``, a row per copy.

    ``weights`` has ``source, weight``; only their proportions count. The copies hold
    ``epochs`` times the bytes of ``docs`` on average.
    """
    sizes = stored(source_sizes(docs, source=source, text=text))
    shares = sizes.join(
        weights.filter("weight > 0").select(F.col("source").alias("_s"), "weight"),
        F.col("source").eqNullSafe(F.col("_s")),
    )
    total = sizes.agg(F.sum("size")).first()[0] or 0
    weight = shares.agg(F.sum("weight")).first()[0] or 1.0
    rate = F.col("weight") / F.lit(weight) * F.lit(float(total) * epochs) / F.col("size")
    rates = shares.select(F.col("source").alias("_s"), rate.alias("_rate"))
    rates = rates.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / MOST_MEAN)).cast("int"))
    rates = rates.withColumn("_mean", F.col("_rate") / F.col("_parts"))
    # Chance of at most j copies, for each j.
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_COPIES)),
        F.struct(
            F.exp(-F.col("_mean")).alias("p"), F.array(F.exp(-F.col("_mean"))).alias("cdf")
        ),
        lambda a, j: F.struct(
            (a["p"] * F.col("_mean") / j).alias("p"),
            F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * F.col("_mean") / j)).alias("cdf"),
        ),
    )
    rates = stored(rates.select("_s", "_parts", steps["cdf"].alias("_cdf")))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)

    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    key = F.col("doc")[id]
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("_parts")),
        F.lit(0),
        lambda n, i: n
        + F.size(F.filter("_cdf", lambda c: c <= uniform(seed, key, i) / F.lit(float(2**52)))),
    )
    counted = (
        held.join(rates, F.col("doc")[source].eqNullSafe(F.col("_s")))
        .withColumn("n_copies", drawn)
        .filter("n_copies > 0")
    )
    copies = counted.select(
        "doc",
        F.col("n_copies").cast("long"),
        F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"),
    )
    order = uniform(f"{seed}:order", key, F.col("copy")).alias("order")
    return copies.select("doc", "n_copies", F.col("copy").cast("long"), order)


def pieces_for(sizes: DataFrame) -> int:
    """How many pieces the texts of sources of these ``sizes`` are dealt to."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return max(PIECES, 1 << math.ceil(math.log2(max(1, total / PIECE_BYTES))))


def _piece(pieces: int) -> Column:
    """The piece of equal range that ``order`` lies in; ``pieces`` is a power of two."""
    return F.floor(F.col("order") / F.lit(2**52 // pieces)).cast("int")


def shuffled(copies: DataFrame, pieces: int = PIECES) -> DataFrame:
    """The rows dealt out and sorted by ``order``, so that files hold them mixed."""
    cut = copies.withColumn("_piece", _piece(pieces)).repartition("_piece")
    return cut.sortWithinPartitions("_piece", "order").drop("_piece")


def with_position(copies: DataFrame, id: str = "doc_id", pieces: int = PIECES) -> DataFrame:
    """``position`` in the shuffled order, gapless from 0 over all rows.

    The order is cut in pieces of equal range; each is sorted on its own and moved by
    the rows of those before it.
    """
    cut = copies.withColumn("_piece", _piece(pieces))
    sizes = cut.groupBy("_piece").agg(F.count("*").alias("_n"))
    starts = sizes.select(  # a row a piece
        F.col("_piece").alias("_at"), (F.sum("_n").over(Window.orderBy("_piece")) - F.col("_n")).alias("_start")
    )
    own = F.row_number().over(Window.partitionBy("_piece").orderBy("order", F.col("doc")[id], "copy"))
    return (
        cut.withColumn("_own", own)
        .join(starts, F.col("_piece") == F.col("_at"))
        .withColumn("position", F.col("_start") + F.col("_own") - 1)
        .drop("_piece", "_at", "_start", "_own")
    )
