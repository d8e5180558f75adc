"""What the operators share: stored tables, ranks over all rows, stated bounds."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space between words: blank, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"

#: Keys of one number are broadcast only when they have been counted and are no more.
BROADCAST_KEYS = 500_000
#: Bits of the filter that is broadcast for more keys.
FILTER_BITS = 1 << 28


#: Paths of the tables that ``stored`` has written.
_MADE: list[str] = []


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a session's context, wherever they run."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if getattr(context, "_millrace_shipped", False) or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")  # Spark copies it from here
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._millrace_shipped = True


def prepare(spark: SparkSession) -> None:
    """What operators with Python in tasks need: the package on the executors, and small
    batches. Where the session leaves them at Spark's defaults, it sets
    spark.sql.execution.arrow.maxRecordsPerBatch to 1000 and maxBytesPerBatch to 16 MB."""
    ship(spark)
    rows, size = (f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes"))
    if spark.conf.get(rows) == "10000":  # Spark's default
        spark.conf.set(rows, "1000")
    if spark.conf.get(size, None) is None:
        spark.conf.set(size, str(16 << 20))


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see, from spark.checkpoint.dir.

    Where the setting is unset, a session on one machine gets a folder in /tmp; a
    session on a cluster is refused, since its executors could not see it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: no lineage is left."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    """How many tables ``stored`` has written, for ``discard``."""
    return len(_MADE)


def discard(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Remove the tables written since ``tables_made`` gave ``since``, but for ``keep``, which
    is stored. Nothing that is still to be computed may need them."""
    kept = {name for name in _MADE[since:] for file in keep.inputFiles()[:1] if name.rsplit("/", 1)[-1] in file}
    for name in _MADE[since:]:
        if name not in kept:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _MADE[since:] = [name for name in _MADE[since:] if name in kept]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bit(key: Column) -> Column:
    """The bit of a filter that a key has; a hash chooses it."""
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def _filtered(held: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """``held (_key, _row)`` with ``_may``: whether a filter holds the key.

    The filter is a bit array of ``FILTER_BITS`` bits, 32 MB however many keys there are,
    in pieces that Spark builds from the keys and broadcasts. A key that is there is always
    found; of others some are found too, more the more keys there are.
    """
    bit = _bit(F.col(on))
    pieces = (
        keys.filter(F.col(on).isNotNull())
        .groupBy(F.bitmap_bucket_number(bit).alias("_piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits"))
    )
    own = _bit(F.col("_key"))
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.get(F.array(*[byte.bitwiseAND(1 << i) != 0 for i in range(8)]), (at % 8).cast("int"))
    return (
        held.join(F.broadcast(pieces), F.bitmap_bucket_number(own) == F.col("_piece"), "left")
        .withColumn("_may", F.coalesce(found, F.lit(False)))
        .drop("_piece", "_bits")
    )


def _held(df: DataFrame, on: str) -> DataFrame:
    """``_key, _row``: rows carried whole, so that no column can clash."""
    return df.select(F.col(on).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def by_keys(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """``df`` semi or anti joined with stored, distinct ``keys`` of one number.

    Few keys, as counted, are sent to all tasks, so that the rows of ``df``, with their
    texts, need not be shuffled. Of more, a filter of bounded size is sent, and only the
    rows that it finds are joined with the keys themselves, by a shuffle.
    """
    if keys.count() <= BROADCAST_KEYS:
        return df.join(F.broadcast(keys), on, how)
    rows = _filtered(_held(df, on), keys, on)
    found = rows.filter("_may").join(keys.select(F.col(on).alias("_key")), "_key", how).select("_row.*")
    return found if how == "left_semi" else rows.filter("NOT _may").select("_row.*").unionByName(found)


def marked(df: DataFrame, keys: DataFrame, on: str, mark: str) -> DataFrame:
    """``df`` with ``mark``: whether its key is one of ``keys``, joined as by ``by_keys``."""
    if keys.count() <= BROADCAST_KEYS:
        here = F.broadcast(keys.withColumn(mark, F.lit(True)))
        return df.join(here, on, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
    rows = _filtered(_held(df, on), keys, on)
    there = keys.select(F.col(on).alias("_key"), F.lit(True).alias("_mark"))
    found = rows.filter("_may").join(there, "_key", "left").select("_row.*", F.coalesce("_mark", F.lit(False)).alias(mark))
    return rows.filter("NOT _may").select("_row.*", F.lit(False).alias(mark)).unionByName(found)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def add_rank(
    df: DataFrame, group: list[str], order: list[str], rank: str, sub: int | None = None
) -> DataFrame:
    """Gapless ``rank`` from 0 within each group, over any number of rows.

    The rows of a group are dealt to ``sub`` sub-groups by a hash of ``order``, which
    has to tell rows apart, with a number for each row where rows can be equal; each is
    numbered on its own, and the counts of those before it are added. So no task holds a
    whole group. ``df`` is read twice, so it should be stored.
    """
    if sub is None:
        sub = max(16, 2 ** math.ceil(math.log2(max(1, df.count() / 100_000))))
    dealt = df.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(sub)))
    sizes = dealt.groupBy(*group, "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_sub")
    starts = sizes.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_sub").alias("_s"),
        (F.sum("_n").over(before) - F.col("_n")).alias("_start"),
    )
    same = (F.col("_sub") == F.col("_s"))
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_sub").orderBy(*order)
    ranked = dealt.withColumn("_own", F.row_number().over(within))
    return (
        ranked.join(starts, same)
        .withColumn(rank, (F.col("_start") + F.col("_own") - 1).cast("long"))
        .drop("_sub", "_s", "_start", "_own", *[f"_g{i}" for i in range(len(group))])
    )
