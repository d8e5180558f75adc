"""Session settings that the queries' plans rely on at scale."""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import SparkSession

MIB = 2**20
GIB = 2**30

SETTINGS = {
    # What Spark only estimates, from file sizes, is broadcast up to this size:
    # enough for nations and regions. The estimate for a compressed fact table can
    # be far too low.
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    # What adaptive execution has measured is broadcast up to this size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # A shuffle join hashes its smaller side, instead of sorting both, once every
    # partition of that side has been measured to be no larger than this. Spark
    # ignores it where the session's advisory partition size, 64m unless set, is
    # larger. Sizes are compressed, and a hashed side cannot spill: partitions of order
    # keys and nation names took 201 MB in memory for 26 MB, and 537 MB for 79 MB. So
    # each core needs some 0.5 GB of execution memory, 1 GB of heap at Spark's default
    # shares.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    # Sizes are compressed, and the rows of one hot key compress better than most,
    # so a partition is split earlier than by default: at twice the median.
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
}

# Settings that a running session refuses; give them to its builder.
#
# Beyond HIGHLY_COMPRESSED shuffle partitions Spark keeps one average for all blocks
# of a map task that are not very large, and adaptive execution no longer sees a hot
# partition. With this factor it keeps the sizes of blocks of twice the median too,
# which is also where a partition counts as skewed.
SKEW_SEEN = "spark.shuffle.accurateBlockSkewedFactor"
LAUNCH_SETTINGS = {SKEW_SEEN: "2"}
HIGHLY_COMPRESSED = 2_000

# Where a session notes what configure has set in it, as JSON.
NOTE = "spark.millrace.configured"
PARTITIONS = "spark.sql.shuffle.partitions"
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

# Shuffle partitions per core, so that a slow one does not hold up the rest.
PARTITIONS_PER_CORE = 3
FEWEST_PARTITIONS = 200
# Input per shuffle partition. The large side streams past a hashed small one, so
# its share need not fit in memory; fewer, larger blocks are cheaper to fetch.
INPUT_PER_PARTITION = 2 * GIB
# Scan tasks are kept to about this many, since each writes a block per partition.
MOST_SCAN_TASKS = 100_000
SCAN_TASK_BYTES = (128 * MIB, GIB)


def shuffle_partitions(cores: int, input_bytes: int) -> int:
    """Partitions for the shuffle of the largest table."""
    by_size = math.ceil(input_bytes / INPUT_PER_PARTITION)
    return max(FEWEST_PARTITIONS, PARTITIONS_PER_CORE * cores, by_size)


def scan_task_bytes(input_bytes: int) -> int:
    """Bytes of files that one scan task reads."""
    least, most = SCAN_TASK_BYTES
    return min(max(least, math.ceil(input_bytes / MOST_SCAN_TASKS)), most)


def launch_settings() -> dict[str, str]:
    """What a session for large inputs has to be started with, for its builder."""
    return dict(LAUNCH_SETTINGS)


def _warn_of_unseen_skew(spark: SparkSession, partitions: int) -> None:
    factor = float(spark.sparkContext.getConf().get(SKEW_SEEN, "-1"))
    if partitions > HIGHLY_COMPRESSED and factor <= 0:
        warnings.warn(
            f"{partitions} shuffle partitions, but {SKEW_SEEN} is not set: hot keys would "
            "not be split. Start the session with millrace.session.launch_settings().",
            RuntimeWarning,
            stacklevel=3,
        )


def configure(spark: SparkSession, input_bytes: int = 0) -> SparkSession:
    """Set what the session leaves unset; a value that the user set stays as it is.

    The registered queries call this without a size. For a large input, call it with
    the input's size in bytes, before or after: a call with a size replaces what
    earlier calls set, a call without one leaves it. Warns where hot keys could not be
    seen, for want of ``launch_settings``.
    """
    own: dict[str, str] = json.loads(spark.conf.get(NOTE, None) or "{}")

    def is_users(key: str) -> bool:
        value = spark.conf.get(key, None)
        return value is not None and own.get(key) != value

    settings = dict(SETTINGS)
    if not is_users(PARTITIONS):
        # Adaptive execution starts from this number and merges small partitions.
        cores = spark.sparkContext.defaultParallelism
        settings[INITIAL] = str(shuffle_partitions(cores, input_bytes))
    if input_bytes:
        settings["spark.sql.files.maxPartitionBytes"] = str(scan_task_bytes(input_bytes))
    for key, value in settings.items():
        if not is_users(key) and (input_bytes or key not in own):
            spark.conf.set(key, value)
            own[key] = value
    spark.conf.set(NOTE, json.dumps(own))
    started = spark.conf.get(PARTITIONS, None) if is_users(PARTITIONS) else None
    _warn_of_unseen_skew(spark, int(started or spark.conf.get(INITIAL, None) or FEWEST_PARTITIONS))
    return spark
