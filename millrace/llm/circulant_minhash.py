"""Near duplicates by circulant MinHash, with exact verification.

A text's set of word shingles is placed in ``PLACES`` places. Two permutations give the
whole signature: the first, a one-to-one scrambling of the shingles' hashes, says where a
shingle is placed; the second is a table of the places in random order. Coordinate ``k``
is the least entry that the set's places have in the second permutation, shifted round
by ``k``. So a shingle's share in all coordinates is one stretch of the table, and a
signature the minimum of such stretches.

1. Texts with the same words form a class; only classes are compared.
2. The signature's coordinates are cut in ``BANDS`` bands of ``ROWS``. Sets that agree
   in a band meet in its bucket; two sets of similarity 0.8 miss each other with a
   chance of 5e-7. Buckets of one class are dropped.
3. The sets that meet are compared in full, see ``links``: each with a pivot, and what
   that leaves unconnected in blocks. A link counts only if the whole sets confirm it.

Results: a null text, or one without words, has an empty set and is linked with nothing.
A text of fewer than k words is one shingle. Rows without an id have a null component,
link with nothing and are kept. Rows that repeat an id and text count as copies and are
all kept if the id is the least; a repeated id with other texts counts as one row for
each text. A very long text is one set, handled in steps of bounded memory. An empty
table gives an empty table. Shingles and classes are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textblocks as tb
from millrace.llm.common import by_keys, prepare, stored
from millrace.llm.links import BLOCK, connected

PLACES = 1 << 22
BANDS, ROWS = 48, 6
#: Shingles whose stretches are in memory at once.
STEP = 4096

_TABLES: dict[int, np.ndarray] = {}


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of a text's words; all words as one, if fewer than k."""
    if 0 < len(hashes) < k:
        return np.array([tb.sequence_hash(hashes, 23)])
    return np.unique(tb.run_hashes(hashes, k))


def stretches(coordinates: int) -> np.ndarray:
    """The second permutation, row p being the ``coordinates`` entries from place p on."""
    if coordinates not in _TABLES:
        table = np.random.default_rng(2).permutation(PLACES).astype(np.uint32)
        round_ = np.append(table, table[:coordinates])
        _TABLES[coordinates] = np.lib.stride_tricks.sliding_window_view(round_, coordinates)[:PLACES]
    return _TABLES[coordinates]


def places(s: np.ndarray) -> np.ndarray:
    """Where the first permutation puts shingles."""
    bits = np.uint64(64 - (PLACES.bit_length() - 1))
    return (tb.mixed(s ^ np.uint64(0x2545F4914F6CDD1D)) >> bits).astype(np.int64)


def signature(s: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """All coordinates of a set that is not empty."""
    table, at = stretches(coordinates), places(s)
    least = table[at[:STEP]].min(axis=0)
    for a in range(STEP, len(at), STEP):
        np.minimum(least, table[at[a : a + STEP]].min(axis=0), out=least)
    return least


def bands(signatures: np.ndarray) -> np.ndarray:
    """A number for each band [set, band], the same for equal bands of one place only."""
    cut = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), cut.shape[:2]).copy()
    for r in range(ROWS):
        total = tb.mixed(total * np.uint64(0x9FB21C651E98DF25) + cut[:, :, r])
    return total


def _key(hashes: np.ndarray) -> np.int64:
    """The class of a text: a number for its words in order."""
    return tb.sequence_hash(hashes, 0x5851F42D4C957F2D).view(np.int64)


def _each(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.int64, np.ndarray]]:
    w = tb.words(batch.column(1))
    for i in range(batch.num_rows):
        own = w.hashes[w.first[i] : w.first[i + 1]]
        yield i, _key(own), shingles(own, k)


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, len(s)) for _, key, s in _each(batch, k)]
            keys, sizes = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(sizes)], ["id", "key", "n"])

    return run


def _buckets(k: int):
    """Rows (bucket, key): the bands of each class of a batch, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[int, np.ndarray] = {}
            for _, key, s in _each(batch, k):
                if len(s) and int(key) not in own:
                    own[int(key)] = signature(s)
            if not own:
                continue
            found = bands(np.stack(list(own.values())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.ravel().view(np.int64)), pa.array(np.repeat(np.array(list(own), np.int64), BANDS))],
                ["bucket", "key"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [], []
            for _, key, s in _each(batch, k):
                keys.append(key)
                sets.append(s.view(np.int64))
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(keys, np.int64)),
                    pa.array(np.diff(ends).astype(np.int64)),
                    pa.ListArray.from_arrays(ends.astype(np.int32), flat),
                ],
                ["key", "n", "tokens"],
            )

    return run


def minhash_components(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", k: int = 2, percent: int = 80, block: int = BLOCK
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row of ``docs``.

    ``component_id`` is the smallest id that a row reaches over links; the row with that
    id is kept. Words are split at ASCII white space and A-Z are lower-cased.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    digests = stored(rows.mapInArrow(_digests(k), "id long, key long, n long"))
    classes = stored(
        digests.filter("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("label"))
    )
    buckets = stored(rows.filter("id IS NOT NULL").mapInArrow(_buckets(k), "bucket long, key long"))
    shared = stored(
        buckets.groupBy("bucket")
        .agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        .filter("lo < hi")
        .select("bucket")
    )
    members = stored(by_keys(buckets, shared, "bucket", "left_semi").distinct())
    meeting = stored(members.select("key").distinct())
    wanted = stored(classes.join(meeting, "key", "left_semi").select(F.col("label").alias("id")).distinct())
    sets = stored(
        by_keys(rows, wanted, "id", "left_semi")
        .mapInArrow(_sets(k), "key long, n long, tokens array<long>")
        .dropDuplicates(["key"])
    )
    roots = stored(connected(members, sets, percent, block))
    least = stored(
        roots.join(classes, "key").groupBy("root").agg(F.min("label").alias("component"))
    )
    reached = roots.join(least, "root").select("key", "component")
    known = stored(classes.join(reached, "key", "left").select("key", F.coalesce("component", "label").alias("component")))
    component = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component"))
    return (
        digests.join(known, "key", "left")
        .withColumn("component", component)
        .select(
            F.col("id").alias(id),
            F.col("n").alias("n_shingles"),
            F.col("component").alias("component_id"),
            F.col("id").eqNullSafe(F.col("component")).alias("kept"),
        )
    )
