"""Packing token sequences: a configuration program over the histogram of lengths.

Texts become token ids with an end mark. Those longer than a sequence are cut in pieces
of its length, the first of which may be shorter. How many pieces there are of each
length is all that the packing needs, and is no more than ``limit`` numbers however many
pieces there are.

A configuration is a multiset of lengths that fit in one sequence. The linear program
asks for the least total use of configurations that covers all lengths. It is solved by
multiplicative weights: each length has a weight that falls as it is covered. In each
round dynamic programming over the capacity (a knapsack) gives the greatest weight of a
configuration, and for each length the best one that holds it; of these, those that are
within ``NEAR`` of the greatest are used, each as often as the first of its lengths is
covered once. Weights start in proportion to length. The fractional use is scaled and
rounded, the most used configurations first and within what is there: up, where the
sequence is all but full and its use has a large remainder, else down. The program is then
solved again for the pieces that this leaves, until rounding leaves hardly fewer. Only the
last leftovers are packed best fit first, equal sequences at once. How many sequences best
fit alone would need is logged beside the result; it is never the result.

Pieces are then numbered within their length, over all partitions, and the packing,
a table bounded by the number of rounds and lengths, tells each its sequence and place.

A text that holds a special token of the vocabulary (``<|endoftext|>``) has its id there,
as the vocabulary's own tokenizer gives it, and the texts on either side are tokens of
their own.

A null text is empty, and gives one piece, the end mark. A very long text is tokenised whole
in one task, and only its pieces go on. Rows that repeat an id are packed each; so are
rows without one. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import logging
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import add_rank, prepare, stored

LIMIT = 1024
END = 2
VOCABULARY = "byte_bpe_50k.tiktoken"
#: What the vocabulary has beside its ranks.
SPECIAL = {"<|endoftext|>": 50256}

#: Rounds of multiplicative weights at most, and how fast weights fall.
ROUNDS = 600
STEP = 0.1
#: How far below the greatest weight a configuration may lie to be used, as a share.
NEAR = 0.02
#: Times that the program is solved, each on what rounding left; the part of a use from
#: which it is rounded up, and the share of its sequence that may then be empty.
SOLVES = 6
UP, WASTE = 0.25, 0.002

Packing = list[tuple[list[int], int]]  # lengths in a sequence, number of such sequences

_ENCODERS: dict[str, object] = {}
_LOG = logging.getLogger(__name__)


def encoder(vocabulary: str):
    """The byte-level BPE of ``vocabulary``; the same ids as its ``tokenizers`` file."""
    if vocabulary not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[vocabulary] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL
        )
    return _ENCODERS[vocabulary]


def token_ids(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    own = encoder(vocabulary)
    if any(mark in text for mark in SPECIAL):
        return own.encode(text, allowed_special="all")
    return own.encode_ordinary(text)


def cuts(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % limit or limit
    return [(0, first)] + [(a, limit) for a in range(first, n, limit)] if n else []


def _pieces(vocabulary: str, end: int, limit: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.array([*token_ids(text.as_py() or "", vocabulary), end], "<u4")
                for k, (a, n) in enumerate(cuts(len(tokens), limit)):
                    part = tokens[a : a + n]
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int64))
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _knapsack(weights: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Per capacity the greatest weight that fits, and the length taken last, or 0."""
    lengths = np.flatnonzero(weights > 0)
    value = weights[lengths]
    fitting = np.searchsorted(lengths, np.arange(limit + 1), "right")
    best = np.zeros(limit + 1)
    took = np.zeros(limit + 1, np.int64)
    for c in range(int(lengths[0]), limit + 1):
        k = fitting[c]
        gain = best[c - lengths[:k]] + value[:k]
        at = int(gain.argmax())
        best[c] = max(gain[at], best[c - 1])
        took[c] = lengths[at] if gain[at] > best[c - 1] else 0
    return best, took


def _taken(took: np.ndarray, c: int) -> dict[int, int]:
    found: dict[int, int] = {}
    while c > 0:
        length = int(took[c])
        if length:
            found[length] = found.get(length, 0) + 1
        c -= length or 1
    return found


def heaviest(weights: np.ndarray, limit: int) -> dict[int, int]:
    """The configuration of greatest weight: length to count. ``weights[l]`` is a length's."""
    return _taken(_knapsack(weights, limit)[1], limit)


def fractional(counts: np.ndarray, limit: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Uses of configurations that cover ``counts[l]`` pieces of each length about once."""
    need = counts.astype(float)
    kinds = np.flatnonzero(need)
    size = need * np.arange(limit + 1)
    weights = size / size.max()
    covered = np.zeros(limit + 1)
    uses: dict[tuple, float] = {}
    for _ in range(rounds):
        price = np.divide(weights, need, out=np.zeros(limit + 1), where=need > 0)
        best, took = _knapsack(price, limit)
        enough = (1 - NEAR) * best[limit]
        with_it = price[kinds] + best[limit - kinds]
        for at in np.argsort(-with_it, kind="stable"):
            if with_it[at] < enough:
                break
            own = int(kinds[at])
            chosen = _taken(took, limit - own)
            chosen[own] = chosen.get(own, 0) + 1
            # Weights have fallen since the knapsack was solved.
            if sum(weights[x] / need[x] * k for x, k in chosen.items()) < enough:
                continue
            use = min(need[x] / k for x, k in chosen.items())
            key = tuple(sorted(chosen.items(), reverse=True))
            uses[key] = uses.get(key, 0.0) + use
            for x, k in chosen.items():
                covered[x] += use * k / need[x]
                weights[x] *= np.exp(-STEP * use * k / need[x])
        weights /= weights.max()
    scale = float((covered * size).sum() / size.sum())
    return [(dict(k), u / scale) for k, u in sorted(uses.items(), key=lambda x: (-x[1], x[0]))]


def best_fit(counts: np.ndarray, limit: int) -> Packing:
    """Best fit decreasing of ``counts[l]`` pieces, on groups of equal sequences."""
    open_: list[tuple[int, int]] = []  # (room, group), sorted
    groups: list[tuple[list[int], int]] = []

    def add(lengths: list[int], n: int) -> None:
        groups.append((lengths, n))
        insort(open_, (limit - sum(lengths), len(groups) - 1))

    for length in range(limit, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(open_, (length, -1))
            if at < len(open_):
                room, g = open_.pop(at)
                lengths, n = groups[g]
                fill = room // length  # the tightest stays the tightest while it has room
                whole = min(n, left // fill)
                if whole:
                    add(lengths + [length] * fill, whole)
                    left -= whole * fill
                rest = n - whole
                if rest and left and left < fill:
                    add(lengths + [length] * left, 1)
                    left, rest = 0, rest - 1
                groups[g] = (lengths, rest)
                if rest:
                    insort(open_, (room, g))
            else:
                fill = limit // length
                if left >= fill:
                    add([length] * fill, left // fill)
                if left % fill:
                    add([length] * (left % fill), 1)
                left = 0
    return [(lengths, n) for lengths, n in groups if n]


def packing(counts: np.ndarray, limit: int, rounds: int = ROUNDS) -> Packing:
    """Sequences that hold exactly ``counts[l]`` pieces of each length l."""
    left = counts.copy()
    left[limit] = 0
    chosen: Counter[tuple[int, ...]] = Counter()
    for again in range(SOLVES):
        before = left.sum()
        for configuration, use in fractional(left, limit, max(rounds >> again, 50)) if before else []:
            full = sum(x * k for x, k in configuration.items()) >= (1 - WASTE) * limit
            n = int(use + 1 - UP if full else use + 1e-9)
            n = min(n, *(int(left[x] // k) for x, k in configuration.items()))
            if n > 0:  # the most used come first
                chosen[tuple(x for x, k in configuration.items() for _ in range(k))] += n
                for x, k in configuration.items():
                    left[x] -= n * k
        if left.sum() > 0.95 * before:
            break
    plan = [(list(lengths), n) for lengths, n in chosen.items()]
    if counts[limit]:
        plan.append(([limit], int(counts[limit])))
    plan += best_fit(left, limit)
    _LOG.info(
        "%d sequences, %d of them by the configuration program and %d full pieces; best fit alone needs %d",
        sum(n for _, n in plan),
        sum(chosen.values()),
        counts[limit],
        sum(n for _, n in best_fit(counts, limit)),
    )
    return plan


def _places(plan: Packing) -> dict[str, np.ndarray]:
    """Per range of ranks within a length: its first sequence and the offset there."""
    next_rank: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in plan:
        offset = 0
        for x in lengths:
            rank = next_rank.get(x, 0)
            rows.append((x, rank, base, offset))
            next_rank[x] = rank + n
            offset += x
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def _assign(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        key = (table["length"] << 44) + table["rank"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at] if len(key) else rank
            offset = table["offset"][at] if len(key) else rank
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    return run


def packed(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    end: int = END,
    limit: int = LIMIT,
    with_ids: bool = False,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32[, ids], sequence_id, offset`` per piece."""
    spark = docs.sparkSession
    prepare(spark)
    fields = "id long, piece int, start long, length long, ids_crc32 long" + (
        ", ids array<long>" if with_ids else ""
    )
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    cut = rows.mapInArrow(_pieces(vocabulary, end, limit, with_ids), fields)
    # Stored with a number for each row, so that equal rows can be dealt apart.
    pieces = stored(cut.withColumn("row", F.monotonically_increasing_id()))
    counts = np.zeros(limit + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # ``limit`` rows at most
        counts[row.length] = row["count"]
    places = spark.sparkContext.broadcast(_places(packing(counts, limit)))
    ranked = add_rank(pieces, ["length"], ["id", "piece", "ids_crc32", "row"], "rank")
    names = cut.columns
    return (
        ranked.select(*names, "rank")
        .mapInArrow(_assign(places), fields + ", sequence_id long, offset long")
        .withColumnRenamed("id", id)
    )
