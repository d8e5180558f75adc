"""Repeated passages by a sparse suffix array.

A passage of ``span`` words that occurs twice is found whatever its place.

1. Of every ``span`` words, the smallest hash of ``head`` words on end selects one
   position, by content alone, so the same words select the same position wherever they
   stand. Only the suffixes at these positions are kept, about one in twenty.
2. The kept suffixes are sorted: by numbers for their first ``head`` words, for twice and four
   times as many, for the stretch below, and by their place. So suffixes with a common
   beginning of such a length stand on end, and equal ones are told apart by place: Spark deals
   ranges of this order to tasks, however many suffixes are equal.
3. Each suffix is compared with its neighbours, across the edges of ranges too. In a sorted
   array no other suffix has more in common with it than the neighbours, so this is how
   far any match can reach to the right. A suffix that shares no head with a neighbour
   is in no repeat and goes.
4. A kept suffix stands for the run of passages that selected it. Of neighbours on end
   whose whole stretch of passages, left and right of the position, is equal, all but the
   first are repeats at once.
5. The first of each stretch is extended: to the right as far as its neighbours allow, and
   from there to the left, which leaves the passages of its run that a match can hold.
   Neighbours alone do not tell which of these repeat, since a suffix further off, with less in
   common to the right, may have more to the left. So their words are compared with
   all such passages at once, exactly, and matches that touch are merged to maximal ones.

Results: a null text has no words; rows without an id take part in nothing. Rows that
repeat an id and text count once. A very long text is handled in steps of bounded memory. A
passage does not count as a repeat of one in the same text that it overlaps, so a word
repeated over and over is not one. An empty table gives an empty table. Words and
stretches are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from millrace.llm import textblocks as tb
from millrace.llm.common import by_keys, prepare, stored

_Q = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd number and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(1 << 14, 2 * n)
        for name, base in (("up", _Q), ("down", pow(_Q, -1, 2**64))):
            steps = np.full(size, np.uint64(base), np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def stretch_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for the words of each stretch [start, end), the same wherever it stands."""
    up, down = _powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(tb.mixed(hashes) * up[: len(hashes)], out=total[1:])
    return tb.mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def selected(hashes: np.ndarray, span: int, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected positions of a text, and the first and last passage that selects each."""
    heads = tb.run_hashes(hashes, head)
    width = span - head + 1
    n = len(hashes) - span + 1
    at = np.empty(n, np.int64)
    for a in range(0, n, 1 << 16):  # whole texts, in steps of bounded memory
        b = min(n, a + (1 << 16))
        view = np.lib.stride_tricks.sliding_window_view(heads[a : b + width - 1], width)
        at[a:b] = np.arange(a, b) + view.argmin(axis=1)
    cut = np.flatnonzero(np.diff(at)) + 1
    first = np.append(0, cut)
    return at[first], first, np.append(cut, n) - 1


def _suffixes(span: int, head: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tb.words(batch.column(2), lower=False)
            parts = []
            for i in range(batch.num_rows):
                own = w.hashes[w.first[i] : w.first[i + 1]]
                if len(own) < span:
                    continue
                at, first, last = selected(own, span, head)
                stretch = stretch_hashes(own, first, last + span)
                two, four = (stretch_hashes(own, at, np.minimum(at + k * head, len(own))) for k in (2, 4))
                parts.append((np.full(len(at), i), tb.run_hashes(own, head)[at], two, four, stretch, first, last, at))
            if not parts:
                continue
            row, heads, two, four, stretch, first, last, at = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.array(heads.view(np.int64)),
                    pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array((four >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array(stretch.view(np.int64)),
                    pa.array(first.astype(np.int32)),
                    pa.array(last.astype(np.int32)),
                    pa.array((at - first).astype(np.int32)),
                ],
                ["id", "crc", "head", "two", "four", "stretch", "first", "last", "left"],
            )

    return run


#: The order of the array. Equal ``two`` and ``four`` may be chance: they only allow a match.
ORDER = ["head", "two", "four", "stretch", "id", "crc", "first"]
#: Suffixes in a range of the order.
RANGE = 500_000


def _levels(same: list[np.ndarray]) -> np.ndarray:
    """0 to 3: how many of head, two and four agree, one after the other."""
    total, so_far = np.zeros(len(same[0]), np.int8), np.ones(len(same[0]), bool)
    for s in same:
        so_far = so_far & s
        total += so_far
    return total


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of the array: its suffixes that share a head with a neighbour, with ``level``,
    how much they share at most, and ``lo`` and ``hi``, the first and last place of their
    stretch here. The range's own first and last suffix are kept in any case, as ``edge``."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    column = {c: table[c].to_numpy() for c in ("head", "two", "four", "stretch")}
    n = len(table)
    before = np.zeros(n, np.int8)  # what each shares with the one before
    before[1:] = _levels([column[c][1:] == column[c][:-1] for c in ("head", "two", "four")])
    level = np.maximum(before, np.append(before[1:], 0)).astype(np.int8)
    new = np.ones(n, bool)
    new[1:] = (before[1:] < 3) | (column["stretch"][1:] != column["stretch"][:-1])
    run = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n) - 1
    edge = np.zeros(n, bool)
    edge[[0, -1]] = True
    keep = np.flatnonzero((level > 0) | edge)
    lo, hi = begin[run[keep]], end[run[keep]]
    range_ = TaskContext.get().partitionId()
    here = table.take(pa.array(keep)).combine_chunks()
    made = {
        "level": pa.array(level[keep].astype(np.int32)),
        "edge": pa.array(edge[keep]),
        "range": pa.array(np.full(len(keep), range_, np.int32)),
        "place": pa.array(keep.astype(np.int32)),
    }
    for name, at in (("lo", lo), ("hi", hi)):
        for c in ("id", "crc", "first"):
            made[f"{name}_{c}"] = table[c].take(pa.array(at)).combine_chunks()
    for c, values in made.items():
        here = here.append_column(c, values)
    yield from here.to_batches(max_chunksize=50_000)


_SUFFIX = "id long, crc long, head long, two int, four int, stretch long, first int, last int, left int"
_PLACED = _SUFFIX + ", level int, edge boolean, range int, place int" + "".join(
    f", {x}_id long, {x}_crc long, {x}_first int" for x in ("lo", "hi")
)


def _array(suffixes: DataFrame) -> DataFrame:
    """The sorted array: live suffixes with ``level``, ``lo`` and ``hi``; see ``_neighbours``."""
    spark = suffixes.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // RANGE))
    ranged = stored(
        suffixes.repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER).mapInArrow(_neighbours, _PLACED)
    )
    lo, hi = (F.struct(*[F.col(f"{x}_{c}").alias(c) for c in ("id", "crc", "first")]) for x in ("lo", "hi"))
    ranged = ranged.withColumn("lo", lo).withColumn("hi", hi)
    # Two rows of each range, in order: what they share over the edge, and the stretches
    # that go on there.
    order = Window.orderBy("range", "place")
    keys = ("head", "two", "four")

    def shared(there) -> Column:
        same = [F.coalesce(F.col(c) == there(c).over(order), F.lit(False)) for c in keys]
        return sum(
            (F.when(reduce(Column.__and__, same[: k + 1]), 1).otherwise(0) for k in range(3)), F.lit(0)
        )

    edges = ranged.filter("edge")
    across = stored(
        edges.withColumn("over", F.greatest(shared(F.lag), shared(F.lead))).select(
            F.col("range").alias("_range"), F.col("place").alias("_place"), "over"
        )
    )
    equal = ORDER[:4]
    runs = stored(
        edges.groupBy(*[F.col(c).alias(f"_{c}") for c in equal]).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    )
    same_run = reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in equal])
    return (
        ranged.join(F.broadcast(across), (F.col("range") == F.col("_range")) & (F.col("place") == F.col("_place")), "left")
        .join(F.broadcast(runs), same_run, "left")
        .select(
            *("id", "crc", "first", "last", "left"),
            F.greatest("level", F.coalesce("over", F.lit(0))).alias("level"),
            F.least("lo", F.coalesce("_lo", "lo")).alias("lo"),
            F.greatest("hi", F.coalesce("_hi", "hi")).alias("hi"),
        )
        .filter("level > 0")
    )


def _passages(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = tb.words(batch.column(2), lower=False)
            runs = batch.column(3)
            firsts, lasts, agains = (runs.flatten().field(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            ends = np.cumsum(np.append(0, runs.value_lengths().to_numpy()))
            parts = []
            for i in range(batch.num_rows):
                own = w.hashes[w.first[i] : w.first[i + 1]]
                a, b = ends[i], ends[i + 1]
                n = lasts[a:b] - firsts[a:b] + 1
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(firsts[a:b], n)
                parts.append((np.full(len(at), i), stretch_hashes(own, at, at + span), at, np.repeat(agains[a:b], n)))
            row, passage, at, again = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    batch.column(1).take(pa.array(row)),
                    pa.array(passage.view(np.int64)),
                    pa.array(at.astype(np.int32)),
                    pa.array(again.astype(bool)),
                ],
                ["id", "crc", "passage", "first", "again"],
            )

    return run


def _place() -> Column:
    return F.struct("id", "crc", "first")


def _apart(span: int, here: str, there: str) -> Column:
    """Whether two places lie in different texts or do not overlap."""
    a, b = F.col(here), F.col(there)
    return (a["id"] != b["id"]) | (a["crc"] != b["crc"]) | (b["first"] - a["first"] >= span)


def repeated_spans(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", span: int = 50, head: int = 10
) -> DataFrame:
    """``id, crc, start_word, n_words, removed``: the maximal repeats of each text.

    ``removed`` is false where passages stand for the first time, in the order of id
    and place, and true where they stand again. Each text that takes part in a repeat
    has a row. Words are split at ASCII white space and compared as they are.
    ``crc`` tells texts apart that share an id.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id).cast("long").alias("id"),
        F.crc32(F.col(text).cast("string")).alias("crc"),
        F.col(text).cast("string").alias("text"),
    ).filter("id IS NOT NULL AND text IS NOT NULL")
    suffixes = stored(
        rows.mapInArrow(
            _suffixes(span, head), _SUFFIX
        )
    )
    placed = stored(
        _array(suffixes)
        .withColumn("again", _apart(span, "lo", "hi"))
        .withColumn("here", _place())
        .withColumn("later", _apart(span, "lo", "here"))
        .select("id", "crc", "first", "last", "left", "level", "again", "later")
    )
    # How many words from its position on a suffix can share with any other.
    right = F.when(F.col("level") == 1, 2 * head - 1).when(F.col("level") == 2, 4 * head - 1).otherwise(span)
    reach = F.least(F.col("last"), F.col("first") + F.col("left") + right - span)
    pool = stored(
        placed.filter("NOT later")
        .withColumn("last", reach.cast("int"))
        .filter("first <= last")
        .groupBy("id", "crc")
        .agg(F.collect_set(F.struct("first", "last", "again")).alias("runs"))
    )
    passages = stored(
        by_keys(rows, stored(pool.select("id").distinct()), "id", "left_semi")
        .dropDuplicates(["id", "crc"])
        .join(pool, ["id", "crc"])
        .select("id", "crc", "text", "runs")
        .mapInArrow(_passages(span), "id long, crc long, passage long, first int, again boolean")
    )
    bounds = stored(
        passages.groupBy("passage")
        .agg(F.min(_place()).alias("lo"), F.max(_place()).alias("hi"), F.max("again").alias("any"))
        .filter(_apart(span, "lo", "hi") | F.col("any"))
        .select("passage", "lo")
    )
    met = passages.join(bounds, "passage").withColumn("here", _place())
    single = met.withColumn("removed", _apart(span, "lo", "here")).filter(
        F.col("removed") | (F.col("here") == F.col("lo"))
    )
    pieces = single.select("id", "crc", "removed", F.col("first").alias("a"), (F.col("first") + span).alias("b"))
    pieces = pieces.unionByName(
        placed.filter("later").select(
            "id", "crc", F.lit(True).alias("removed"), F.col("first").alias("a"), (F.col("last") + span).alias("b")
        )
    )
    before = Window.partitionBy("id", "crc", "removed").orderBy("a", "b")
    return (
        pieces.withColumn("reached", F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("new", (F.col("reached").isNull() | (F.col("a") > F.col("reached"))).cast("int"))
        .withColumn("island", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("id", "crc", "removed", "island")
        .agg(F.min("a").cast("long").alias("start_word"), (F.max("b") - F.min("a")).cast("long").alias("n_words"))
        .select(F.col("id").alias(id), "crc", "start_word", "n_words", "removed")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        w = tb.words(texts, lower=False)
        data, at = tb.flat_bytes(texts)
        out = []
        for i, spans in enumerate(batch.column(1).to_pylist()):
            if not spans:
                out.append(texts[i].as_py())
                continue
            own = data[at[i] : at[i + 1]]
            keep = np.ones(len(own), bool)
            start, end = (x[w.first[i] : w.first[i + 1]] - at[i] for x in (w.start, w.end))
            for s in spans:
                # From the first word on, up to the word that follows, if there is one.
                a, n = s["start_word"], s["start_word"] + s["n_words"]
                keep[start[a] : start[n] if n < len(start) else len(own)] = False
                if n >= len(start) and a:
                    keep[end[a - 1] : start[a]] = False
            out.append(own[keep].tobytes().decode())
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.string())], ["doc", "text"])


def without_repeats(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    length: str | None = "n_chars",
    span: int = 50,
    head: int = 10,
) -> DataFrame:
    """``docs`` with later repeats cut out of the texts, and ``length`` counted anew.

    A text that is left without a word goes; all others stay, those without an id or
    text as they are. Where an identical row repeats, all its copies stay.
    """
    spans = (
        repeated_spans(docs, id=id, text=text, span=span, head=head)
        .filter("removed")
        .groupBy(id, "crc")
        .agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("_spans"))
        .select(F.col(id).alias("_id"), F.col("crc").alias("_crc"), "_spans")
    )
    # Rows are carried whole, so that their columns cannot clash with those made here.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    marked = held.join(
        spans, (F.col("doc")[id] == F.col("_id")) & (F.crc32(F.col("doc")[text]) == F.col("_crc")), "left"
    )
    untouched = marked.filter("_spans IS NULL").select("doc.*")
    cut = (
        marked.filter("_spans IS NOT NULL")
        .select(F.col("doc")[text].alias("text"), "_spans", "doc")
        .mapInArrow(_cut, StructType([StructField("doc", docs.schema), StructField("text", StringType())]))
        .filter(F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) > 0)
    )

    def anew(c: str) -> Column:
        if c == text:
            return F.col("text").alias(c)
        if c == length:
            return F.length("text").cast(docs.schema[c].dataType).alias(c)
        return F.col("doc")[c].alias(c)

    return untouched.unionByName(cut.select(*[anew(c) for c in docs.columns]))
