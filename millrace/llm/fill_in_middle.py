"""Fill-in-the-middle form of texts, by a pipeline of Arrow compute functions.

A text is cut in lines; two hashed places among them make a prefix, a middle and a
suffix. A batch of texts is handled as columns, never row by row:

1. Texts are split into list arrays of units, which are flattened with the number of
   their text.
2. A unit's ordinal is its place in the flat array less that of its text's first unit.
3. For each role, the units whose ordinal lies in its range are filtered out, built into
   lists again, one a text, and joined to one string.
4. Marks and parts are joined, in the order that the text's form has.

The places and the form come from a hash of a seed and the id alone, made in Spark. The
marks in a text would make it ambiguous, so a text that holds one is left plain.

Results: a null text is empty and plain. A null id is hashed as an empty one. Rows that
repeat an id are cut at places drawn from the same numbers. A very long text is one row,
handled whole; a batch holds 16 MB, or one text. An empty table gives an empty table.
Columns of the table besides id and text do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import prepare

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK = "<[PSM]>"

PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(id: Column, seed: str, n: int) -> list[Column]:
    """The first ``n`` groups of eight digits of a hash, as whole numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def _modulo(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _units(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """All lines with their ends, the number of each one's text, and its ordinal there."""
    lines = pc.split_pattern(texts, "\n")
    flat, parent = pc.list_flatten(lines), pc.list_parent_indices(lines)
    count = pc.list_value_length(lines).cast(pa.int64())
    begin = pc.subtract(pc.cumulative_sum(count), count)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(begin, parent))
    last = pc.equal(ordinal, pc.subtract(pc.take(count, parent), 1))
    # What follows the last line feed is a line if it is not empty.
    real = pc.invert(pc.and_(last, pc.equal(pc.binary_length(flat), 0)))
    end = pc.if_else(last, pa.scalar("", flat.type), pa.scalar("\n", flat.type))
    flat = pc.binary_join_element_wise(flat, end, pa.scalar("", flat.type))
    return flat.filter(real), parent.filter(real), ordinal.filter(real)


def _joined(flat: pa.Array, parent: pa.Array, role: pa.Array, n: int) -> pa.Array:
    """The units of one role, as one string for each of ``n`` texts."""
    chosen, owner = flat.filter(role), parent.filter(role)
    held = pc.value_counts(owner)
    counts = pa.array(np.zeros(n, np.int64))
    if len(held):
        where = pc.is_in(pa.array(np.arange(n)), value_set=held.field("values"))
        counts = pc.replace_with_mask(counts, where, held.field("counts"))  # both in order
    ends = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)])
    return pc.binary_join(pa.LargeListArray.from_arrays(ends, chosen), pa.scalar("", flat.type))


def transformed(texts: pa.Array, h: list[pa.Array], rate: int, spm: int) -> dict[str, pa.Array]:
    """``n, form, prefix_chars, middle_chars, output`` of a batch of texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(texts)
    flat, parent, ordinal = _units(texts)
    n = pa.array(np.zeros(rows, np.int64))
    held = pc.value_counts(parent)
    if len(held):
        where = pc.is_in(pa.array(np.arange(rows)), value_set=held.field("values"))
        n = pc.replace_with_mask(n, where, held.field("counts"))
    places = pc.add(n, 1)
    one, two = _modulo(h[0], places), _modulo(h[1], places)
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    a, b = pc.take(low, parent), pc.take(high, parent)
    before, within = pc.less(ordinal, a), pc.and_(pc.greater_equal(ordinal, a), pc.less(ordinal, b))
    prefix = _joined(flat, parent, before, rows)
    middle = _joined(flat, parent, within, rows)
    suffix = _joined(flat, parent, pc.greater_equal(ordinal, b), rows)

    plain = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.greater_equal(_modulo(h[2], 100), rate))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, mark))
    form = pc.if_else(plain, PLAIN, pc.if_else(pc.less(_modulo(h[3], 100), spm), SPM, PSM))

    def marked(*parts: tuple[str, pa.Array]) -> pa.Array:
        return pc.binary_join_element_wise(*[x for part in parts for x in part], pa.scalar("", texts.type))

    p, s, m = (pa.scalar(mark, texts.type) for mark in (PREFIX, SUFFIX, MIDDLE))
    output = pc.if_else(
        pc.equal(form, SPM),
        marked((s, suffix), (p, prefix), (m, middle)),
        marked((p, prefix), (s, suffix), (m, middle)),
    )
    none = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": form,
        "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix)),
        "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle)),
        "output": pc.if_else(plain, texts, output),
    }


def _transform(rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = transformed(batch.column(1), [batch.column(i) for i in range(2, 6)], rate, spm)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.values()], ["id", *found])

    return run


def fill_in_middle(
    docs: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    seed: str = "7",
    rate: int = 100,
    spm: int = 50,
) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` for each row.

    Of 100 texts, ``rate`` are transformed, and of 100 of those, ``spm`` have the suffix
    first. ``n`` is the number of lines; the characters are null for plain texts.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col(id).cast("long").alias("id"),
        F.col(text).cast("string").alias("text"),
        *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(id).cast("long"), seed, 4), 1)],
    )
    found = rows.mapInArrow(
        _transform(rate, spm), "id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )
    return found.withColumnRenamed("id", id)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of, by its marks and form."""
    parts = F.split(output, MARK, -1)
    return (
        F.when(form == PSM, F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == SPM, F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )
