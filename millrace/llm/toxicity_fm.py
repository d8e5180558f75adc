"""Toxicity of texts by a factorization machine over hashed terms.

A text is the set of its words, runs of letters, and of their beginnings of ``STEM``
bytes, lower-cased (A-Z) and hashed to ``BUCKETS`` terms. The score is logistic in a
constant, a weight per term and the inner product of the factors of every two terms that
occur together, so that a pair can count for more, or less, than its parts.

Every term that two sampled texts hold has a weight; none is chosen by how it stands to
the labels on its own. Weights are fitted all at once by follow-the-regularised-leader:
a weight leaves zero if, given all others, its term departs by ``CLEAR`` deviations from
what chance gives. In the same passes the factors of terms that ``HELD`` texts hold are
fitted by gradient steps; they are centred, so that long texts are not pairs of
everything, weigh less the rarer a term is, and decay unless pairs sustain them. At last
the weights that are not zero are fitted again without the penalty, which shrinks them.

The machine is fitted in numpy on at most ``MOST_ROWS`` labelled rows with at most
``MOST_TERMS`` terms together, those with the smallest hashes of their ids. Their terms are
gathered in tasks. All texts are then scored whole in tasks, with the fitted numbers,
whose size is fixed.

Results: a null or empty text has no term and gets the score of none. A very long text
is the set of its terms, ``BUCKETS`` at most. Rows that repeat an id are scored each; one
of their texts, the first in order, is learned from, with the largest of their labels.
Without labelled rows of both kinds, every score is 1 or 0, as the labels say, and 0
without any. An empty table gives an empty table. Labels of other values than 0 and 1,
and nulls, are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textblocks as tb
from millrace.llm.common import by_keys, prepare, stored

BUCKETS = 1 << 18
STEM = 5
#: Labelled rows that the machine is fitted on, and terms of theirs, at most.
MOST_ROWS = 20_000
MOST_TERMS = 4_000_000
#: Texts that hold a term which has factors, at least, and the share of texts from which
#: its factors count in full.
HELD, OFTEN = 5, 0.05
FACTORS = 4
PASSES, BATCH = 15, 256
#: Passes before factors are fitted; they then explain what weights do not.
WEIGHTS_FIRST = 5
#: Standard deviations by which a term with a weight departs from chance, at least.
CLEAR = 3.0
RATE_WEIGHTS, RATE_FACTORS, DECAY_FACTORS = 5.0, 0.5, 0.1
#: What all pairs of a text can add to its logit.
MOST_PAIRS = 10.0
#: Steps of the last fit, and their size.
LAST_STEPS, LAST_RATE, DECAY_WEIGHTS = 300, 0.05, 2e-5
THRESHOLD = 0.7


def _terms(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each text on end, and where each text's begin."""
    w = tb.words(texts, split=tb.NO_LETTER)
    row = np.repeat(np.arange(len(texts)), np.diff(w.first))
    data, _ = tb.flat_bytes(texts)
    long = w.end - w.start > STEM
    stem = np.ones(int(long.sum()), np.uint64)
    for j in range(STEM):
        stem = (stem << np.uint64(8)) | tb.LOWER[data[w.start[long] + j]].astype(np.uint64)
    terms = np.concatenate([w.hashes, tb.mixed(stem)]) % np.uint64(BUCKETS)
    pair = np.unique((np.append(row, row[long]) << 18) | terms.astype(np.int64))
    return pair & (BUCKETS - 1), np.searchsorted(pair >> 18, np.arange(len(texts) + 1))


def pair_sums(values: np.ndarray, row: np.ndarray, n: int, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of factors per text, less ``mean``, and the inner products of all its pairs.

    ``values`` holds the factors of the terms of all texts on end, ``row`` their texts.
    """
    sums = np.stack([np.bincount(row, values[:, f], n) for f in range(values.shape[1])], axis=1) - mean
    return sums, ((sums**2).sum(axis=1) - np.bincount(row, (values**2).sum(axis=1), n)) / 2


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


@dataclass
class Machine:
    constant: float
    weights: np.ndarray  # per bucket
    factors: np.ndarray  # per bucket
    mean: np.ndarray  # the factors' sum in the mean text

    def logits(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        row = np.repeat(np.arange(n), np.diff(first))
        _, pairs = pair_sums(self.factors[terms], row, n, self.mean)
        return self.constant + np.bincount(row, self.weights[terms], n) + np.clip(pairs, -MOST_PAIRS, MOST_PAIRS)

    def scores(self, terms: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _chance(self.logits(terms, first))


def factor_slopes(values: np.ndarray, row: np.ndarray, sums: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Slopes of the loss along each of ``values``, given its slopes along logits."""
    return error[row][:, None] * (sums[row] - values)


def fit(terms: np.ndarray, first: np.ndarray, label: np.ndarray) -> Machine:
    n = len(label)
    rate = label.mean() if n else 0.0
    none = np.zeros(FACTORS)
    if rate in (0.0, 1.0):
        constant = -40.0 if rate == 0.0 else 40.0
        return Machine(constant, np.zeros(BUCKETS), np.zeros((BUCKETS, FACTORS)), none)
    held = np.bincount(terms, minlength=BUCKETS)
    # Each term's column is given length one, so that all weights face the same chance.
    unit = np.where(held >= 2, 1 / np.sqrt(np.maximum(held, 1)), 0.0)
    penalty = CLEAR * np.sqrt(rate * (1 - rate))
    paired = np.flatnonzero(held >= HELD)
    weigh = np.where(held >= HELD, np.minimum(1.0, held / n / OFTEN), 0.0)[:, None]
    usual = (weigh[paired] * held[paired, None]) / n

    rng = np.random.default_rng(3)
    constant = float(np.log(rate / (1 - rate)))
    weights, pull, seen = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    factors = 0.05 * rng.standard_normal((BUCKETS, FACTORS))
    lengths = np.diff(first)
    for turn in range(PASSES):
        for part in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            size = lengths[part]
            at = np.repeat(first[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            row, (here, place) = np.repeat(np.arange(len(part)), size), np.unique(terms[at], return_inverse=True)
            own = weigh[here] * factors[here]
            values = own[place]
            sums, pairs = pair_sums(values, row, len(part), (usual * factors[paired]).sum(axis=0))
            logit = constant + np.bincount(row, (weights[here] * unit[here])[place], len(part))
            error = _chance(logit + np.clip(pairs, -MOST_PAIRS, MOST_PAIRS)) - label[part]
            g = np.bincount(place, error[row], len(here)) * unit[here]
            step = (np.sqrt(seen[here] + g * g) - np.sqrt(seen[here])) / RATE_WEIGHTS
            pull[here] += g - step * weights[here]
            seen[here] += g * g
            beyond = np.abs(pull[here]) - penalty * (turn + 1)
            weights[here] = np.where(
                beyond > 0, -np.sign(pull[here]) * beyond / (np.sqrt(seen[here]) / RATE_WEIGHTS + 1e-3), 0.0
            )
            constant -= 0.05 * float(error.mean())
            if turn >= WEIGHTS_FIRST:
                slopes = factor_slopes(values, row, sums, error / len(part))
                slopes = np.stack([np.bincount(place, slopes[:, f], len(here)) for f in range(FACTORS)], axis=1)
                factors[here] -= RATE_FACTORS * np.clip(weigh[here] * slopes, -1, 1)
                factors[paired] *= 1 - RATE_FACTORS * DECAY_FACTORS
    mean = (usual * factors[paired]).sum(axis=0)
    machine = Machine(constant, np.zeros(BUCKETS), weigh * factors, mean)
    offset = machine.logits(terms, first)  # of the constant and all pairs

    kept = np.flatnonzero(weights)
    column = np.full(BUCKETS, -1)
    column[kept] = np.arange(len(kept))
    use = column[terms] >= 0
    row, column = np.repeat(np.arange(n), lengths)[use], column[terms[use]]
    p = np.append(weights[kept] * unit[kept], 0.0)  # the last moves the constant
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, LAST_STEPS + 1):
        error = (_chance(offset + p[-1] + np.bincount(row, p[column], n)) - label) / n
        g = np.append(np.bincount(column, error[row], len(kept)) + DECAY_WEIGHTS * p[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= LAST_RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    machine.weights[kept] = p[:-1]
    machine.constant += float(p[-1])
    return machine


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, first = _terms(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(first.astype(np.int32), terms.astype(np.int32))],
            ["id", "terms"],
        )


def _score(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = machine.value.scores(*_terms(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["id", "score"])

    return run


def held_out(id: str, parts: int, part: int) -> Column:
    """Whether a hash of the id puts a row in the part that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % parts == part, F.lit(False))


def toxicity(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """``id, held_out, score, predicted`` for each row.

    ``labels`` holds ``id`` and 0 or 1; those of held-out ids are not used.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(id, 3, 1))
        .groupBy(F.col(id).cast("long").alias("id"))
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(MOST_ROWS)
    )
    known = stored(known)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # One text of each id, so that an id that many rows repeat is still one.
    texts = by_keys(rows, known.select("id"), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    sample = stored(texts.mapInArrow(_gather, "id long, terms array<int>").join(known, "id"))
    order = [F.xxhash64("id"), F.col("id")]
    sizes = sample.select(F.size("terms").alias("n"), *order).orderBy(*order).select("n").toArrow()  # MOST_ROWS at most
    most = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), MOST_TERMS, "right"))
    gathered = sample.orderBy(*order).limit(most).select("terms", "label").toArrow()
    lists = gathered["terms"].combine_chunks()
    first = np.append(0, np.cumsum(lists.value_lengths().to_numpy())) if len(lists) else np.zeros(1, np.int64)
    terms = lists.flatten().to_numpy().astype(np.int64)
    machine = fit(terms, first, gathered["label"].to_numpy().astype(float))
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(machine)), "id long, score double")
    return scored.select(
        F.col("id").alias(id),
        held_out("id", 3, 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
