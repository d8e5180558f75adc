"""Quality rules: fixed rules on words and lines, then a ratio of two multinomials.

The texts are bags of hashed n-grams, here words and pairs of words. One multinomial is
counted over trusted texts, one over all texts. A text's score is the mean over its
n-grams of the logarithm of the two probabilities' ratio: above zero it reads more like
the trusted texts than like the corpus. A text is kept if the rules hold and its score
is at least the threshold; no chance is involved.

Both counts are sums over all rows, and have as many rows as there are hash buckets; the
table of ratios, of that fixed size, is all that reaches the driver. Everything is a
DataFrame expression.

Only shares count: the prior is a share of the trusted texts' n-grams (``PRIOR``), spread as
in all texts, so a table that is repeated any number of times gives the same verdicts.

Results: a null or empty text has no words, fails the rules and is not kept. A very long text
is judged whole. Rows that repeat an id are judged and counted each. An empty table gives
an empty table; without trusted texts all ratios are one, so no text is refused by its
score.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, let, marked, stored

#: Hash buckets of the n-grams.
BUCKETS = 1 << 14
#: N-grams that the trusted texts are given, spread as in all texts, as a share of their own.
PRIOR = 0.1
#: The least mean log ratio of a text that is kept.
THRESHOLD = -0.08

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def words(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def _removed(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(word: Column) -> Column:
    """Words in windows of three that occur more than once in the array ``word``."""

    def covered(starts: Column) -> Column:
        # A window adds the words that the one before it does not hold.
        steps = F.transform(
            starts, lambda p, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), p - F.get(starts, i - 1)))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def doubled(ranked: Column) -> Column:
        again = F.filter(
            F.transform(
                ranked,
                lambda x, i: F.when(
                    (x["h"] == F.get(ranked, i - 1)["h"]) | (x["h"] == F.get(ranked, i + 1)["h"]), x["p"]
                ),
            ),
            lambda p: p.isNotNull(),
        )
        return let(F.sort_array(again), covered)

    def windows(hashes: Column) -> Column:
        unlike = F.size(F.array_distinct(hashes)) == F.size(hashes)
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(unlike, F.lit(0).cast("long")).otherwise(let(placed, doubled))

    three = F.transform(
        F.sequence(F.lit(0), F.size(word) - 3),
        lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)),
    )
    return F.when(F.size(word) < 3, F.lit(0).cast("long")).otherwise(let(three, windows))


def _base(text: Column, word: Column) -> dict[str, Column]:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: _removed(x, WHITE) > 0)
    return {
        "n_words": F.size(word).cast("long"),
        "word_chars": F.coalesce(_removed(text, WHITE), F.lit(0)).cast("long"),
        "n_symbols": F.coalesce(F.length(text) - _removed(text, SYMBOLS), F.lit(0)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(word),
    }


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.hash(*parts), F.lit(BUCKETS))


def _ngrams(word: Column) -> Column:
    ones = F.transform(word, lambda w: _bucket(w))
    pairs = F.transform(F.slice(word, F.lit(2), F.size(word)), lambda w, i: _bucket(F.get(word, i), w))
    return F.concat(ones, pairs)


def ratios(docs: DataFrame, trusted: DataFrame, *, id: str = "doc_id", text: str = "text") -> list[float]:
    """Per bucket the log of its probability in trusted texts over that in all texts."""
    keys = stored(trusted.select(F.col(id).cast("long").alias("id")).filter("id IS NOT NULL").distinct())
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    counts = (
        marked(rows, keys, "id", "good")
        .select("good", words(F.col("text")).alias("word"))
        .select("good", F.explode(_ngrams(F.col("word"))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count_if("good").alias("good"))
        .collect()  # BUCKETS rows at most
    )
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for row in counts:
        raw[row.bucket] = row.raw
        good[row.bucket] = row.good
    return log_ratios(raw, good)


def log_ratios(raw: list[int], good: list[int]) -> list[float]:
    """Of smoothed shares in ``good`` to shares in ``raw``; 0 where there is nothing."""
    all_raw, all_good = sum(raw), sum(good)
    if not all_good:
        return [0.0] * len(raw)
    share = [(r / all_raw, (g / all_good + PRIOR * r / all_raw) / (1 + PRIOR)) for r, g in zip(raw, good, strict=True)]
    return [math.log(g / r) if r else 0.0 for r, g in share]


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc`` (the row), the base counts, ``base_failed``, ``score`` and ``kept``.

    ``trusted`` holds the ids of the trusted texts. ``score`` is null for a text
    without words; such texts fail the rules.
    """
    table = F.from_json(F.lit(json.dumps(ratios(docs, trusted, id=id, text=text))), "array<double>")
    # One expression from text to verdict, so that no rewriting of the plan can move it
    # apart and split a text more than once.
    def counts(word: Column) -> Column:
        score = F.aggregate(_ngrams(word), F.lit(0.0), lambda a, b: a + F.get(table, b))
        base = _base(body, word) | {"score": score / (2 * F.size(word) - 1)}
        return F.struct(*[c.alias(n) for n, c in base.items()])

    def judged(c: Column) -> Column:
        failed = (c["n_words"] < FEWEST_WORDS) | (
            100 * c["n_repeat_words"] > MOST_REPEATED_PERCENT * c["n_words"]
        )
        kept = ~failed & F.coalesce(c["score"] >= threshold, F.lit(False))
        return F.struct(c.alias("c"), failed.alias("base_failed"), kept.alias("kept"))

    # A row is carried whole, so that its columns cannot clash with those made here.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    body = F.col("doc")[text].cast("string")
    found = let(words(body), lambda word: let(counts(word), judged))
    return held.withColumn("found", found).select("doc", "found.c.*", "found.base_failed", "found.kept")
