"""Ranked lexical search: documents grouped by which of an item's terms they hold.

Terms are runs of ASCII letters and digits and of all other characters, A-Z lower-cased.
A document's score for an item sums, over the item's terms, the term's weight times a
factor that grows with its occurrences and falls with the document's length. All of it
is whole numbers but the logarithm in the weight.

1. Every text is read once, whole. A task keeps, per document, its number of terms and
   those that some item has, with their occurrences; that is stored.
2. Spark counts over what was stored: documents, terms, and the documents of each term.
   They give the weights.
3. The stored documents are searched in blocks, in tasks. A term's documents in a block
   are the bits of a bitmap. For an item, the bits of its terms are laid side by side,
   so that each document has a mask, and documents with one mask form a group.
   No document of a group can score more than the weights of the mask's terms, each
   times the term's largest factor in the block. Groups are scored by descending bound,
   and the search of an item ends when the bound of the next group is below the score of
   its last place. Documents that no group's bound rules out are all scored.
4. Each block gives its best for each item; Spark merges them.

Items are dealt by hash to blocks of about ``ITEM_TERMS`` terms, so what tasks are sent does
not grow with their number; all documents are searched for each block of items.

Results: a null text has no term. Rows without an id count in all statistics, but are
not ranked; items without an id have no result, nor have those without terms. Rows of
items that repeat an id make one item of their texts' terms. Documents that repeat an
id are ranked each. Long texts are read whole; a batch holds 16 MB, or one text. Without
documents, or without items, the result is empty. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import textblocks as tb
from millrace.llm.common import prepare, stored

#: Bytes that end a term: all ASCII but digits and letters.
NO_TERM = np.ones(256, bool)
NO_TERM[48:58] = NO_TERM[65:91] = NO_TERM[97:123] = NO_TERM[128:] = False

#: Items' terms that are searched for at once.
ITEM_TERMS = 200_000
#: Documents in a block of the search, and terms of theirs that items have; the first to be
#: reached ends a block, with the batch that reaches it.
BLOCK = 1 << 15
POSTINGS = 1 << 21

# Fixed values of the score: percents of the length's part, and the factor's terms.
LENGTH_PERCENT = 90
SCALE, OFTEN, LONG = 1_000_000_000, 1000, 8


def weight(n: int, df: np.ndarray) -> np.ndarray:
    """Of terms that ``df`` of ``n`` documents hold."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def measure(terms: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """The length of documents of so many ``terms``, 100 for the mean one."""
    return 100 - LENGTH_PERCENT + (LENGTH_PERCENT * terms * documents) // max(1, all_terms)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = tb.words(batch.column(1), split=NO_TERM)
        row = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(w.hashes.view(np.int64))], ["item", "term"]
        )


def _postings(wanted):
    """Per document its number of terms, and places in ``wanted`` with occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for batch in batches:
            w = tb.words(batch.column(1), split=NO_TERM)
            row = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
            term = w.hashes.view(np.int64)
            at = np.searchsorted(known, term)
            hit = known[np.minimum(at, len(known) - 1)] == term if len(known) else np.zeros(len(term), bool)
            pair, times = np.unique((row[hit] << 32) | at[hit], return_counts=True)
            ends = np.searchsorted(pair >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(w.first).astype(np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array((pair & 0xFFFFFFFF).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                ],
                ["id", "n", "terms", "times"],
            )

    return run


@dataclass
class Search:
    """What a task needs: per item its terms' places, each with its weight."""

    items: np.ndarray
    terms: list[np.ndarray]
    weights: np.ndarray
    documents: int
    all_terms: int
    k: int


def _groups(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``masks`` [document, word] in groups of equal ones: the order that
    brings them together, and where each group begins."""
    order = np.lexsort(masks.T)
    new = np.ones(len(order), bool)
    new[1:] = (masks[order[1:]] != masks[order[:-1]]).any(axis=1)
    return order, np.flatnonzero(new)


class Block:
    """Some documents, as one column of postings by term."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray):
        by = np.argsort(term, kind="stable")
        self.ids, self.m = ids, m
        self.row, self.term, self.times = row[by], term[by], times[by]
        self.factor = (SCALE * self.times) // (OFTEN * self.times + LONG * m[self.row])

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of the k best documents for an item, their scores, and how many documents
        had to be scored."""
        a, b = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        there = (b > a) & (weights > 0)
        a, b, weights = a[there], b[there], weights[there]
        none = np.zeros(0, np.int64)
        if not len(a):
            return none, none, 0
        masks = np.zeros((len(self.ids), -(-len(a) // 64)), np.uint64)
        most = np.empty(len(a), np.int64)
        for j, (lo, hi) in enumerate(zip(a, b, strict=True)):
            masks[self.row[lo:hi], j // 64] |= np.uint64(1 << (j % 64))
            most[j] = weights[j] * self.factor[lo:hi].max()
        held = np.flatnonzero(masks.any(axis=1))
        order, first = _groups(masks[held])
        order = held[order]
        last = np.append(first[1:], len(order))
        distinct = masks[order[first]]
        bound = np.zeros(len(first), np.int64)
        for j in range(len(a)):
            bound += most[j] * ((distinct[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)

        by_bound = np.argsort(-bound, kind="stable")
        slot = np.full(len(self.ids), -1, np.int64)
        places, scores, done, scored = none, none, 0, 0
        step = 1
        while done < len(by_bound):
            if len(scores) == k and bound[by_bound[done]] < scores[-1]:
                break
            # As many groups as hold a few documents; what they add to is looked up at once.
            upto, n = done, 0
            while upto < len(by_bound) and n < step * k:
                if len(scores) == k and bound[by_bound[upto]] < scores[-1]:
                    break
                n += last[by_bound[upto]] - first[by_bound[upto]]
                upto += 1
            new = np.concatenate([order[first[g] : last[g]] for g in by_bound[done:upto]])
            slot[new] = np.arange(len(new))
            sums = np.zeros(len(new), np.int64)
            for j, (lo, hi) in enumerate(zip(a, b, strict=True)):
                if len(new) * 8 < hi - lo:  # few documents: look them up in the term's rows
                    rows = np.sort(new)
                    at = np.searchsorted(self.row[lo:hi], rows)
                    at = lo + np.minimum(at, hi - lo - 1)
                    at = at[self.row[at] == rows]
                else:
                    at = lo + np.flatnonzero(slot[self.row[lo:hi]] >= 0)
                np.add.at(sums, slot[self.row[at]], weights[j] * self.factor[at])
            slot[new] = -1
            scored += len(new)
            places, scores = np.append(places, new), np.append(scores, sums)
            top = np.lexsort((self.ids[places], -scores))[:k]
            places, scores = places[top], scores[top]
            done, step = upto, step * 4
        real = scores > 0
        return places[real], scores[real], scored


def _search(search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = search.value
        held: list[pa.RecordBatch] = []
        documents = postings = 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            terms, times = (table[c].combine_chunks() for c in ("terms", "times"))
            lengths = terms.value_lengths().to_numpy()
            here = Block(
                table["id"].to_numpy(),
                measure(table["n"].to_numpy(), s.documents, s.all_terms),
                np.repeat(np.arange(len(table)), lengths),
                terms.flatten().to_numpy(),
                times.flatten().to_numpy().astype(np.int64),
            )
            item, found, score = [], [], []
            for i, own in zip(s.items, s.terms, strict=True):
                places, scores, _ = here.best(own, s.weights[own], s.k)
                item.append(np.full(len(places), i))
                found.append(here.ids[places])
                score.append(scores)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (item, found, score)], ["item", "id", "score"]
            )

        for batch in batches if len(s.items) else ():
            if not batch.num_rows:
                continue
            held.append(batch)
            documents += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if documents >= BLOCK or postings >= POSTINGS:
                yield block()
                held, documents, postings = [], 0, 0
        if held:
            yield block()

    return run


def _search_block(rows: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``item, id, score``: the best of each block of documents, for a block of items."""
    spark = rows.sparkSession
    pairs = items.toArrow()  # about ITEM_TERMS rows
    item, term = pairs["item"].to_numpy(), pairs["term"].to_numpy()
    known, place = np.unique(term, return_inverse=True)
    counted = stored(
        rows.mapInArrow(
            _postings(spark.sparkContext.broadcast(known)), "id long, n long, terms array<int>, times array<int>"
        )
    )
    total = counted.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(known), np.int64)
    for row in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many as terms
        df[row.t] = row["count"]
    order = np.argsort(item, kind="stable")
    ids, first = np.unique(item[order], return_index=True)
    search = Search(
        ids, [np.sort(x) for x in np.split(place[order], first[1:])], weight(total[0], df), total[0], total[1] or 0, k
    )
    ranked = counted.filter(F.col("id").isNotNull() & (F.size("terms") > 0)).select("id", "n", "terms", "times")
    return ranked.mapInArrow(_search(spark.sparkContext.broadcast(search)), "item long, id long, score long")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    k: int = 10,
) -> DataFrame:
    """``item, rank, id, score``: for each item its k documents of highest score.

    Scores are above 0; equal ones are ranked by ascending id.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    terms = stored(
        asked.filter("item IS NOT NULL").mapInArrow(_item_terms, "item long, term long").distinct()
    )
    blocks = max(1, math.ceil(terms.count() / ITEM_TERMS))
    dealt = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        here = _search_block(rows, dealt.filter(F.col("block") == b).select("item", "term"), k)
        found = here if found is None else found.unionByName(here)
    best = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")
    )
