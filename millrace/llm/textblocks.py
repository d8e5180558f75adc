"""Words of a whole Arrow batch of texts as flat numpy arrays.

Inside tasks, after Spark has dealt the rows. Words become 64-bit numbers: a
polynomial over their bytes, each byte replaced by a random number, then mixed. Two
given words share a number with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SEGMENT = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 3)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: All but the ASCII letters and the bytes of other alphabets.
NO_LETTER = np.ones(256, bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def flat_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts on end, and where each begins; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    hashes: np.ndarray  # of every word, in order
    first: np.ndarray  # per text, and one more: where its words begin
    start: np.ndarray  # byte where a word begins, and ends
    end: np.ndarray


def words(texts, split: np.ndarray = WHITE, lower: bool = True) -> Words:
    data, at = flat_bytes(texts)
    starts, ends, hashes = [], [], []
    a = 0
    while a < len(data):
        b = min(len(data), a + _SEGMENT)
        while b < len(data) and not split[data[b - 1]]:  # to the end of a word
            step = data[b : b + 4096]
            gap = np.flatnonzero(split[step])
            b += int(gap[0]) + 1 if len(gap) else len(step)
        piece = data[a:b]
        inside = ~split[piece]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a
        cuts = cuts[cuts < len(piece)]
        begins[cuts] = inside[cuts]
        s = np.flatnonzero(begins)
        if len(s):
            letters = np.flatnonzero(inside)
            n = np.diff(np.append(np.searchsorted(letters, s), len(letters)))
            place = np.arange(len(letters)) - np.repeat(np.cumsum(n) - n, n)
            powers = np.cumprod(np.full(int(n.max()), _P, np.uint64))
            chars = piece[letters]
            values = _BYTES[LOWER[chars] if lower else chars] * powers[place]
            sums = np.add.reduceat(values, np.cumsum(n) - n)
            hashes.append(mixed(sums + n.astype(np.uint64)))
            starts.append(s + a)
            ends.append(s + a + n)
        a = b
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    return Words(
        np.concatenate(hashes) if hashes else none.astype(np.uint64),
        np.searchsorted(start, at),
        start,
        np.concatenate(ends) if ends else none,
    )


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A number for the ``k`` words from each word on; for fewer than ``k``, none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mixed(total)


def sequence_hash(hashes: np.ndarray, seed: int) -> np.uint64:
    """A number for a whole sequence of words, its length included."""
    powers = np.cumprod(np.full(len(hashes), np.uint64(seed | 1), np.uint64))
    total = (mixed(hashes ^ np.uint64(seed)) * powers).sum(dtype=np.uint64, keepdims=True)
    return mixed(total + np.uint64(len(hashes)))[0]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.table(batch)
        if not len(table):
            continue
        columns = [table[k].to_numpy() for k in keys]
        change = np.zeros(len(table), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change), len(table)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)
