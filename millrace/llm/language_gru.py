"""Language of texts by a bidirectional gated recurrent network over bytes.

A text's bytes are cut in windows of ``WINDOW``. Two gated recurrent layers run through
each window, one from either end; the two states at a byte give the probabilities of the
languages there. So every byte of a text is labelled, and the mean over all of them is
the text's: its largest is the prediction, and the score. Gates and states use
x / (1 + |x|), which rises as the usual functions do at a fraction of their cost.

The network is trained in numpy, by backpropagation through time, on ``PIECES`` windows
of each of some ``MOST_ROWS`` labelled rows: of each language, as many as its part of that
number, those with the smallest hashes of their ids, and ``FEWEST`` at least, so that a
language that is rare in the table is still learned. The windows lie at places that a hash
of the id chooses, anywhere in the text. Languages are trained on equally often. All texts are then
labelled whole, in tasks, in batches of windows.

Results: a text that is null or has no letter is ``und`` with score 0. Without labelled
rows all are ``und``. A very long text is labelled whole, window by window. Rows that repeat
an id are predicted each; an id with several languages teaches the first in order, on one of
its texts. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import textblocks as tb
from millrace.llm.common import by_keys, prepare, stored
from millrace.llm.toxicity_fm import held_out

WINDOW = 64
STATES = 8
#: Labelled rows that the network is trained on, of all languages, those of one language at
#: least, and windows of each row.
MOST_ROWS = 4_000
FEWEST = 50
PIECES = 3
#: Languages whose table of sizes is broadcast, once counted.
BROADCAST_LANGUAGES = 10_000
STEPS = 300
BATCH = 128
RATE = 0.02
#: Windows that run side by side.
SIDE = 1024

UNKNOWN = "und"


def _bend(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.abs(x)) ** 2


class Network:
    """Parameters by name: per direction ``byte`` [256, 3H] and ``state`` [H, 3H], then
    ``out`` [2H, L] and ``bias`` [L]. The three parts are update, reset and candidate."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {}
        for d in ("fore", "back"):
            self.p[f"{d}_byte"] = 0.3 * rng.standard_normal((256, 3 * STATES))
            self.p[f"{d}_state"] = rng.standard_normal((STATES, 3 * STATES)) / np.sqrt(STATES)
        self.p["out"] = rng.standard_normal((2 * STATES, len(languages))) / np.sqrt(STATES)
        self.p["bias"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, windows: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States [time, window, H]; ``windows`` is [time, window]."""
        byte, state = self.p[f"{d}_byte"], self.p[f"{d}_state"]
        h = np.zeros((windows.shape[1], STATES), np.float32)
        states = np.empty((*windows.shape, STATES), np.float32)
        times = range(len(windows)) if d == "fore" else range(len(windows) - 1, -1, -1)
        for t in times:
            x, u = byte[windows[t]], h @ state
            gates = x[:, : 2 * STATES] + u[:, : 2 * STATES]
            z = 0.5 + 0.5 * _bend(gates[:, :STATES])
            r = 0.5 + 0.5 * _bend(gates[:, STATES:])
            a = x[:, 2 * STATES :] + r * u[:, 2 * STATES :]
            new = _bend(a)
            if keep is not None:
                keep.append((t, h, gates, z, r, u[:, 2 * STATES :], a, new))
            h = h + z * (new - h)
            states[t] = h
        return states

    def _joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Both directions as one layer of 2H states: what two bytes, one from either
        end, add to the parts, and the states' matrix, halves folded in."""
        n = STATES
        table = np.zeros((256, 256, 6 * n), np.float32)
        state = np.zeros((2 * n, 6 * n), np.float32)
        for at, d in enumerate(("fore", "back")):
            for part in range(3):
                to = slice((2 * part + at) * n, (2 * part + at + 1) * n)
                column = self.p[f"{d}_byte"][:, part * n : (part + 1) * n]
                table[:, :, to] = column[:, None] if at == 0 else column[None, :]
                half = 0.5 if part == 2 else 1.0
                state[at * n : (at + 1) * n, to] = half * self.p[f"{d}_state"][:, part * n : (part + 1) * n]
        return table.reshape(-1, 6 * n), state

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """[time, window, L] of ``windows`` [time, window]."""
        if not hasattr(self, "_layer"):
            self._layer = self._joined()
        table, state = self._layer
        n, (times, side) = STATES, windows.shape
        pair = (windows.astype(np.int64) << 8) | windows[::-1]
        both = np.empty((times, side, 2 * n), np.float32)
        h = np.zeros((side, 2 * n), np.float32)
        x, u = np.empty((side, 6 * n), np.float32), np.empty((side, 6 * n), np.float32)
        gate, size = np.empty((side, 4 * n), np.float32), np.empty((side, 4 * n), np.float32)
        new, wide = np.empty((side, 2 * n), np.float32), np.empty((side, 2 * n), np.float32)
        for t in range(times):
            np.take(table, pair[t], axis=0, out=x)
            np.matmul(h, state, out=u)
            np.add(x[:, : 4 * n], u[:, : 4 * n], out=gate)
            np.abs(gate, out=size)
            size += 1
            gate /= size
            gate += 1  # twice the gates
            np.multiply(gate[:, 2 * n :], u[:, 4 * n :], out=new)
            new += x[:, 4 * n :]
            np.abs(new, out=wide)
            wide += 1
            new /= wide
            new -= h
            new *= gate[:, : 2 * n]
            new *= 0.5
            h += new
            both[t, :, :n] = h[:, :n]
            both[times - 1 - t, :, n:] = h[:, n:]
        logits = both.reshape(-1, 2 * n) @ self.p["out"] + self.p["bias"]
        np.exp(np.minimum(logits, 60), out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(times, side, -1)

    def gradients(self, windows: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss, and its slopes, of the language at every byte that is not padding."""
        kept: dict[str, list] = {"fore": [], "back": []}
        both = np.concatenate([self._run(windows, d, kept[d]) for d in kept], axis=2)
        logits = both @ self.p["out"] + self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        real = (windows != 0).astype(np.float32)
        total = max(1.0, float(real.sum()))
        loss = -float((np.log(p[:, np.arange(len(label)), label] + 1e-9) * real).sum()) / total
        p[:, np.arange(len(label)), label] -= 1
        p *= real[:, :, None] / total
        g = {
            "out": np.einsum("tws,twl->sl", both, p),
            "bias": p.sum(axis=(0, 1)),
        }
        down = p @ self.p["out"].T
        for at, d in enumerate(kept):
            state = self.p[f"{d}_state"]
            into = np.zeros((windows.shape[1], STATES), np.float32)
            g[f"{d}_state"] = np.zeros_like(state)
            g[f"{d}_byte"] = np.zeros_like(self.p[f"{d}_byte"])
            for t, h, gates, z, r, u, a, new in reversed(kept[d]):
                dh = into + down[t, :, at * STATES : (at + 1) * STATES]
                da = dh * z * _slope(a)
                dz = dh * (new - h) * 0.5 * _slope(gates[:, :STATES])
                dr = da * u * 0.5 * _slope(gates[:, STATES:])
                du = np.concatenate([dz, dr, da * r], axis=1)
                g[f"{d}_state"] += h.T @ du
                np.add.at(g[f"{d}_byte"], windows[t], np.concatenate([dz, dr, da], axis=1))
                into = dh * (1 - z) + du @ state.T
        return loss, g


def train(windows: np.ndarray, label: np.ndarray, languages: list[str]) -> Network:
    """Adam on batches of ``windows`` [n, time] with the places of their languages."""
    network = Network(languages)
    rng = np.random.default_rng(11)
    of = [np.flatnonzero(label == i) for i in range(len(languages))]
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    for step in range(1, STEPS + 1):
        # A language is drawn first, then a window of it.
        pick = np.array([of[i][int(len(of[i]) * u)] for i, u in zip(
            rng.integers(0, len(languages), BATCH), rng.random(BATCH), strict=True
        )])
        _, g = network.gradients(np.ascontiguousarray(windows[pick].T), label[pick])
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, (m, v) in state.items():
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            network.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return network


def pooled(network: Network, texts) -> np.ndarray:
    """Mean probabilities [text, L] over all bytes of each text."""
    data, at = tb.flat_bytes(texts)
    ends = np.cumsum(-(-np.diff(at) // WINDOW))  # of each text's windows
    total = np.zeros((len(at) - 1, len(network.languages)))
    for a in range(0, int(ends[-1]) if len(ends) else 0, SIDE):
        number = np.arange(a, min(a + SIDE, int(ends[-1])))
        row = np.searchsorted(ends, number, "right")
        start = at[row + 1] - (ends[row] - number) * WINDOW
        place = start[:, None] + np.arange(WINDOW)
        real = place >= at[row][:, None]  # the first window may be shorter
        windows = np.where(real, data[np.maximum(place, 0)], 0)
        p = network.probabilities(np.ascontiguousarray(windows.T))
        np.add.at(total, row, np.einsum("twl,wt->wl", p, (windows != 0).astype(np.float32)))
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def _predict(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        names = np.array(net.languages)
        for batch in batches:
            p = pooled(net, batch.column(1))
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(np.clip(p[np.arange(len(p)), best], 0, 1)),
                ],
                ["id", "letters", "lang_pred", "score"],
            )

    return run


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows at hashed places of each text."""
    for batch in batches:
        data, at = tb.flat_bytes(batch.column(1))
        ids = batch.column(0).to_numpy().astype(np.uint64)
        row, windows = [], []
        for i in range(batch.num_rows):
            own = data[at[i] : at[i + 1]]
            draws = tb.mixed(ids[i : i + 1] * np.uint64(PIECES) + np.arange(PIECES, dtype=np.uint64))
            for a in (draws % np.uint64(max(1, len(own) - WINDOW + 1))).astype(np.int64):
                piece = np.zeros(WINDOW, np.uint8)
                piece[: len(own[a : a + WINDOW])] = own[a : a + WINDOW]
                row.append(i)
                windows.append(piece.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int64())), pa.array(windows, pa.binary())], ["id", "window"]
        )


def languages(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``id, held_out, lang_pred, score`` for each row.

    Nothing is learned from held-out ids, nor from rows without an id or language, and a
    null text teaches nothing; ids and languages are no input of a prediction.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(
        F.col(id).cast("long").alias("id"),
        F.col(text).cast("string").alias("text"),
        F.col(lang).cast("string").alias("lang"),
    )
    labelled = stored(  # ids and languages only; no text is read
        rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out("id", 4, 2))
        .groupBy("id")
        .agg(F.min("lang").alias("lang"))
    )
    sizes = stored(labelled.groupBy("lang").agg(F.count("*").alias("size")))
    n = sizes.count()
    quota = max(FEWEST, MOST_ROWS // max(1, n))
    # Rows that a hash of the id lets through, some four times as many as are wanted of each
    # language; so the rows that are ranked do not grow with the table.
    sizes = F.broadcast(sizes) if n <= BROADCAST_LANGUAGES else sizes
    drawn = labelled.join(sizes, "lang").filter(
        F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double") * F.col("size") < float(4 * quota * (1 << 30))
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id"))
    known = stored(drawn.withColumn("nth", nth).filter(F.col("nth") <= quota).select("id", "lang"))
    # One text of each id, so that an id that many rows repeat is still one.
    texts = by_keys(rows.select("id", "text"), known.select("id"), "id", "left_semi").groupBy("id").agg(
        F.min("text").alias("text")
    )
    sample = texts.mapInArrow(_samples, "id long, window binary")
    gathered = sample.join(known, "id").orderBy("id", "window").select("window", "lang").collect()
    names = sorted({r.lang for r in gathered})
    out = [F.col("id").alias(id), held_out("id", 4, 2).alias("held_out")]
    if not names:
        return rows.select(*out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    windows = np.frombuffer(b"".join(r.window for r in gathered), np.uint8).reshape(-1, WINDOW)
    label = np.array([names.index(r.lang) for r in gathered])
    network = spark.sparkContext.broadcast(train(windows, label, names))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return (
        rows.select("id", "text", letters)
        .mapInArrow(_predict(network), "id long, letters boolean, lang_pred string, score double")
        .select(
            *out,
            F.when(F.col("letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
            F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
        )
    )
