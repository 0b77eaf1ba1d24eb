"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

Texts are read as rows of ``STEPS`` bytes side by side, so that a recurrence step is one small matrix product over
thousands of rows. The network labels every byte position; a document's probabilities are the mean over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._labels import held_out
from ._ragged import pieces, texts
from ._stage import saved

STEPS = 64
HIDDEN = 8
#: Rows of one forward pass.
ROWS = 8192


@dataclass
class Network:
    """Per direction d: byte inputs x[d] (256, 3H) with the bias inside, recurrence w[d] (H, 3H); output (2H, labels)."""

    labels: list[str]
    x: list[np.ndarray]
    w: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.x, *self.w, self.out, self.bias]


def fresh(labels: list[str], seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(labels, [draw(256, 3 * HIDDEN, scale=0.3) for _ in range(2)], [draw(HIDDEN, 3 * HIDDEN, scale=0.3) for _ in range(2)], draw(2 * HIDDEN, len(labels), scale=0.3), np.zeros(len(labels), np.float32))


def _direction(rows: np.ndarray, x: np.ndarray, w: np.ndarray, keep: bool):
    """Hidden states (steps, rows, H) of one direction; with keep also the gates. rows: bytes (steps, rows), in the order of reading.

    h' = h + z * (tanh(a + r * (h W)) - h); sigmoids are written as tanh of half the argument.
    """
    steps, n = rows.shape
    h = np.zeros((n, HIDDEN), np.float32)
    states = np.empty((steps, n, HIDDEN), np.float32)
    gates = []
    for t in range(steps):
        a = x[rows[t]]
        u = h @ w
        g = a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
        g *= 0.5
        np.tanh(g, out=g)
        g += 1
        g *= 0.5
        z, r = g[:, :HIDDEN], g[:, HIDDEN:]
        un = u[:, 2 * HIDDEN :]
        c = r * un
        c += a[:, 2 * HIDDEN :]
        np.tanh(c, out=c)
        if keep:
            gates.append((h, z, r, un, c))
        h = h + z * (c - h)
        states[t] = h
    return states, gates


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def positions(net: Network, rows: np.ndarray) -> np.ndarray:
    """Label probabilities (steps, rows, labels) of every position of byte rows (rows, steps)."""
    ahead = rows.T
    forward, _ = _direction(ahead, net.x[0], net.w[0], False)
    backward, _ = _direction(ahead[::-1], net.x[1], net.w[1], False)
    logits = forward @ net.out[:HIDDEN]
    logits += backward[::-1] @ net.out[HIDDEN:]
    logits += net.bias
    return _softmax(logits)


def gradients(net: Network, rows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions, and its gradients by backpropagation through time."""
    ahead = rows.T
    steps, n = ahead.shape
    f, fg = _direction(ahead, net.x[0], net.w[0], True)
    b, bg = _direction(ahead[::-1], net.x[1], net.w[1], True)
    both = np.concatenate([f, b[::-1]], 2)
    p = _softmax(both @ net.out + net.bias)
    loss = float(-np.log(p[:, np.arange(n), target] + 1e-9).mean())
    p[:, np.arange(n), target] -= 1
    p /= steps * n
    d_out = both.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, p.shape[2])
    d_both = p @ net.out.T
    found = []
    for order, gates, w, d_states in ((ahead, fg, net.w[0], d_both[:, :, :HIDDEN]), (ahead[::-1], bg, net.w[1], d_both[::-1, :, HIDDEN:])):
        dx, dw, dh = np.zeros((256, 3 * HIDDEN), np.float32), np.zeros_like(w), np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, un, c = gates[t]
            dh = dh + d_states[t]
            dc = dh * z * (1 - c * c)
            dz = dh * (c - h) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            da = np.concatenate([dz, dr, dc], 1)
            du = np.concatenate([dz, dr, dc * r], 1)
            dw += h.T @ du
            one = np.zeros((n, 256), np.float32)
            one[np.arange(n), order[t]] = 1
            dx += one.T @ da
            dh = dh * (1 - z) + du @ w.T
        found.append((dx, dw))
    return loss, [found[0][0], found[1][0], found[0][1], found[1][1], d_out, p.sum((0, 1))]


def rows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte rows of STEPS padded with 0, owner, number of bytes) of texts that follow each other in data."""
    size = np.diff(offsets)
    count = -(-size // STEPS)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[:-1][owner] + nth * STEPS
    length = np.minimum(STEPS, size[owner] - nth * STEPS)
    at = begin[:, None] + np.arange(STEPS)
    rows = np.concatenate([data, np.zeros(STEPS, np.uint8)])[np.minimum(at, len(data))]
    rows[np.arange(STEPS) >= length[:, None]] = 0
    return rows, owner, length


def fit(samples: list[tuple[str, str]], epochs: int = 3, steps: int = 600, rate: float = 0.02, batch: int = 256, seed: int = 7) -> Network:
    """Train on (text, label) pairs with Adam, at least ``epochs`` times over every byte and at least ``steps`` updates. Without samples: one label, und."""
    labels = sorted({label for _, label in samples}) or ["und"]
    net = fresh(labels, seed)
    column = pa.array([t for t, _ in samples], pa.large_string())
    rows, owner, _ = rows_of(*texts(column)) if samples else (np.zeros((0, STEPS), np.uint8), np.zeros(0, np.int64), None)
    target = np.array([labels.index(label) for _, label in samples], np.int64)[owner] if len(owner) else owner
    rng, values = np.random.default_rng(seed), net.parameters()
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    each = max(1, -(-len(rows) // batch))
    epochs = max(epochs, -(-steps // each)) if len(labels) > 1 else 0
    total = max(1, epochs * each)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            _, found = gradients(net, rows[take], target[take])
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in found))
            scale = min(1.0, 1.0 / (size + 1e-9))
            pace = rate * (1 - 0.9 * step / total)
            for v, g, m, s in zip(values, found, first, second, strict=True):
                g = g * scale
                m += 0.1 * (g - m)
                s += 0.005 * (g * g - s)
                v -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.995**step)) + 1e-7)).astype(np.float32)
    return net


def pooled(net: Network, column: pa.Array) -> np.ndarray:
    """Mean label probabilities (texts, labels) over all byte positions of each text; zeros for an empty one."""
    out = [np.zeros((0, len(net.labels)))]
    for low, high in pieces(column, ROWS * STEPS):
        data, offsets = texts(column.slice(low, high - low))
        sums = np.zeros((high - low, len(net.labels)))
        size = np.diff(offsets)
        if len(data):
            # rows are cut in slices so that one very long text takes no more memory than many short ones
            for start in range(0, len(data), 4 * ROWS * STEPS):
                stop = min(len(data), start + 4 * ROWS * STEPS)
                inner = np.clip(offsets, start, stop)
                rows, owner, length = rows_of(data[start:stop], inner - start)
                for k in range(0, len(rows), ROWS):
                    p = positions(net, rows[k : k + ROWS])
                    p[np.arange(STEPS)[:, None] >= length[None, k : k + ROWS]] = 0
                    part = p.sum(0, dtype=np.float64)
                    for j in range(part.shape[1]):
                        sums[:, j] += np.bincount(owner[k : k + ROWS], part[:, j], high - low)
        out.append(sums / np.maximum(size, 1)[:, None])
    return np.concatenate(out)


def spread(text: str, most: int) -> str:
    """A text of at most ``most`` bytes: the whole, or pieces of ``STEPS`` bytes from evenly spread places."""
    data = text.encode()
    if len(data) <= most:
        return text
    places = np.linspace(0, len(data) - STEPS, most // STEPS).astype(int)
    return " ".join(data[a : a + STEPS].decode(errors="ignore") for a in places)[:most]


def training_sample(docs: DataFrame, per_label: int = 120, total: int = 12_000, most: int = 20_000) -> list[tuple[str, str]]:
    """At most ``per_label`` texts of each language of the learning split, chosen by a hash of id and language.

    Documented bounds of what the driver holds: ``total`` texts in all (languages share them, each has one at least) of
    ``most`` bytes each; a longer text gives evenly spread pieces, so no language is left out for its lengths. Ids are ranked
    without texts (a partial limit per task comes before the shuffle); texts of the chosen follow. A repeated (doc_id, lang)
    counts once.
    """
    known = docs.where("lang is not null and text <> '' and doc_id is not null").where(~held_out()).select("doc_id", "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "lang"), "doc_id")
    ranked = saved(known.select("doc_id", "lang").withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= per_label).distinct(), "language-ranked")
    share = max(1, min(per_label, total // max(1, ranked.select("lang").distinct().count())))
    rows = known.join(F.broadcast(ranked.where(F.col("place") <= share).select("doc_id", "lang")), ["doc_id", "lang"], "left_semi")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "lang": batch.column(1), "text": pa.array([spread(t, most) for t in batch.column(2).to_pylist()], pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    short = rows.mapInArrow(shorten, f"doc_id {kind}, lang string, text string").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return sorted((r["text"], r["lang"]) for r in short.collect())


def identify(docs: DataFrame, per_label: int = 120) -> DataFrame:
    """doc_id, held_out, lang_pred and score (probability of lang_pred) of every row.

    Learns from text and lang of at most ``per_label`` documents a language outside the held-out third (a documented
    bound); lang, source and doc_id never enter a prediction. Null texts and texts without a letter are ``und`` with
    score 0. Prediction is one pass without a shuffle over whole texts; repeated rows repeat, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training_sample(docs, per_label)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            column = batch.column(1)
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
            p = pooled(net, column)
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            score = np.where(lettered, p[np.arange(len(p)), best], 0.0)
            names = np.array([*net.labels, "und"], object)
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pa.array(names[np.where(lettered, best, len(net.labels))], pa.string()), "score": np.clip(score, 0, 1)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
