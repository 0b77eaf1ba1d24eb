"""Quality classifier: histogram gradient-boosted trees over document statistics, trained here in numpy.

The trees are flattened into arrays (feature, cut, leaf value by heap position), so scoring is a few vectorised steps
over all documents of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import held_out
from ._ragged import BLANK, SEGMENT, grams, per_text, pieces, ragged, texts, words
from ._stage import saved

NEW_LINE = 10
_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256), "blank": [0x20, *range(9, 14)], "stop": b".!?",
    "comma": b",;:", "mark": b"!", "hash": b"#$%&*", "bar": b"|<>{}[]()=+/\\_~^@", "quote": b"\"'`-",
}
_KIND_OF = np.stack([np.isin(np.arange(256), list(v)) for v in _KINDS.values()])
FEATURES = [
    "log_bytes", "log_words", *_KINDS, "mean_word", "sd_word", "long_words", "short_words", "distinct_words", "top_word", "distinct_pairs", "same_as_next",
    "log_lines", "mean_line", "short_lines", "distinct_lines", "marked_words", "capital_words", "shouted_words",
]


def _spread(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n)


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, count of the most frequent value) per owner."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    begin = np.flatnonzero(first)
    most = np.zeros(n)
    np.maximum.at(most, o[begin], np.diff(np.append(begin, len(h))))
    return np.bincount(o[begin], minlength=n).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """The ``FEATURES`` of every whole text, as float32 (texts, features); null and empty texts are all zeros."""
    out = [np.zeros((0, len(FEATURES)), np.float32)]
    for low, high in pieces(column, SEGMENT):
        n = high - low
        data, offsets = texts(column.slice(low, n))
        size = np.diff(offsets).astype(float)
        kinds = np.zeros((len(_KINDS), n))
        full = np.flatnonzero(size)
        if len(full):
            for k, member in enumerate(_KIND_OF):
                kinds[k, full] = np.add.reduceat(member[data], offsets[:-1][full], dtype=np.int64)
        hashes, starts, ends = words(data, offsets)
        bounds = per_text(starts, offsets)
        count = np.diff(bounds).astype(float)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        length = (ends - starts).astype(float)
        some, many = np.maximum(count, 1), np.maximum(size, 1)
        mean = _spread(length, owner, n) / some
        sd = np.sqrt(np.maximum(_spread(length * length, owner, n) / some - mean**2, 0))
        distinct, top = _distinct(hashes, owner, n)
        pairs, pair_bounds = grams(hashes, bounds, 2)
        pair_owner = np.repeat(np.arange(n), np.diff(pair_bounds))
        distinct_pairs, _ = _distinct(pairs, pair_owner, n)
        same = np.zeros(len(hashes))
        same[:-1] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        head = data[starts] if len(starts) else np.zeros(0, np.uint8)
        second = data[np.minimum(starts + 1, ends - 1)] if len(starts) else head
        tail = data[ends - 1] if len(ends) else head
        upper = _KIND_OF[0]
        marked = ~(_KIND_OF[0] | _KIND_OF[1] | _KIND_OF[2] | _KIND_OF[3] | np.isin(np.arange(256), list(b".,"))) & ~BLANK
        lines, line_owner, line_size = _lines(data, offsets)
        line_count = np.bincount(line_owner, minlength=n).astype(float)
        rows = np.maximum(line_count, 1)
        distinct_lines, _ = _distinct(lines, line_owner, n)
        found = [
            np.log1p(size), np.log1p(count), *(kinds / many), mean, sd, _spread(length > 12, owner, n) / some, _spread(length < 3, owner, n) / some, distinct / some, top / some,
            distinct_pairs / np.maximum(np.diff(pair_bounds), 1), _spread(same, owner, n) / some, np.log1p(line_count), _spread(line_size, line_owner, n) / rows,
            _spread(line_size < 40, line_owner, n) / rows, distinct_lines / rows, _spread(marked[tail], owner, n) / some,
            _spread(upper[head], owner, n) / some, _spread(upper[head] & upper[second] & (length > 1), owner, n) / some,
        ]
        out.append(np.stack(found, 1).astype(np.float32))
    return np.concatenate(out)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, bytes) of every line that is not empty."""
    spaced = np.where(data == NEW_LINE, np.uint8(0x20), np.where(BLANK[data], np.uint8(0), data))
    hashes, starts, ends = words(spaced, offsets)
    return hashes, np.searchsorted(offsets, starts, "right") - 1, (ends - starts).astype(float)


@dataclass
class Trees:
    """``depth``-level trees: inner node i of tree t tests feature[t, i] > cut[t, i]; its children are 2i + 1 and 2i + 2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        rows, depth = np.arange(len(x)), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boost logistic loss on quantile histograms. Without both labels it gives a constant: the share of label 1 (0.5 without rows)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner, n_features = 2**depth - 1, x.shape[1]
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(n_features)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    flat = binned + np.arange(n_features) * bins
    raw = np.full(len(y), base)
    made = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            spot = (((at - first) * n_features * bins)[:, None] + flat).ravel()
            shape = (width, n_features, bins)
            g = np.bincount(spot, np.repeat(grad, n_features), np.prod(shape)).reshape(shape).cumsum(2)
            h = np.bincount(spot, np.repeat(hess, n_features), np.prod(shape)).reshape(shape).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(h < least) | (ht - h < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            j, b = best // bins, best % bins
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            for k in np.flatnonzero(good):
                if b[k] < len(cuts[j[k]]):
                    feature[first + k], cut[first + k] = j[k], cuts[j[k]][b[k]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        at -= inner
        leaf = rate * np.bincount(at, grad, inner + 1) / (np.bincount(at, hess, inner + 1) + ridge)
        raw += leaf[at]
        for store, value in zip(made, (feature, cut, leaf), strict=True):
            store.append(value)
    return Trees(*(np.stack(m) for m in made), base)


def _measured(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, quality, text) with features in place of the text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "quality": batch.column(1), "features": ragged(list(statistics(batch.column(2))), pa.float32())})

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "quality")}
    return rows.mapInArrow(measure, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, features array<float>")


def learn(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Trees:
    """Fit on at most ``most`` labelled ids of the learning split (smallest hashes of doc_id first) and twice as many rows.

    The chosen ids are broadcast (their number is the bound), so only labelled texts are measured and none is shuffled.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", "quality").distinct()
    chosen = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most), "quality-chosen")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = _measured(rows).orderBy(F.xxhash64("doc_id"), "doc_id", "quality", F.xxhash64("features")).limit(2 * most).toArrow()
    x = rows.column("features").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, rows.column("quality").to_numpy().astype(float))


def quality(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier quality 1) and predicted (score >= 0.5) of every row.

    Each whole text is measured and scored in one pass without a shuffle, by trees that ``learn`` fits on at most ``most``
    labelled ids (a documented bound) outside the held-out third. labels, lang, source and doc_id never enter a score.
    Null and empty texts have zero statistics and a score like any; repeated rows repeat; a doc_id with both labels counts
    for both; without labels every score is 0.5. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, most))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.score(statistics(batch.column(1)))
            yield pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(2), "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(judge, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> DataFrame:
    """The rows of docs, all columns, whose text scores 0.5 or more; each row is judged by its own text, whatever its id."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, most))
    text = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.score(statistics(batch.column(text))) >= 0.5))

    return docs.mapInArrow(judge, docs.schema)
