"""Periodic runs of words, found with bit-parallel lags.

The word ids of a text are held as bit planes: one big integer for each bit of the ids, with a bit for each word. XOR of a
plane and itself shifted by a lag q marks the words that differ from the word q later; OR over the planes marks all such
words, so a run of period q is a long stretch of zeros. AND of shifted copies, doubling the shift, leaves only stretches
that are long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run repeats its period at least four times and has at least six words.
TIMES, LEAST = 4, 6
#: In texts of more words, lags from LAG on are looked at only around words that already repeat at that lag.
WIDE, LAG = 4096, 64
#: Planes that are looked at first.
FIRST = 4


class Planes:
    """The bit planes of word ids, side by side in integers, so that one shift and one XOR serve several of them."""

    def __init__(self, ids: np.ndarray) -> None:
        self.n, count = len(ids), max(1, int(ids.max()).bit_length())
        self.ones = (1 << self.n) - 1
        rows = ((ids >> np.arange(count)[:, None]) & 1).astype(np.uint8)
        self.parts = [self._packed(rows[:FIRST]), *([self._packed(rows[FIRST:])] if count > FIRST else [])]

    def _packed(self, rows: np.ndarray) -> tuple[int, list[int]]:
        """(all planes in one integer, the shifts that lay halves of them over each other until one is left)."""
        folds, left = [], len(rows)
        while left > 1:
            left = (left + 1) // 2
            folds.append(left * self.n)
        return int.from_bytes(np.packbits(rows.reshape(-1), bitorder="little").tobytes(), "little"), folds

    def same(self, lag: int) -> int:
        """A bit for each word that equals the word ``lag`` later; 0 if no run of that period can be among them."""
        same = self.ones >> lag
        for bits, folds in self.parts:  # most lags fail by the first planes alone
            other = bits ^ (bits >> lag)  # a plane's last words get bits of the next plane: they have no partner and no bit in ``same``
            for fold in folds:
                other |= other >> fold
            same ^= other & same
            two = same & (same >> 1)
            if not two & (two >> lag) & (two >> 2 * lag):  # a run has two neighbours three times, a lag apart
                return 0
        return same


def _stretches(same: int, need: int) -> list[tuple[int, int]]:
    """(first, last start) of each group of places from which ``need`` bits in a row are set."""
    size = 1
    while size < need and same:
        step = min(size, need - size)
        same &= same >> step
        size += step
    if not same:
        return []
    bits = np.unpackbits(np.frombuffer(same.to_bytes((same.bit_length() >> 3) + 1, "little"), np.uint8), bitorder="little")
    edge = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


class Found:
    """The runs found so far, by their period; those of one period come with rising starts."""

    def __init__(self) -> None:
        self.by: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, lag: int, start: int, end: int) -> None:
        starts, ends = self.by.setdefault(lag, ([], []))
        starts.append(start)
        ends.append(end)

    def holds(self, lag: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which ranges of over three lags are inside a run whose period divides the lag: then it is their smallest period."""
        out = np.zeros(len(start), bool)
        for period, (starts, ends) in self.by.items():
            if lag % period == 0 and period < lag:
                at = np.searchsorted(starts, start, "right") - 1
                out |= (at >= 0) & (np.asarray(ends)[at] >= end)
        return out


def _windows(ids: np.ndarray, lag: int, found: Found) -> list[tuple[int, int]]:
    """Word ranges that hold every run of period ``lag``: such a run has words k, k + 1, k + 2 and k + 3 times lag, all equal."""
    every = ids[::lag]
    same = every[1:] == every[:-1]
    hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
    if len(hits):
        hits = hits[~found.holds(lag, hits * lag, (hits + 3) * lag + 1)]
    if not len(hits):
        return []
    gap = np.flatnonzero(np.diff(hits) > 5)  # windows that would overlap are one
    low, high = hits[np.concatenate([[0], gap + 1])], hits[np.concatenate([gap, [len(hits) - 1]])]
    return list(zip(np.maximum((low - 1) * lag, 0).tolist(), np.minimum((high + 5) * lag, len(ids)).tolist(), strict=True))


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of equal ids, by start, then period."""
    n, found = len(ids), Found()
    if n < LEAST:
        return []
    planes = Planes(ids)
    for lag in range(1, n // TIMES + 1):
        if n > WIDE and lag >= LAG:
            parts = [(low, Planes(ids[low:high]).same(lag)) for low, high in _windows(ids, lag, found)]
        else:
            parts = [(0, planes.same(lag))]
        for low, same in parts:
            if same:
                need = max(LEAST - lag, (TIMES - 1) * lag)
                spans = _stretches(same, need)
                if not spans:
                    continue
                start, end = np.array([low + first for first, _ in spans]), np.array([low + last + need + lag for _, last in spans])
                for k in np.flatnonzero(~found.holds(lag, start, end)).tolist():
                    found.add(lag, int(start[k]), int(end[k]))
    return sorted((s, e - s, p) for p, (starts, ends) in found.by.items() for s, e in zip(starts, ends, strict=True))


def analysed(text: bytes | None) -> tuple[list[tuple[int, int, int]], bytes]:
    """(runs, the text with each run cut to its first period, words joined by one space)."""
    words = (text or b"").split()  # at the ASCII blanks 0x20 and 0x09-0x0D
    seen: dict[bytes, int] = {}
    found = runs(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)))
    if found:
        dropped = np.zeros(len(words), bool)
        for start, length, period in found:
            dropped[start + period : start + length] = True
        words = [w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone]
    return found, b" ".join(words)


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, 500)
            found, kept = zip(*(analysed(t.as_py()) for t in part.column(1)), strict=True)
            listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in found], kind)
            yield pa.record_batch({"doc_id": part.column(0), "runs": listed, "collapsed": pa.array(kept, pa.binary())})


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start, length, period, all counted in words) and collapsed (text) of every row.

    A word is a maximal run of characters other than the ASCII blanks. A run is a stretch of consecutive words with smallest
    period q and at least max(6, 4 * q) words that no neighbouring word extends. ``collapsed`` has the words that no run
    holds after its first q, joined by one space. One pass without a shuffle: every row stands for itself, so repeated rows
    and ids, or null ids, come out as often as they came in. Null, empty and blank texts have no runs and an empty
    ``collapsed``. Work grows with words times lags in bits, memory with one text. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    return rows.mapInArrow(_analyse, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts (by the id's crc32) with a tail that repeats some words; the others as they are.

    Rows without an id, a text or a word are left alone.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), g.alias("_g"))
    n = F.size("_words")
    a = (F.col("_g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    block = F.slice("_words", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    edited = F.array_join(F.concat(F.slice("_words", F.lit(1), a), tail), " ")
    return chosen.select("doc_id", F.when(F.coalesce(n > 0, F.lit(False)), edited).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """One row per row of ``periodic_runs``: counts, the run with the greatest length / period, hashes of all runs and of the text."""
    ahead = lambda x, best: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", nothing, lambda best, x: F.when(ahead(x, best), x).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
