"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of all hashes.

Two sketches are cut by the same threshold whatever the sizes of their documents, so the part of a small document that a
large one holds can be told from the sketches alone, and the sketch of a union is the union of sketches. Small sets, of
which too few hashes would be left, keep their LEAST smallest ones as well; a sketch says up to which hash it is whole, and
two sketches are compared up to the lower of both.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._ragged import SEGMENT, pieces, sets

#: Hashes have 48 bits; a sketch keeps those below an eighth, and the 64 smallest at least.
BITS, SHARE, LEAST = 48, 8, 64
WHOLE = 1 << BITS
SHINGLE = 5


@dataclass(frozen=True)
class Sketch:
    """The sorted distinct hashes of a set that are below ``cut``; all its hashes if cut is WHOLE."""

    cut: int
    hashes: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray) -> Sketch:
        """The sketch of a set, given its sorted distinct 64-bit hashes."""
        return Sketch(WHOLE, np.unique(hashes >> np.uint64(64 - BITS)).astype(np.int64)).trimmed()

    def trimmed(self) -> Sketch:
        keep = max(int(np.searchsorted(self.hashes, WHOLE // SHARE)), LEAST)
        if keep >= len(self.hashes):
            return self
        return Sketch(min(self.cut, WHOLE // SHARE if keep > LEAST else int(self.hashes[keep])), self.hashes[:keep])

    def merged(self, other: Sketch) -> Sketch:
        """The sketch of the union of both sets."""
        cut = min(self.cut, other.cut)
        both = np.union1d(self.hashes, other.hashes)
        return Sketch(cut, both[both < cut]).trimmed()

    def against(self, other: Sketch) -> tuple[float, float, float]:
        """Estimates of (part of this set in the other, part of the other in this, intersection over union); two empty sets are equal."""
        cut = min(self.cut, other.cut)
        a, b = self.hashes[: np.searchsorted(self.hashes, cut)], other.hashes[: np.searchsorted(other.hashes, cut)]
        if not len(a) or not len(b):
            same = float(not len(self.hashes) and not len(other.hashes))
            return same, same, same
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / len(a), both / len(b), both / (len(a) + len(b) - both)

    def __str__(self) -> str:
        raw = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
        return f"{self.cut:x}." + base64.b64encode(raw.tobytes()).decode()

    @staticmethod
    def read(text: str) -> Sketch:
        cut, _, raw = text.partition(".")
        wide = np.zeros((len(raw) // 8, 8), np.uint8)
        wide[:, 2:] = np.frombuffer(base64.b64decode(raw), np.uint8).reshape(-1, 6)
        return Sketch(int(cut, 16), wide.view(">u8").reshape(-1).astype(np.int64))


def sketches(column: pa.Array) -> list[Sketch]:
    """The sketch of each text's distinct 5-word shingles (A-Z in lower case; with fewer words the whole sequence is one)."""
    out: list[Sketch] = []
    for low, high in pieces(column, SEGMENT):
        out += map(Sketch.of, sets(column.slice(low, high - low), SHINGLE))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (text form of the sketch) of every row, in one pass without a shuffle.

    Null, empty and blank texts have the empty set's sketch; repeated rows and null ids come out as they came in.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "fingerprint": pa.array(map(str, sketches(batch.column(1))), pa.string())})

    return docs.select("doc_id", "text").mapInArrow(sketch, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def merged(prints: DataFrame, by: str) -> DataFrame:
    """(by, fingerprint) of each group of rows: the sketch of the union of their sets.

    Sketches are merged inside each input partition first, and what is left, one sketch a group and partition, by group.
    A merged sketch holds an eighth of the group's distinct shingles. Null fingerprints add nothing.
    """
    kind = prints.schema[by].dataType.simpleString()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = Sketch.read(text)
                held[key] = held[key].merged(new) if key in held else new
            if sum(len(x.hashes) for x in held.values()) > 1 << 22:
                yield written(held)
                held = {}
        yield written(held)

    def written(held: dict) -> pa.RecordBatch:
        return pa.record_batch({by: pa.array(list(held), batch_kind), "fingerprint": pa.array(map(str, held.values()), pa.string())})

    batch_kind = pa.schema(_arrow(prints.select(by))).field(0).type
    part = prints.where("fingerprint is not null").select(by, "fingerprint").mapInArrow(merge, f"`{by}` {kind}, fingerprint string")
    return part.repartition(by).sortWithinPartitions(by).mapInArrow(merge, f"`{by}` {kind}, fingerprint string")


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, last: rows in the order of (doc_id, text), nulls first, each partition with the first row behind it.

    Partition k of the result holds the k-th range of ids, sorted; the row behind it, with ``last`` true, comes at its end
    (behind all rows: the first). Ranges are cut at quantiles of the ids, which are ids themselves, one for each shuffle
    partition, so the row behind a range is known by its id alone; texts are shuffled once.
    """
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("doc_id").cast("long")
    quantiles = F.percentile_approx(key, [k / count for k in range(count)], F.lit(max(10_000, 20 * count)))
    least, cuts, gaps = docs.agg(F.min(key), quantiles, F.count_if(key.isNull())).first()
    edges = np.array([] if least is None else sorted({least, *cuts}), np.int64)

    @F.pandas_udf("array<int>")
    def places(ids):
        ids = ids.to_numpy(np.int64)
        at = np.maximum(np.searchsorted(edges, ids, "right") - 1, 0)
        first = (at > 0) & (edges[at] == ids) if len(edges) else at > 0
        return ids_series([[k, k - 1] if f else [k] for k, f in zip(at.tolist(), first.tolist(), strict=True)])

    from pandas import Series as ids_series

    text = F.coalesce("text", F.lit("")).alias("text")
    own = F.coalesce(key, F.lit(-(2**63)))
    rows = docs.select("doc_id", text, F.posexplode(places(own)).alias("last", "part")).withColumn("last", F.col("last") == 1)
    top = docs.where(key.isNull() if gaps else key == (least or 0)).select("doc_id", text)
    top = top.groupBy("doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.lit(True).alias("last"), F.lit(max(len(edges) - 1, 0)).alias("part"))
    return rows.unionByName(top).repartitionById(max(len(edges), 1), "part").select("doc_id", "text", "last").sortWithinPartitions("last", "doc_id", "text")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the row whose next one hasn't come yet
    for batch in batches:
        for low, high in pieces(batch.column(1), 2 * SEGMENT):
            part = batch.slice(low, high - low)
            rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), sketches(part.column(1)), strict=True))
            rows = [held, *rows] if held else rows
            pairs = [(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True) if not a[2]]
            held = rows[-1]
            if not pairs:
                continue
            edited = [a[1][: len(a[1]) - len(a[1]) // 4] + b[1][: len(a[1]) // 4] for a, b in pairs]
            marks = sketches(pa.array(edited, pa.large_string()))
            to_edited, to_next = [a[3].against(m) for (a, _), m in zip(pairs, marks, strict=True)], [a[3].against(b[3]) for a, b in pairs]
            yield pa.record_batch({
                "doc_id": pa.array([a[0] for a, _ in pairs], part.schema.field(0).type), "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()), "edited": pa.array(edited, pa.string()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited], "fingerprint": [str(a[3]) for a, _ in pairs], "edited_fingerprint": [str(m) for m in marks],
                "near_edited": [max(x[:2]) for x in to_edited], "near_next": [max(x[:2]) for x in to_next], "jaccard_edited": [x[2] for x in to_edited], "jaccard_next": [x[2] for x in to_next],
            })


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each row's sketch, its edited text and that text's sketch, and how near both and the next row's sketch are.

    Rows are ordered by doc_id, nulls first, and rows of one id by their texts; behind the last comes the first, and a lone
    row follows itself. The edited text has the last quarter of its characters (rounded down) replaced by as many first ones
    of the next row's text. ``near_*`` is the larger of both estimated containments, ``jaccard_*`` the estimated Jaccard
    similarity. A null text counts as empty: its sketch is that of the empty set, equal to its like (1) and to nothing else
    (0). A sketch that shares no part of the hash range with the other, because a few-word text has no hash below the cut of
    a long one, is estimated as 0. Rows that repeat stay as many. Other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited string, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"
    return in_order(docs).mapInArrow(_compare, schema)
