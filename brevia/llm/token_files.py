"""Token ids of documents in ORC files, written in ascending doc_id order and read back with pruning.

ORC gives integer run-length encoding, stripes that are read in parallel, row indexes (minimum and maximum of each
``row_index_stride`` rows) and Bloom filters on doc_id.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._cache import Pieces, Slots
from ._ragged import BLANK, FOLD, SEGMENT, cuts, pieces, texts
from ._stage import place

#: Token ids that a worker keeps for words seen before (4 bytes each).
ARENA = 8_000_000

OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.compress": "ZSTD"}


LETTER, DIGIT, MARK = 1, 2, 3
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[BLANK] = 0
_CLASS[48:58] = DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_TAIL = np.zeros(256, bool)
_TAIL[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, whether it is one pre-token) of the pieces that are encoded on their own.

    A run of non-blank bytes is one piece, unless it holds only ASCII but ' and < (contractions, special strings) and the
    Latin-1 letters: then it falls into runs of letters, single digits and runs of marks, as the pre-tokenizer cuts it.
    """
    found = [], [], []
    for low, high in cuts(data, BLANK, offsets[1:]):
        part = data[low:high]
        kind = _CLASS[part]
        lead = part == 0xC3
        lead[:-1] &= _TAIL[part[1:]]
        lead[-1] = False
        tail = np.zeros(len(part), bool)
        tail[1:] = lead[:-1]
        kind[lead | tail] = LETTER
        odd = ((part >= 0x80) & ~lead & ~tail) | (part == 0x27) | (part == 0x3C)
        inner = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low
        first = np.empty(len(part), bool)
        first[0] = True
        first[1:] = kind[:-1] == 0
        first[inner] = True
        first &= kind > 0
        chunk = np.flatnonzero(first)
        if not len(chunk):
            continue
        if odd.any():
            strange = np.logical_or.reduceat(odd, chunk)
            size = np.diff(np.append(chunk, len(part)))
            plain = np.concatenate([np.zeros(chunk[0], bool), np.repeat(~strange, size)])
        else:
            plain = np.ones(len(part), bool)
        cut = np.zeros(len(part), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        start = np.flatnonzero(first | (cut & plain & (kind > 0)))
        ends = np.zeros(len(part) + 1, bool)
        ends[start] = True
        ends[1:-1] |= (kind[1:] == 0) & (kind[:-1] > 0)
        ends[-1] = True
        ends[inner] = True
        ends = np.flatnonzero(ends)
        found[0].append(start + low)
        found[1].append(ends[np.searchsorted(ends, start, "right")] + low)
        found[2].append(plain[start])
    if not found[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in found)


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes by which pieces are told apart: A-Z in lower case, but for those with a <, which may hold a special string."""
    out = FOLD[data]
    own = np.unique(np.searchsorted(starts, np.flatnonzero(data == 0x3C), "right") - 1)
    if len(own):
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[own]] += 1
        inside[ends[own]] -= 1
        same = np.cumsum(inside[:-1], dtype=np.int8) > 0
        out[same] = data[same]
    return out


class WordEncoder:
    """The tokenizers library over distinct pieces of text, which a bounded cache remembers.

    Right for tokenizers that lower the case, drop white space and cut words, digits and marks apart; then a text's ids are
    those of its ``units``, one after another. ``whole`` is set for any other file: its texts are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.slots = Slots(21, 2)
        self.arena, self.used = np.zeros(ARENA, np.int32), 0
        self.whole = self._joins_units()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _joins_units(self) -> bool:
        probe = ["The quick", "don't stop", "a  b", "x.\ny", "1 23", "it 's", " lead", "trail \t", "É è", "A.b9!?c", "mère12,", "THE(the)", "e\u0301t\u00e9"]
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids

        def joined(t: str) -> list[int]:
            data = np.frombuffer(t.encode(), np.uint8)
            starts, ends, _ = units(data, np.array([0, len(data)]))
            return [i for a, b in zip(starts, ends, strict=True) for i in ids(data[a:b].tobytes().decode())]

        return any(ids(t) != joined(t) for t in probe)

    def _ids(self, pieces: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, the number of each). Plain pieces go in one string: each ends with an end-of-word id."""
        if plain and self.ends.any():
            joined = [" ".join(pieces[k : k + 200]) for k in range(0, len(pieces), 200)]
            flat = np.fromiter((i for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids), np.int32)
            last = np.flatnonzero(self.ends[flat])
            if len(last) == len(pieces):
                return flat, np.diff(np.concatenate([[-1], last]))
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.array([len(x) for x in ids], np.int64)
        return np.fromiter((i for x in ids for i in x), np.int32, int(size.sum())), size

    def _found(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces into the arena: (place, size) of each."""
        places, sizes = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        for kind in (True, False):
            chosen = np.flatnonzero(plain == kind)
            for k in range(0, len(chosen), 4000):  # an Encoding is large; few at a time
                part = chosen[k : k + 4000]
                flat, size = self._ids([raw[a:b].decode() for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], kind)
                if self.used + len(flat) > len(self.arena):
                    self.arena = np.concatenate([self.arena[: self.used], np.zeros(max(len(flat), ARENA // 4), np.int32)])
                self.arena[self.used : self.used + len(flat)] = flat
                places[part], sizes[part] = self.used + np.cumsum(size) - size, size
                self.used += len(flat)
        return places, sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, the number of ids of each)."""
        if self.whole:
            found = [e.ids for e in self.tokenizer.encode_batch(column.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.int32), np.array([len(x) for x in found], np.int64)
        data, offsets = texts(column)
        starts, ends, plain = units(data, offsets)
        found = Pieces(_keys(data, starts, ends), starts, ends)
        at, hit = self.slots.get(found)
        begin, size = self.slots.values[0][at].astype(np.int64), self.slots.values[1][at].astype(np.int64)
        if not hit.all():
            miss = np.flatnonzero(~hit)
            which, back = found.distinct(miss)
            places, sizes = self._found(data.tobytes(), starts[which], ends[which], plain[which])
            self.slots.put(found, which, places, sizes)
            begin[miss], size[miss] = places[back], sizes[back]
        flat = np.repeat(begin - (np.cumsum(size) - size), size)
        flat += np.arange(len(flat))
        total = np.concatenate([[0], np.cumsum(size)])
        out = self.arena[flat], np.diff(total[np.searchsorted(starts, offsets)])
        if self.used > ARENA - ARENA // 8:
            self.slots.clear()
            self.arena, self.used = np.zeros(ARENA, np.int32), 0
        return out


_loaded: dict[str, WordEncoder] = {}


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 1) -> None:
    """Write doc_id, ids, n_ids, part and part_start (ids before the document in its part) to ORC files in ``out``.

    Rows are range-partitioned and sorted by (doc_id, text's hash); nulls come first, repeated rows stand side by side.
    A null or empty text has the end id alone. Ids of one document are one row, whatever its length.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded.get(path) or _loaded.setdefault(path, WordEncoder(path))
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, high in pieces(batch.column(1), SEGMENT):
                flat, sizes = encoder.encode(batch.column(1).slice(low, high - low))
                bounds = np.cumsum(sizes)
                flat = np.insert(flat, bounds, end_id)
                offsets = np.concatenate([[0], bounds + np.arange(1, len(sizes) + 1)])
                yield pa.record_batch({
                    "doc_id": batch.column(0).slice(low, high - low), "part": np.full(len(sizes), part, np.int32), "part_start": before + offsets[:-1], "n_ids": np.diff(offsets),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32))),
                })
                before += int(offsets[-1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id"), F.xxhash64("text").alias("_h")]
    ranged = docs.select("doc_id", "text", order[1]).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    ranged.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, part int, part_start long, n_ids long, ids array<int>").write.options(**OPTIONS).orc(out)


def read_tokens(spark: SparkSession, out: str, ids: Sequence[int] | None = None) -> DataFrame:
    """The rows of ``write_tokens``, of all documents or those with the doc_ids in ``ids``.

    A filter on doc_id skips files, stripes and row groups by their metadata: ranges first, then Bloom filters.
    """
    stored = spark.read.orc(out)
    return stored if ids is None else stored.where(F.col("doc_id").isin(*ids))


def token_digest(stored: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of little-endian 32-bit ids) from stored rows.

    Only the parts' totals, one row per file part from two small columns, are summed in order; no document row is gathered.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, bounds = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()  # offsets count from the start of values, whatever the slice
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.record_batch({"doc_id": batch.column(0), "part": batch.column(1), "part_start": batch.column(2), "n_tokens": np.diff(bounds).astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})

    kind = stored.schema["doc_id"].dataType.simpleString()
    totals = stored.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("n"))
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    rows = stored.select("doc_id", "part", "part_start", "ids").mapInArrow(check, f"doc_id {kind}, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int = 1, out: str | None = None) -> DataFrame:
    """Write the files (by default in the shared folder) and return their digest, read back from them."""
    spark = docs.sparkSession
    out = out or place(spark, "tokens")
    write_tokens(docs, out, path, end_id)
    return token_digest(read_tokens(spark, out))
