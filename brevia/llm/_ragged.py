"""Ragged text kernels: many texts of one Arrow batch as one byte buffer.

Words are maximal runs of bytes other than the ASCII blanks 0x20 and 0x09-0x0D.
Their hashes are sums of mixed 8-byte blocks, each keyed by its place, so no
regular pattern of letters makes two words collide. All work is vectorised, and
temporaries stay near ``SEGMENT`` bytes times forty whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes with A-Z in lower case.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Masks of the first k bytes of a block of eight.
_FIRST = np.array([256**k - 1 for k in range(9)], np.uint64)


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, as one number each; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of every byte range: its first eight blocks one after another, what is left of a longer one as a keyed sum."""
    view, size = blocks(data), ends - starts
    out = mix((view[starts] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * U64(_BASE))
    at, more = 8, np.flatnonzero(size > 8)
    while len(more) and at < 64:
        block = view[starts[more] + at] & _FIRST[np.minimum(size[more] - at, 8)]
        out[more] = mix(out[more] * U64(_BASE) + block)
        at += 8
        more = more[size[more] > at]
    if len(more):
        left = size[more] - at
        count = (left + 7) >> 3
        first = np.cumsum(count) - count
        place = np.arange(first[-1] + count[-1]) - np.repeat(first, count)
        block = view[np.repeat(starts[more] + at, count) + 8 * place] & _FIRST[np.minimum(np.repeat(left, count) - 8 * place, 8)]
        out[more] = mix(out[more] * U64(_BASE) + np.add.reduceat(mix(block ^ mix(place.astype(np.uint64), 91)), first))
    return out


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ranges of more than 8 * k bytes, their block k) for k from 0: all bytes of a range of up to 8 * count."""
    view, size = blocks(data), ends - starts
    out, which = [], np.arange(len(starts))
    for k in range(count):
        which = which[size[which] > 8 * k]
        out.append((which, view[starts[which] + 8 * k] & _FIRST[np.minimum(size[which] - 8 * k, 8)]))
    return out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different seeds give unrelated orders."""
    x = x ^ U64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % 2**64)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9), (32, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(31)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def pieces(column: pa.Array, most: int = 4 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer text stands alone)."""
    _, offsets = texts(column)
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, end
        start = end


def cuts(data: np.ndarray, blank: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``SEGMENT`` that never cut a word: they end behind a blank or a text."""
    start = 0
    while start < len(data):
        end = start + SEGMENT
        if end >= len(data):
            end = len(data)
        else:
            near = int(edges[np.searchsorted(edges, end)])
            while end < near and not blank[data[end - 1]]:
                stop = min(near, end + 65536)
                hit = np.flatnonzero(blank[data[end:stop]])
                end = end + int(hit[0]) + 1 if len(hit) else stop
        yield start, end
        start = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, A-Z in lower case; a word never crosses a text's edge."""
    hashes, starts, ends = [], [], []
    edges = offsets[1:]
    for low, high in cuts(data, BLANK, edges):
        part = data[low:high]
        gap = BLANK[part]
        first = np.empty(len(part), bool)
        first[0] = True
        first[1:] = gap[:-1]
        last = np.empty(len(part), bool)
        last[-1] = True
        last[:-1] = gap[1:]
        inner = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low
        first[inner] = True
        last[inner[inner > 0] - 1] = True
        first &= ~gap
        last &= ~gap
        start = np.flatnonzero(first)
        if not len(start):
            continue
        end = np.flatnonzero(last) + 1
        hashes.append(hashes_of(FOLD[part], start, end))
        starts.append(start + low)
        ends.append(end + low)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For words sorted by start: the position of each text's first word, and the total behind."""
    return np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds) of every run of ``size`` words of each text; a shorter text is one run."""
    count = np.diff(bounds)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_bounds = np.concatenate([[0], np.cumsum(runs)])
    if not len(hashes):
        return np.zeros(0, np.uint64), out_bounds
    owner = np.repeat(np.arange(len(count)), runs)
    at = np.arange(out_bounds[-1]) - out_bounds[owner] + bounds[owner]
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    left = bounds[owner + 1] - at
    short = bool((count < size).any())
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        term = padded[at + k] * U64(pow(_BASE, 3 * k + 1, 2**64)) + U64(k + 1)
        total += np.where(left > k, term, U64(0)) if short else term
    return mix(total, 5), out_bounds


def sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct ``size``-word runs of each text, as 64-bit hashes."""
    out: list[np.ndarray] = []
    for low, high in pieces(column):
        data, offsets = texts(column.slice(low, high - low))
        hashes, starts, _ = words(data, offsets)
        runs, bounds = grams(hashes, per_text(starts, offsets), size)
        out += [np.unique(runs[bounds[i] : bounds[i + 1]]) for i in range(high - low)]
    return out


def ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of numpy rows."""
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))
