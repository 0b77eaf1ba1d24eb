"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

Batched pre-tokens are one flat symbol array with bounds. In each round every sequence merges its lowest-rank pair;
sequences without a known pair leave, and the symbols they still have are counted. Long sequences go rank by rank over
all of them, and only pairs beside a merge are ranked again.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cache import Pieces, Slots
from ._ragged import SEGMENT, pieces, texts

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Unicode's White_Space property (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Suffixes that stand apart behind an apostrophe (fixed values of the public pre-tokenizer pattern).
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
NONE = np.int32(2**31 - 1)
#: Sequences of more symbols are merged rank by rank.
LONG = 200


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


class Merges:
    """The merge table of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if model["type"] != "BPE" or spec.get("normalizer") or not plain or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens with strip rules are not supported")
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        vocab = model["vocab"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.first = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in column], np.int64) for column in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        keys = (left << 32) | right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made] = np.arange(len(made))
        #: Every symbol has one merge that makes it, older than any merge that uses it: then no new pair can come before
        #: the pair that is being merged, and all its places can be merged in one round.
        self.ordered = len(np.unique(made)) == len(made) and bool((born[left] < np.arange(len(made))).all() and (born[right] < np.arange(len(made))).all())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is no merge."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def counts(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of symbols that each byte sequence ends with; sequences follow each other in data."""
        long = (lengths > LONG) & self.ordered
        if not long.any():
            return self._in_rounds(data, lengths)
        out, inside = np.zeros(len(lengths), np.int64), np.repeat(long, lengths)
        out[long] = self._by_rank(data[inside], lengths[long])
        out[~long] = self._in_rounds(data[~inside], lengths[~long])
        return out

    def _by_rank(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """``counts`` where a new pair never ranks before the merge that made it: each rank is applied once, everywhere.

        ``waiting`` has the places of each rank still to come, and a heap their order; a merge ranks anew only the pair
        that begins with it and the pair before it. So work grows with merges, not with rounds times symbols.
        """
        n, stops = len(data), np.cumsum(lengths)
        symbols = np.append(self.first[data], np.int32(-1))
        after, before = np.arange(1, n + 1), np.arange(-1, n)
        after[stops - 1], before[stops - lengths] = n, -1
        rank = self.rank(symbols[:-1], symbols[after])
        gone = np.zeros(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(spot: np.ndarray) -> None:
            found = rank[spot]
            spot = spot[found != NONE]
            if len(spot) == 0:
                return
            found = rank[spot]
            order = np.argsort(found, kind="stable")
            spot, found = spot[order], found[order]
            cut = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(spot)]
            for a, b, r in zip(cut[:-1], cut[1:], found[cut[:-1]].tolist(), strict=True):
                if r in waiting:
                    waiting[r].append(spot[a:b])
                else:
                    waiting[r] = [spot[a:b]]
                    heappush(ranks, r)

        wait(np.arange(n))
        heapify(ranks)
        while ranks:
            low = heappop(ranks)
            spot = waiting.pop(low)
            spot = spot[0] if len(spot) == 1 else np.unique(np.concatenate(spot))
            spot = spot[rank[spot] == low]
            if len(spot) > 1:  # of overlapping places (one symbol repeated) every second, from the left
                spot = np.sort(spot)
                run = np.cumsum(np.concatenate([[True], after[spot[:-1]] != spot[1:]])) - 1
                spot = spot[(np.arange(len(spot)) - np.searchsorted(run, run)) % 2 == 0]
            if not len(spot):
                continue
            right = after[spot]
            far = after[right]
            symbols[spot], after[spot], gone[right] = self.made[low], far, True
            rank[right] = NONE
            before[far[far < n]] = spot[far < n]
            near = before[spot]
            near = np.unique(np.concatenate([spot, near[near >= 0]]))
            rank[near] = self.rank(symbols[near], symbols[after[near]])
            wait(near)
        return lengths - np.add.reduceat(gone, stops - lengths, dtype=np.int64)

    def _in_rounds(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = lengths.astype(np.int64)
        live, sizes, symbols = np.arange(len(lengths)), out.copy(), self.first[data]
        while len(live):
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(live)), sizes)
            rank = np.empty(len(symbols), np.int32)
            rank[:-1] = self.rank(symbols[:-1], symbols[1:])
            rank[starts + sizes - 1] = NONE
            low = np.minimum.reduceat(rank, starts)
            spot = np.flatnonzero((rank == low[owner]) & (rank != NONE))
            if self.ordered:  # of overlapping places (one symbol repeated) every second, from the left
                run = np.cumsum(np.concatenate([[True], np.diff(spot) != 1])) - 1 if len(spot) else spot
                spot = spot[(spot - spot[np.searchsorted(run, run)]) % 2 == 0] if len(spot) else spot
            else:
                spot = spot[np.concatenate([[True], owner[spot[1:]] != owner[spot[:-1]]])] if len(spot) else spot
            symbols[spot] = self.made[rank[spot]]
            keep = np.ones(len(symbols), bool)
            keep[spot + 1] = False
            sizes = sizes - np.bincount(owner[spot], minlength=len(live))
            out[live] = sizes
            on = low != NONE
            keep &= on[owner]
            symbols, live, sizes = symbols[keep], live[on], sizes[on]
        return out


def pretoken_starts(points: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. points: code points of several texts; edges: where each text starts (non-empty texts)."""
    kind = classes()[points]
    text_start = np.zeros(len(points) + 1, bool)
    text_start[edges] = True
    text_start[-1] = True
    begins = text_start[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begins)
    after = np.append(run[1:], len(points))
    is_space = kind[run] == SPACE
    inner = is_space & ~text_start[after]
    glued = np.zeros(len(run), bool)
    glued[1:] = ~is_space[1:] & ~text_start[run[1:]] & (points[run[1:] - 1] == 0x20)
    starts = begins
    starts[run[glued]] = False
    starts[after[inner] - 1] = True
    quote = np.flatnonzero((points[run] == 0x27) & (after - run == 1) & ~glued & ~text_start[after])
    quote = quote[kind[np.minimum(after[quote], len(points) - 1)] == LETTER] if len(quote) else quote
    if len(quote):
        at, end = after[quote], after[quote + 1]
        one, two = points[at], np.where(end - at > 1, points[np.minimum(at + 1, len(points) - 1)], 0)
        taken = np.zeros(len(at), np.int64)
        for s in SUFFIXES:
            fits = (one == ord(s[0])) & ((two == ord(s[1])) if len(s) == 2 else True)
            taken = np.where((taken == 0) & fits, len(s), taken)
        at, end, taken = at[taken > 0], end[taken > 0], taken[taken > 0]
        starts[at] = False
        rest = at + taken
        starts[rest[rest < end]] = True
    return np.flatnonzero(starts)


_loaded: dict[str, tuple[Merges, Slots]] = {}


def _counter(path: str) -> tuple[Merges, Slots]:
    if path not in _loaded:
        _loaded[path] = Merges(path), Slots()
    return _loaded[path]


def count_tokens(column: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text as the tokenizers library counts them without added tokens; null counts as empty.

    Pre-tokens seen before come from a bounded cache; special strings inside a text are one token each.
    """
    merges, slots = _counter(path)
    out = [np.zeros(0, np.int64)]
    for low, high in pieces(column, 2 * SEGMENT):
        part = column.slice(low, high - low)
        data, offsets = texts(part)
        owner = np.arange(len(part))
        extra = np.zeros(len(part), np.int64)
        if any(s.encode() in data.tobytes() for s in merges.special):
            part, owner, extra = _split(part, merges.special)
            data, offsets = texts(part)
        sums = np.bincount(owner, _pretoken_sums(data, offsets, merges, slots), len(extra)).astype(np.int64)
        out.append(sums + extra)
    return np.concatenate(out)


def _split(column: pa.Array, special: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts between special strings, the row of each, and the number of special strings in each row."""
    import re

    pattern = re.compile("|".join(map(re.escape, special)))
    rows = [pattern.split(t or "") for t in column.to_pylist()]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return pa.array([x for r in rows for x in r], pa.large_string()), owner, np.array([len(r) - 1 for r in rows], np.int64)


def _pretoken_sums(data: np.ndarray, offsets: np.ndarray, merges: Merges, slots: Slots) -> np.ndarray:
    sums = np.zeros(len(offsets) - 1, np.int64)
    if not len(data):
        return sums
    head = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    char_offsets = np.searchsorted(head, offsets)
    start = pretoken_starts(points, char_offsets[:-1][np.diff(char_offsets) > 0])
    begin = head[start]
    end = np.append(begin[1:], len(data))
    found = Pieces(data, begin, end)
    at, hit = slots.get(found)
    n = slots.values[0][at].astype(np.int64)
    if not hit.all():
        miss = np.flatnonzero(~hit)
        which, back = found.distinct(miss)
        size = found.sizes[which]
        flat = np.arange(size.sum()) + np.repeat(begin[which] - (np.cumsum(size) - size), size)
        counted = merges.counts(data[flat], size)
        n[miss] = counted[back]
        slots.put(found, which, counted)
    total = np.concatenate([[0], np.cumsum(n)])
    return np.diff(total[np.searchsorted(start, char_offsets)])


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row; null and empty texts have 0 of both.

    One pass without a shuffle. Rows are independent: ties, repeated rows and null ids come back as they are; other
    columns are ignored. A text of any length is counted whole; its temporaries are a fixed multiple of its size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": batch.column(2), "n_tokens": count_tokens(batch.column(1), path)})

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = sized.schema["doc_id"].dataType.simpleString()
    out = sized.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
