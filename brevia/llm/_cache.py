"""A bounded map from short byte strings to integers that lives as long as a Python worker."""

from __future__ import annotations

import numpy as np

from ._ragged import U64, lanes, mix

#: Pieces of more bytes are never kept. Shorter ones are held whole, so a hit is the very same bytes.
LIMIT = 32


class Pieces:
    """Byte ranges of one buffer: their bytes as numbers, sizes and hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.sizes = ends - starts
        self.lanes = lanes(data, starts, ends, LIMIT // 8)
        self.hashes = mix(self.sizes.astype(np.uint64))
        for which, block in self.lanes:
            self.hashes[which] = mix(self.hashes[which] ^ block)

    def distinct(self, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of distinct pieces, which of them each piece of ``among`` equals); long ones stand for themselves."""
        _, first, back = np.unique(self.hashes[among], return_index=True, return_inverse=True)
        chosen = among[first]
        model = np.arange(len(self.sizes))
        model[among] = chosen[back]
        same = (self.sizes[model] == self.sizes) & (self.sizes <= LIMIT)
        for which, block in self.lanes:
            every = np.zeros(len(self.sizes), np.uint64)
            every[which] = block
            same[which] &= every[model[which]] == block
        alone = np.flatnonzero(~same[among])
        back[alone] = len(first) + np.arange(len(alone))
        return np.concatenate([chosen, among[alone]]), back


class Slots:
    """One slot per hash prefix; a newer piece replaces an older one, so memory never grows."""

    def __init__(self, bits: int = 20, columns: int = 1) -> None:
        self.shift = U64(64 - bits)
        self.bytes = np.zeros((LIMIT // 8, 1 << bits), np.uint64)
        self.sizes = np.zeros(1 << bits, np.int32)
        self.values = np.zeros((columns, 1 << bits), np.int32)

    def get(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether it holds the piece) of every piece."""
        at = (pieces.hashes >> self.shift).astype(np.int64)
        hit = self.sizes[at] == pieces.sizes
        for held, (which, block) in zip(self.bytes, pieces.lanes, strict=True):
            hit[which] &= held[at[which]] == block
        return at, hit

    def put(self, pieces: Pieces, which: np.ndarray, *values: np.ndarray) -> None:
        """Keep the values of the pieces at ``which``."""
        short = np.flatnonzero((pieces.sizes[which] <= LIMIT) & (pieces.sizes[which] > 0))
        at, last = np.unique((pieces.hashes[which[short]] >> self.shift).astype(np.int64), return_index=True)
        chosen = short[last]
        slot = np.full(len(pieces.sizes), -1)
        slot[which[chosen]] = at
        self.sizes[at] = pieces.sizes[which[chosen]]
        for held, (wide, block) in zip(self.bytes, pieces.lanes, strict=True):
            kept = slot[wide] >= 0
            held[slot[wide[kept]]] = block[kept]
        for row, value in zip(self.values, values, strict=True):
            row[at] = value[chosen]

    def clear(self) -> None:
        self.sizes[:] = 0
