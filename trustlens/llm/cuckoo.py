"""A cuckoo filter over 64-bit keys, in numpy, whole batches at a time.

A key's fingerprint has 32 bits; both of its buckets follow from the fingerprint alone, so a filter can grow
without its keys. Keys that are in the filter always test positive. Equal fingerprints are kept as often as they
were inserted; what two buckets cannot hold of them stands in a stash.
"""

from __future__ import annotations

import numpy as np

from trustlens.llm.words import mix

SLOTS = 4
#: rounds of kicks before a table grows, and the fill beyond which it does at once
ROUNDS, FULL = 64, 0.9


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """uint32, never 0 (an empty slot)."""
    return np.maximum(mix(keys.view(np.uint64)) >> np.uint64(32), np.uint64(1)).astype(np.uint32)


class CuckooFilter:
    def __init__(self, table: np.ndarray | None = None, stash: np.ndarray | None = None):
        self.table = np.zeros((1, SLOTS), np.uint32) if table is None else table
        self.stash = np.zeros(0, np.uint32) if stash is None else stash

    @classmethod
    def loads(cls, slots: bytes, stash: bytes) -> CuckooFilter:
        return cls(np.frombuffer(slots, np.uint32).reshape(-1, SLOTS).copy(), np.frombuffer(stash, np.uint32).copy())

    def dumps(self) -> tuple[bytes, bytes]:
        return self.table.tobytes(), self.stash.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.stash)

    def _places(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, last = mix(prints.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), np.uint64(len(self.table) - 1)
        first = h & last
        return first.astype(np.int64), (first ^ (h >> np.uint64(32) & last)).astype(np.int64)

    def insert(self, prints: np.ndarray) -> None:
        if len(self) + len(prints) > FULL * self.table.size:
            prints = self._grown(len(self) + len(prints), prints)
        while len(prints := self._settle(prints)):
            if 2 * len(self) < self.table.size:  # room, but not in these buckets: one fingerprint over and over
                self.stash = np.concatenate([self.stash, prints])
                return
            prints = self._grown(self.table.size + 1, prints)

    def _grown(self, room: int, prints: np.ndarray) -> np.ndarray:
        """An empty table with ``room`` at least; all fingerprints to insert."""
        prints = np.concatenate([self.table[self.table != 0], self.stash, prints])
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, room) / (FULL * SLOTS)))))
        self.__init__(np.zeros((buckets, SLOTS), np.uint32))
        return prints

    def _settle(self, prints: np.ndarray) -> np.ndarray:
        """Insert; the fingerprints that are homeless after all rounds."""
        at = self._places(prints)[0]
        for turn in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            empty = self.table[at] == 0
            fits = rank < empty.sum(1)
            slot = (np.cumsum(empty[fits], 1) == rank[fits][:, None] + 1).argmax(1)
            self.table[at[fits], slot] = prints[fits]
            prints, at = prints[~fits], at[~fits]
            if len(prints) == 0:
                break
            _, one = np.unique(at, return_index=True)  # one of each bucket takes the place of another
            slot = (prints[one] + np.uint32(turn)) % SLOTS
            out = self.table[at[one], slot]
            self.table[at[one], slot] = prints[one]
            prints[one] = out
            first, second = self._places(prints)
            at = np.where(at == first, second, first)
        return prints

    def contains(self, prints: np.ndarray) -> np.ndarray:
        found = np.isin(prints, self.stash)
        for at in self._places(prints):
            found |= (self.table[at] == prints[:, None]).any(1)
        return found

    def delete(self, prints: np.ndarray) -> None:
        """Remove each of the fingerprints once; they must have been inserted."""
        while len(prints):
            prints, n = np.unique(prints, return_counts=True)
            left = np.ones(len(prints), bool)
            for at in self._places(prints):
                hit = self.table[at] == prints[:, None]
                own = np.flatnonzero(left & hit.any(1))
                self.table[at[own], hit[own].argmax(1)] = 0
                left[own] = False
            for x in prints[left]:
                at = np.flatnonzero(self.stash == x)[:1]
                self.stash = np.delete(self.stash, at)
            prints = np.repeat(prints, n - 1)
