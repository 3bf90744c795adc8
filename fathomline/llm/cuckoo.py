"""A cuckoo filter (Fan, Andersen, Kaminsky, Mitzenmacher 2014) over 64-bit keys, with numpy.

Buckets of four 16-bit fingerprints; a key has two buckets, each found from the other and the fingerprint.  Keys can be
deleted.  There are no false negatives; the false positive rate is about 8 / 65,536.  The filter doubles when it fills.
"""

from __future__ import annotations

import numpy as np

from .kernels import mix

SLOTS = 4
KICKS = 500


class CuckooFilter:
    def __init__(self, capacity: int):
        buckets = 1
        while buckets * SLOTS * 0.85 < max(capacity, 1):
            buckets *= 2
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of all keys, as large as they need; a key that comes twice is held twice."""
        keys = np.asarray(keys, dtype=np.uint64)
        capacity = len(keys)
        while True:
            out = cls(capacity)
            if out._insert_all(keys):
                return out
            capacity = max(8, 2 * capacity)

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(np.asarray(keys, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, bucket, prints):
        jump = mix(np.asarray(prints, dtype=np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)
        return np.asarray(bucket ^ jump.astype(np.int64))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(keys)
        return ((self.table[one] == prints[:, None]) | (self.table[two] == prints[:, None])).any(axis=1)

    def _insert_all(self, keys: np.ndarray) -> bool:
        """Places what fits without a kick in a few vector rounds, and the rest one at a time."""
        prints, one, two = self._places(keys)
        left = np.arange(len(keys))
        for side in (one, two, one, two):
            if not len(left):
                return True
            for slot in range(SLOTS):
                free = left[self.table[side[left], slot] == 0]
                _, first = np.unique(side[free], return_index=True)
                chosen = free[first]
                self.table[side[chosen], slot] = prints[chosen]
                done = np.zeros(len(keys), dtype=bool)
                done[chosen] = True
                left = left[~done[left]]
        return all(self._kick(int(one[i]), int(prints[i])) for i in left)

    def _kick(self, bucket: int, fingerprint: int) -> bool:
        state = (bucket * 2654435761 + fingerprint) & 0xFFFFFFFF
        for _ in range(KICKS):
            for b in (bucket, int(self._other(np.int64(bucket), np.uint16(fingerprint)))):
                free = np.flatnonzero(self.table[b] == 0)
                if len(free):
                    self.table[b, free[0]] = fingerprint
                    return True
            state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
            slot = (state >> 16) % SLOTS
            fingerprint, self.table[b, slot] = int(self.table[b, slot]), fingerprint
            bucket = b
        return False

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is full; it must then be built anew from the exact table."""
        return self._insert_all(np.asarray(keys, dtype=np.uint64))

    def delete(self, keys: np.ndarray) -> None:
        """Takes one copy of each key out; the caller knows from the exact table that it is there."""
        prints, one, two = self._places(keys)
        for p, a, b in zip(prints.tolist(), one.tolist(), two.tolist(), strict=True):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == p)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
