"""Minimal perfect hashing of 64-bit key hashes: hash, then displace.

Keys fall into buckets of about four; buckets are placed, largest first, by the first displacement that sends all their keys
to free slots; buckets of one key are given a free slot outright. Look-up is two array reads. A key that was not in the set
gets some slot as well, so callers store a fingerprint (or the key) beside the value and compare.
"""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values, for keys that are integers."""
    x = np.asarray(x).astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + shift.astype(np.uint64) * np.uint64(STEP)) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """``shifts[bucket]``: a displacement, or -1 - slot for a bucket of one key."""

    def __init__(self, n: int, shifts: np.ndarray):
        self.n, self.shifts = n, shifts

    def slots(self, h: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(h), np.int64)
        shift = self.shifts[(h % np.uint64(len(self.shifts))).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, place(h, np.maximum(shift, 0), self.n))

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        """``h``: distinct uint64 hashes."""
        n = len(h)
        shifts = np.zeros(max(1, -(-n // 4)), np.int64)
        bucket = (h % np.uint64(len(shifts))).astype(np.int64)
        sizes, order = np.bincount(bucket, minlength=len(shifts)), np.argsort(bucket, kind="stable")
        begin = np.cumsum(sizes) - sizes
        taken, tries = np.zeros(n, bool), np.arange(64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own, at = h[order[begin[b]:begin[b] + sizes[b]]], 0
            while True:
                found = place(own[None, :], (tries + at)[:, None], n)
                spread = np.sort(found, axis=1)
                fits = ~taken[found].any(axis=1) & (spread[:, 1:] != spread[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(fits.argmax())
                    break
                at += len(tries)
            shifts[b] = at + k
            taken[found[k]] = True
        free = iter(np.flatnonzero(~taken).tolist())
        for b in np.flatnonzero(sizes == 1):
            shifts[b] = -1 - next(free)
        return cls(n, shifts)
