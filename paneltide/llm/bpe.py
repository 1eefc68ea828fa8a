"""Byte-level BPE with a two-tier look-up.

Text is cut into pre-tokens. A minimal perfect hash finds those that are vocabulary entries themselves (the entry at the slot
is compared, so a stranger never passes); the others are merged byte by byte with a heap of candidate pairs over a linked list.
Pre-tokens already met by the worker come from a bounded memo. Decoding joins the entries of the ids.

The vocabulary file is read on the driver (its path is a parameter) and broadcast: a few megabytes, whatever the corpus holds.

Defined results: NULL and empty texts have no ids and decode to nothing; NULL keys are kept; repeated rows give repeated
results; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import in_slices, map_batches, texts
from .mph import PerfectHash

MEMO = 300_000  # pre-tokens a worker remembers
GROUP = 64  # texts whose unknown pre-tokens are looked up together


def read_ranks(path: str) -> list[bytes]:
    """Entries in rank order from a file of base64 entries and ranks."""
    with open(path, "rb") as lines:
        entries = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, lines)}
    if sorted(entries) != list(range(len(entries))):
        raise ValueError(f"{path}: ranks are not 0 to {len(entries) - 1}")
    return [entries[k] for k in range(len(entries))]


_ready: dict[tuple, Codec] = {}  # of this process; at most one


class Codec:
    def __init__(self, entries: list[bytes], pattern: str):
        self.entries, self.pattern = entries, pattern
        hashes = self.hashes(entries)
        self.index = PerfectHash.build(hashes)
        self.at_slot = np.empty(len(entries), np.int64)
        self.at_slot[self.index.slots(hashes)] = np.arange(len(entries))

    def __getstate__(self):
        return self.entries, self.pattern, self.index, self.at_slot

    def __setstate__(self, state):
        self.entries, self.pattern, self.index, self.at_slot = state

    @staticmethod
    def hashes(pieces: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(p) for p in pieces), np.uint64, len(pieces))

    def ready(self) -> Codec:
        """The codec this process uses for these entries: a worker serves many jobs, and each brings a copy of its own."""
        name = (self.pattern, hashlib.sha256(b"\0".join(self.entries)).digest())
        if name in _ready:
            return _ready[name]
        if not hasattr(self, "memo"):
            self.memo: dict[str, bytes] = {}
            self.ranks = {e: k for k, e in enumerate(self.entries)}
            self.find = regex.compile(self.pattern).findall
        _ready.clear()
        _ready[name] = self
        return self

    def merge(self, piece: bytes) -> list[int]:
        """Repeatedly join the pair of lowest rank, the leftmost of equals."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once it is swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            if end[i] != middle or end[middle] != stop:
                continue  # one of the two parts has changed
            end[middle], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            j = before[i]
            if j >= 0 and (r := ranks.get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, i, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i:end[i]]])
            i = end[i]
        return ids

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of unseen pre-tokens in the memo, as little-endian 32-bit integers."""
        raw = [p.encode() for p in pieces]
        ids = self.at_slot[self.index.slots(self.hashes(raw))].tolist()
        for piece, key, k in zip(pieces, raw, ids):
            found = [k] if self.entries[k] == key else self.merge(key)
            self.memo[piece] = np.array(found, "<u4").tobytes()

    def encode(self, given: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(given), GROUP):
            pieces = [self.find(t) for t in given[at:at + GROUP]]
            if len(self.memo) > MEMO:
                self.memo.clear()
            unseen = [p for p in set().union(*pieces) if p not in self.memo]
            if unseen:
                self.learn(unseen)
            out += [b"".join(map(self.memo.__getitem__, p)) for p in pieces]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers)."""
    shared = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))

    def work(batches):
        own = shared.value.ready()
        for batch in in_slices(batches):
            yield {"doc_id": batch.column("doc_id"), "ids": own.encode(batch.column("text").to_pylist())}

    return map_batches(texts(docs, id_col, text_col), work, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of the bytes they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(codec(path, pattern))
    digest = lambda parts: [hashlib.sha256(p).hexdigest() for p in parts]

    def work(batches):
        own = shared.value.ready()
        for batch in in_slices(batches):
            ids = own.encode(batch.column("text").to_pylist())
            yield {"doc_id": batch.column("doc_id"), "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": digest(ids),
                   "decoded_sha256": digest(map(own.decode, ids))}

    return map_batches(texts(docs), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
