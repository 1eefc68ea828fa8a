"""Near duplicates by 64-bit SimHash fingerprints and BK-trees.

Equal fingerprints are merged first, so only distinct ones are searched. Two fingerprints within two bits agree on at least
four of six blocks, so each distinct fingerprint goes to fifteen shards, one per choice of four blocks, keyed by the bits of
those blocks; within the radius no pair is missed. A shard's fingerprints form a BK-tree (children keyed by their Hamming
distance to the parent) and a search follows only edges within the radius of its own distance. The trees stay in the task that
the shuffle brought the shard to: broadcasting them, as is usual, would send something that grows with the corpus to everyone.
A shard fixes at least 42 bits, so it holds at most 2**22 fingerprints, and a cluster of near copies spreads over many shards
because its members differ in many places. A shard reports the links that join its parts, not all pairs.

Defined results: NULL, empty and wordless texts have fingerprint zero and are linked like any other; NULL keys keep their rows
and are smaller than nothing, so a component takes the smallest key that is not NULL, or NULL; repeated rows come out
repeatedly; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from paneltide.session import cut_lineage

from .common import in_slices, map_batches
from .components import connected

RADIUS = 2
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
SLICE = 1 << 14


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = [signed(sum(((1 << width) - 1) << at for at, width in chosen)) for chosen in combinations(BLOCKS, len(BLOCKS) - RADIUS)]


def fingerprint(text: str, words_each: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half of the shingle hashes, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII blanks separate
    if not words:
        return 0
    if len(words) < words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(words_each))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at:at + SLICE].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


class BKTree:
    """Fingerprints by Hamming distance; ``add`` first reports what is within the radius."""

    def __init__(self):
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, point: int, radius: int = RADIUS) -> list[int]:
        found, stack = [], [0] if self.points else []
        while stack:
            k = stack.pop()
            d = (self.points[k] ^ point).bit_count()
            if d <= radius:
                found.append(k)
            below = self.children[k]
            stack += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
        at, new = 0, len(self.points)
        while new:
            d = (self.points[at] ^ point).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        self.points.append(point)
        self.children.append({})
        return found


def links_of(shard: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within the radius that connect what is connected in the shard; distinct unsigned fingerprints."""
    tree, parent, out = BKTree(), list(range(len(shard))), []

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, point in enumerate(shard):
        for other in tree.add(point, radius):
            a, b = top(k), top(other)
            if a != b:
                parent[a] = b
                out.append((point, shard[other]))
    return out


def near_links(distinct: DataFrame) -> DataFrame:
    """Links a, b between distinct fingerprints (column ``fp``) that connect all pairs within the radius."""
    shards = distinct.select("fp", F.inline(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(MASKS)])))

    def search(batches):
        choice, bits, fps = (np.zeros(0, np.int64) for _ in range(3))
        for batch in _then_none(batches):
            if batch is not None:
                choice, bits, fps = (np.concatenate([x, batch.column(n).to_numpy().astype(np.int64)]) for x, n in ((choice, "choice"), (bits, "bits"), (fps, "fp")))
            edges = np.flatnonzero((np.diff(choice) != 0) | (np.diff(bits) != 0)) + 1
            cut = np.concatenate([[0], edges, [len(fps)]])
            if batch is not None:
                cut = cut[:-1]  # the last shard may go on in the next batch
            a, b = [], []
            for i in np.flatnonzero(np.diff(cut) > 1):
                for x, y in links_of(fps[cut[i]:cut[i + 1]].view(np.uint64).tolist()):
                    a.append(signed(x))
                    b.append(signed(y))
            choice, bits, fps = (x[cut[-1]:] for x in (choice, bits, fps))
            yield {"a": a, "b": b}

    grouped = shards.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")
    return map_batches(grouped, search, "a long, b long")


def _then_none(batches):
    yield from batches
    yield None


def grouped(docs: DataFrame, least: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Fingerprints per row (doc_id, fp) and per distinct fingerprint: fp, ``least`` (the minimum of the given expression over
    its rows), ``root`` (a fingerprint of its component)."""
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), least.alias("least"))
    kind = packed.schema["least"].dataType.simpleString()

    def work(batches):
        for batch in in_slices(batches):
            yield {"doc_id": batch.column("doc_id"), "fp": [fingerprint(t) for t in batch.column("text").to_pylist()], "least": batch.column("least")}

    marked = cut_lineage(map_batches(packed, work, f"doc_id long, fp long, least {kind}"), "fingerprints")
    groups = cut_lineage(marked.groupBy("fp").agg(F.min("least").alias("least")), "distinct-fingerprints")
    roots = cut_lineage(connected(near_links(groups)).withColumnRenamed("node", "fp"), "components")
    return marked, groups.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest key reachable over links, itself included."""
    marked, groups = grouped(docs, F.col(id_col).cast("long"), id_col, text_col)
    groups = cut_lineage(groups, "rooted")
    smallest = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = groups.join(smallest, "root").select("fp", "component_id")
    # written before the last join, which is then a plain join whose skewed side (a group of copies) Spark can split
    return marked.select("doc_id", "fp").join(cut_lineage(of_fp, "of-fingerprints"), "fp").select("doc_id", "fp", "component_id")
