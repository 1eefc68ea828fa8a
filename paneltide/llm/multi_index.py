"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves and each half is quantised to its nearest of ``cells_each`` centroids, so a vector belongs to a
cell, a pair of centroids. A query ranks the centroids of each half by inner product and visits cells by falling sum, with a
heap over the frontier of the sorted pairs, until the cells hold the wanted number of vectors. Entries of visited cells are
reranked by the exact inner product of the original vectors in double precision.

The centroids are fitted on at most ``fit_rows`` vectors, those with the smallest hash; every vector is indexed. How many vectors
a query must visit is learnt on the full index: ``TRIED`` queries, those with the smallest hash, are answered exactly by one
scan of all vectors, and the number is the least that reaches ``recall`` of their neighbours, and a tenth more. Where
neighbours share cells that is few, whatever the number of vectors; on data without clusters it is most of them.

Equal vectors are one entry that keeps its ``k + 1`` smallest ids (no query can be answered with more of them), and equal
queries are answered once. Entries are shuffled by first centroid, large centroids salted into blocks of at most
``BLOCK`` entries and as many blocks of queries, so no group grows with the data; each block keeps its best k + 1 entries per
query, and ranking cuts before it shuffles.

Defined results: vectors that are NULL, zero, of another length than the most frequent, or hold NULL, NaN or infinity take no
part, nor do rows with a NULL id; repeated ids are separate rows; a query with fewer than k other vectors gets them all; empty
tables give empty results; further columns are ignored. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame, Window, functions as F

from paneltide.session import cut_lineage

from .common import map_batches

BLOCK = 8192
QUERY_BLOCK = 2048
TRIED = 128  # queries that are answered exactly to learn how much to visit


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the centre at the least distance, in slices."""
    half = (centres ** 2).sum(1) / 2
    return np.concatenate([(points[i:i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(points), 4096)] or [np.zeros(0, int)])


def centroids(points: np.ndarray, n: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from distinct points; a centre without points stays where it is."""
    distinct = np.unique(points, axis=0)
    centres = np.random.default_rng(seed).permutation(distinct)[:n].copy()
    for _ in range(rounds):
        owner = nearest(points, centres)
        sums, counts = np.zeros_like(centres), np.bincount(owner, minlength=len(centres))
        np.add.at(sums, owner, points)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class MultiIndex:
    def __init__(self, sample: np.ndarray, cells_each: int):
        self.cut = sample.shape[1] // 2
        self.centres = [centroids(part, cells_each) for part in (sample[:, :self.cut], sample[:, self.cut:])]

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(points[:, :self.cut], self.centres[0]), nearest(points[:, self.cut:], self.centres[1])

    def visit(self, query: np.ndarray, counts: np.ndarray, wanted: float):
        """Cells (i, j) by falling summed inner product until they hold ``wanted`` entries; empty cells are passed over."""
        a, b = self.centres[0] @ query[:self.cut], self.centres[1] @ query[self.cut:]
        by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b, own = a.tolist(), b.tolist(), counts
        heap, reached, seen = [(-a[by_a[0]] - b[by_b[0]], 0, 0)], [-1] * len(by_a), 0
        while heap and seen < wanted:
            _, x, y = heapq.heappop(heap)
            i, j = by_a[x], by_b[y]
            reached[x] = y
            n = own[i][j]
            if n:
                seen += n
                yield i, j
            # a pair joins the frontier once both pairs before it have left
            if y + 1 < len(by_b) and (x == 0 or reached[x - 1] > y):
                heapq.heappush(heap, (-a[i] - b[by_b[y + 1]], x, y + 1))
            if x + 1 < len(by_a) and reached[x + 1] == y - 1:
                heapq.heappush(heap, (-a[by_a[x + 1]] - b[j], x + 1, y))

    def seen_before(self, query: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Entries that are visited by the time the cells (i, j) are done, in the order of ``visit``."""
        sums = (self.centres[0] @ query[:self.cut])[:, None] + (self.centres[1] @ query[self.cut:])[None, :]
        order = np.argsort(-sums, axis=None, kind="stable")
        upto = np.empty(len(order), np.int64)
        upto[order] = np.cumsum(counts.ravel()[order])
        return upto[i * counts.shape[1] + j]


def learn_visits(placed: DataFrame, index, counts: np.ndarray, k: int, recall: float) -> float:
    """Entries a query must visit to meet ``recall`` of its k nearest, from queries answered by a scan of all entries."""
    tried = placed.where("asked").orderBy("h", "v").limit(TRIED).select("h", "v").toArrow()
    if recall >= 1 or not tried.num_rows:
        return float("inf")
    queries, own = matrix(tried["v"]), tried["h"].to_numpy()

    def scan(batches):
        best: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column("v"))
            scores = points @ queries.T
            single = pa.compute.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False) == 1
            scores[(batch.column("h").to_numpy()[:, None] == own[None, :]) & single[:, None]] = -np.inf  # a query is no neighbour of its own
            cells = [np.repeat(batch.column(c).to_numpy()[:, None], len(own), axis=1) for c in "ij"]
            parts = (scores, *cells) if best is None else tuple(np.concatenate([b, n]) for b, n in zip(best, (scores, *cells)))
            if len(parts[0]) > k:
                top = np.argpartition(-parts[0], k - 1, axis=0)[:k]
                parts = tuple(np.take_along_axis(p, top, axis=0) for p in parts)
            best = parts
        if best is not None:
            rows, q = np.nonzero(np.isfinite(best[0]))
            yield {"q": q, "score": best[0][rows, q], "i": best[1][rows, q], "j": best[2][rows, q]}

    found = map_batches(placed.select("h", "v", "ids", "i", "j"), scan, "q int, score double, i int, j int")
    place = Window.partitionBy("q").orderBy(F.col("score").desc(), "i", "j")
    near = found.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k).select("q", "i", "j").toArrow()  # k per tried query
    q, i, j = (near[c].to_numpy() for c in ("q", "i", "j"))
    needed = [index.seen_before(queries[t], counts, i[q == t], j[q == t]) for t in np.unique(q)]
    return 1.1 * float(np.quantile(np.concatenate(needed), recall)) + k if needed else float("inf")


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles) of the rows that take part."""
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    sound = given.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = sound.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    wide = sizes.agg(F.max_by("n", F.struct("rows", "n")).alias("n"))
    return sound.join(F.broadcast(wide), F.size("v") == F.col("n")).select("vec_id", "v")


def entries_of(rows: DataFrame, k: int, is_query) -> DataFrame:
    """One row per distinct vector: v, ``ids`` (its k + 1 smallest), ``asked`` (whether one of its rows is a query)."""
    v = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 and 0.0 are one vector
    same = Window.partitionBy("h", "v").orderBy("vec_id")
    marked = rows.select("vec_id", v.alias("v"), is_query(F.col("vec_id")).alias("q")).withColumn("h", F.xxhash64("v"))
    first = marked.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    asked = marked.where("q").withColumn("n", F.row_number().over(same)).where("n = 1").select("h", "v", F.lit(True).alias("asked"))
    kept = first.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 each
    return kept.join(asked, ["h", "v"], "left").select("h", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


def best_in_block(k: int):
    def work(key, left: pa.Table, right: pa.Table) -> pa.Table:
        """Entries (h, v, ids, j) and queries (q, v, cells j) of one block: the best k + 1 entries of each query."""
        out = {"q": [], "ids": [], "score": []}
        if left.num_rows and right.num_rows:
            e, q = matrix(left["v"]), matrix(right["v"])
            by_cell = np.argsort(left["j"].to_numpy(), kind="stable")
            cells, begin = np.unique(left["j"].to_numpy()[by_cell], return_index=True)
            members = dict(zip(cells.tolist(), np.split(by_cell, begin[1:])))
            lists = right["cells"].combine_chunks()
            who, wants = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            order = np.argsort(wants, kind="stable")
            asked, at = np.unique(wants[order], return_index=True)
            best: list[list] = [[] for _ in range(len(q))]
            for cell, group in zip(asked.tolist(), np.split(who[order], at[1:])):
                own = members.get(cell)
                if own is None:
                    continue
                scores = q[group] @ e[own].T
                for row, g in zip(scores, group.tolist()):
                    best[g].append((row, own))
            for g, parts in enumerate(best):
                if not parts:
                    continue
                scores, own = np.concatenate([p for p, _ in parts]), np.concatenate([o for _, o in parts])
                if len(own) > k + 1:
                    edge = np.partition(scores, -(k + 1))[-(k + 1)]
                    near = scores >= edge - 1e-9 * max(1.0, abs(edge))
                    own = own[near]
                exact = (e[own] * q[g]).sum(axis=1)
                out["q"] += [right["q"][g].as_py()] * len(own)
                out["score"] += exact.tolist()
                out["ids"] += [left["ids"][int(o)].as_py() for o in own]
        return pa.table({"q": pa.array(out["q"], pa.int64()), "ids": pa.array(out["ids"], pa.list_(pa.int64())), "score": pa.array(out["score"], pa.float64())})

    return work


def search(rows: DataFrame, k: int = 20, is_query=lambda i: i % 20 == 0, fit_rows: int = 8192, cells_each: int | None = None, recall: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of every query."""
    spark = rows.sparkSession
    sound = usable(rows)
    entries = cut_lineage(entries_of(sound, k, is_query), "vectors")
    sample = entries.orderBy("h", "v").limit(fit_rows).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points, total = matrix(sample["v"]), entries.count()
    each = cells_each or int(min(max(1, (total / 32) ** 0.5), max(1, len(points) / 16)))
    index = spark.sparkContext.broadcast(MultiIndex(points, each))

    def assign(batches):
        for batch in batches:
            i, j = index.value.cells(matrix(batch.column("v")))
            yield {"h": batch.column("h"), "v": batch.column("v"), "ids": batch.column("ids"), "asked": batch.column("asked"), "i": i, "j": j}

    placed = cut_lineage(map_batches(entries, assign, "h long, v array<double>, ids array<long>, asked boolean, i int, j int"), "cells")
    table = np.zeros((each, each), np.int64)
    for c in placed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect():  # at most cells_each squared
        table[c.i, c.j] = c.n
    salts = np.maximum(1, -(-table.sum(1) // BLOCK)).tolist()
    counts, wanted = table.tolist(), max(learn_visits(placed, index.value, table, k, recall), 3.0 * (k + 1))

    def traverse(batches):
        for batch in batches:
            out = {"q": [], "v": [], "i": [], "cells": []}
            for h, v, point in zip(batch.column("h").to_pylist(), batch.column("v").to_pylist(), matrix(batch.column("v"))):
                by_first: dict[int, list[int]] = {}
                for i, j in index.value.visit(point, counts, wanted):
                    by_first.setdefault(i, []).append(j)
                for i, js in by_first.items():
                    for name, value in (("q", h), ("v", v), ("i", i), ("cells", js)):
                        out[name].append(value)
            yield out

    asked = placed.where("asked").select(F.xxhash64("v", F.lit(1)).alias("h"), "v")
    visits = cut_lineage(map_batches(asked, traverse, "q long, v array<double>, i int, cells array<int>"), "visits")
    turns = [0] * each  # blocks of queries per first centroid: entries that no query visits are not copied at all
    for c in visits.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect():  # at most cells_each
        turns[c.i] = -(-c.n // QUERY_BLOCK)
    per_first = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("i") + 1)
    n_salts, n_turns = per_first(salts), per_first(turns)
    routes = visits.withColumn("turn", F.pmod("q", n_turns).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
    blocks = (placed.where(n_turns > 0).withColumn("salt", F.pmod("h", n_salts).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), n_turns - 1)))
              .select("i", "salt", "turn", "v", "ids", "j"))
    found = (blocks.groupBy("i", "salt", "turn").cogroup(routes.select("i", "salt", "turn", "q", "v", "cells").groupBy("i", "salt", "turn"))
             .applyInArrow(best_in_block(k), "q long, ids array<long>, score double"))
    ranked = found.select("q", F.explode("ids").alias("vec_id"), "score")
    order = [F.col("score").desc(), F.col("vec_id")]
    top = ranked.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("n") <= k + 1)
    ids = sound.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)), F.lit(1)).alias("q"))
    near = ids.join(top.drop("n"), "q").where("query_id <> vec_id")
    return (near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
