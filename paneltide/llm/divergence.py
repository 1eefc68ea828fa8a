"""Source divergence audit by chunk factorization.

Texts are mostly the same few strings over and over, so the tokenizer never sees a text. A task lower-cases A-Z in a block of
documents, cuts them at white space and counts chunks per document; a block then says each of its chunks once, with the
documents that hold it and the occurrences per source. These rows are shuffled by chunk, merged, and every globally distinct
chunk is tokenized once; its terms take the place of the chunk and are counted on.

A term is kept if at least ``min_docs`` documents of its lang hold it. Several chunks of a document may hold one term ("the",
"the,"), so documents cannot simply be added up. They need not be: a term is surely kept if one of its chunks alone is in
enough documents, and surely not if all its chunks together are in too few. For the terms between, every chunk is in fewer
than ``min_docs`` documents and has carried their row numbers along, and those are counted without repeats. So the choice is
exact, and no list is longer than ``min_docs - 1`` before it is shuffled as rows.

Groups, langs and terms are shuffled with partial sums; a chunk met everywhere is one row per block, and of a term met everywhere
only sums meet. Sources of a lang are compared a bucket of terms at a time, each a dense array of terms by sources, and the
sums per pair of sources, as many as the answer has rows, are added up. Every number is an integer.

Defined results: NULL text, lang and source are ''; a NULL or repeated key is of no account, every row is a document; a group
without terms has rows for its pairs; a lang with one source has no pairs, one without kept terms only zeros; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from paneltide.session import cut_lineage

SCALE = 1_000_000_000
MIN_DOCS, TOP = 10, 10
BLOCK_BYTES = 32 << 20
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CHUNKS = "chunk string, lid int, n_docs long, rows array<long>, gids array<int>, counts array<long>"
TERMS = "lid int, n_docs long, rows array<long>, gids array<int>, counts array<long>, terms array<string>"
CELLS = 1 << 21  # numbers compared at once
AT_ONCE = 1 << 15  # rows in a batch


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def factor(texts: pa.Array, rows: np.ndarray, lids: np.ndarray, gids: np.ndarray, min_docs: int) -> pa.RecordBatch:
    """The distinct chunks of a block, per lang, with documents and occurrences per group. ``gids`` rise with ``lids``."""
    order = np.lexsort((rows, gids))
    rows, lids, gids = rows[order], lids[order], gids[order]
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.take(pa.array(order))))
    coded = cut.flatten().dictionary_encode()
    chunks, n = coded.dictionary, max(len(rows), 1)
    owner = np.repeat(np.arange(len(rows)), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(chunks, "").to_numpy(zero_copy_only=False)[code]  # blanks at the ends leave an empty piece
    pair, seen = np.unique(code[real] * n + owner[real], return_counts=True)
    code, owner = pair // n, pair % n
    head = starts_of(code, lids[owner]) if len(pair) else np.zeros(0, np.int64)
    part = starts_of(code, gids[owner]) if len(pair) else head
    n_docs = np.diff(np.append(head, len(pair)))
    few = np.repeat(n_docs < min_docs, n_docs)
    counts = np.add.reduceat(seen, part) if len(part) else seen
    per_head = np.diff(np.append(np.searchsorted(part, head), len(part)))
    return pa.RecordBatch.from_arrays([
        chunks.take(pa.array(code[head])), pa.array(lids[owner[head]], pa.int32()), pa.array(n_docs, pa.int64()),
        lists(rows[owner[few]], np.where(n_docs < min_docs, n_docs, 0), pa.int64()), lists(gids[owner[part]], per_head, pa.int32()),
        lists(counts, per_head, pa.int64())], ["chunk", "lid", "n_docs", "rows", "gids", "counts"])


def in_batches(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, AT_ONCE):
        yield batch.slice(at, AT_ONCE)


def chunk_rows(docs: DataFrame, min_docs: int) -> DataFrame:
    """Chunks of every block. ``docs``: text, row, lid, gid."""
    def work(batches):
        held, size = [], 0

        def block():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return factor(whole["text"], *(whole[c].to_numpy(zero_copy_only=False) for c in ("row", "lid", "gid")), min_docs)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch["text"].nbytes
            if size >= BLOCK_BYTES:
                yield from in_batches(block())
                held, size = [], 0
        if held:
            yield from in_batches(block())

    return docs.select("text", "row", "lid", "gid").mapInArrow(work, CHUNKS)


def merged(batch: pa.RecordBatch, min_docs: int) -> pa.RecordBatch:
    """Rows sorted by (chunk, lid): one of each."""
    chunk = batch["chunk"].dictionary_encode()
    code, lid = chunk.indices.to_numpy(zero_copy_only=False), batch["lid"].to_numpy()
    head = starts_of(code, lid)
    if len(head) == batch.num_rows:
        return batch
    run = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(code))))
    n_docs = np.add.reduceat(batch["n_docs"].to_numpy(), head)
    widths = {c: pc.list_value_length(batch[c]).to_numpy(zero_copy_only=False) for c in ("rows", "gids")}
    rows, gid, count = (batch[c].flatten().to_numpy() for c in ("rows", "gids", "counts"))
    row_run, gid_run = np.repeat(run, widths["rows"]), np.repeat(run, widths["gids"])
    few = (n_docs < min_docs)[row_run]
    order = np.lexsort((gid, gid_run))
    gid, gid_run = gid[order], gid_run[order]
    part = starts_of(gid_run, gid) if len(gid) else np.zeros(0, np.int64)
    sums = np.add.reduceat(count[order], part) if len(part) else count
    return pa.RecordBatch.from_arrays([
        batch["chunk"].take(pa.array(head)), pa.array(lid[head], pa.int32()), pa.array(n_docs, pa.int64()),
        lists(rows[few], np.bincount(row_run[few], minlength=len(head)), pa.int64()),
        lists(gid[part], np.bincount(gid_run[part], minlength=len(head)), pa.int32()),
        lists(sums, np.bincount(gid_run[part], minlength=len(head)), pa.int64())], batch.schema.names)


def tokenized(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Chunks replaced by their terms, repeats included; each distinct chunk is looked at once, one without terms is dropped."""
    chunk = batch["chunk"].dictionary_encode()
    terms = pa.array([TERM.findall(c) for c in chunk.dictionary.to_pylist()], pa.list_(pa.string())).take(chunk.indices)
    out = pa.RecordBatch.from_arrays([*(batch[c] for c in ("lid", "n_docs", "rows", "gids", "counts")), terms], ["lid", "n_docs", "rows", "gids", "counts", "terms"])
    return out.filter(pc.greater(pc.list_value_length(terms), 0))


def term_rows(chunks: DataFrame, min_docs: int) -> DataFrame:
    """Globally distinct chunks, tokenized once each. Blocks say a chunk once, so its rows are as many as the blocks; they are
    merged while they stream by, and only the last chunk of a batch is held back."""
    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            one = merged(both, min_docs)
            last = starts_of(one["chunk"].dictionary_encode().indices.to_numpy(zero_copy_only=False))[-1]
            yield from in_batches(tokenized(one.slice(0, last)))
            held = one.slice(last)
        if held is not None:
            yield tokenized(held)

    return chunks.repartition("chunk").sortWithinPartitions("chunk", "lid").mapInArrow(work, TERMS)


def profiles(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (lid, gid, lang, source) and the occurrences of every kept term in every group that has it (lid, gid, term, n)."""
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    by_group = Window.orderBy("lang", "source")  # one row per group
    groups = cut_lineage(text.select("lang", "source").distinct().select(
        "lang", "source", F.dense_rank().over(Window.orderBy("lang")).alias("lid"), F.row_number().over(by_group).alias("gid")), "groups")
    numbered = text.select("*", F.monotonically_increasing_id().alias("row")).join(groups, ["lang", "source"])
    found = cut_lineage(term_rows(chunk_rows(numbered, min_docs), min_docs), "chunk-terms")
    held = found.select("lid", "n_docs", "rows", F.explode(F.array_distinct("terms")).alias("term"))
    bounds = cut_lineage(held.groupBy("lid", "term").agg(F.max("n_docs").alias("least"), F.sum("n_docs").alias("most")).where(F.col("most") >= min_docs), "term-bounds")
    open_ = bounds.where(F.col("least") < min_docs).select("lid", "term")
    settled = (held.where(F.col("n_docs") < min_docs).join(open_, ["lid", "term"]).select("lid", "term", F.explode("rows").alias("row"))
               .distinct().groupBy("lid", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs))
    kept = bounds.where(F.col("least") >= min_docs).select("lid", "term").union(settled.select("lid", "term"))
    counts = (found.select("lid", F.explode("terms").alias("term"), "gids", "counts")
              .select("lid", "term", F.inline(F.arrays_zip("gids", "counts"))).groupBy("lid", "term", F.col("gids").alias("gid")).agg(F.sum("counts").alias("n")))
    return groups, cut_lineage(counts.join(kept, ["lid", "term"], "left_semi").select("lid", "gid", "term", "n"), "term-counts")


def share(count, total, kinds):
    """1 + floor(SCALE * (count + 2) / (total + 2 * kinds)), exact beyond 64 bits on the way."""
    return F.expr(f"1L + (cast({SCALE} AS decimal(20, 0)) * (cast({count} AS decimal(18, 0)) + 2)) div (cast({total} AS decimal(20, 0)) + 2 * {kinds})")


def distance(p, q):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def compared(terms: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums over a bucket's terms, per pair of groups a < b. ``groups`` are all of the lang, with the share of an absent term."""
    gids = np.sort(groups["gid"].to_numpy())
    absent = groups.sort_values("gid")["p0"].to_numpy(np.int64)
    code, names = pd.factorize(terms["term"])
    at = np.searchsorted(gids, terms["gid"].to_numpy())
    p = terms["p"].to_numpy(np.int64)
    order = np.argsort(code, kind="stable")
    code, at, p = code[order], at[order], p[order]
    total = np.zeros((len(gids), len(gids)), np.int64)
    step = max(1, CELLS // max(len(gids), 1))
    for first in range(0, len(names), step):
        lo, hi = np.searchsorted(code, [first, first + step])
        dense = np.tile(absent[:, None], (1, min(step, len(names) - first)))
        dense[at[lo:hi], code[lo:hi] - first] = p[lo:hi]
        for a in range(len(gids) - 1):
            gap = dense[a + 1:] - dense[a]
            total[a, a + 1:] += (gap * gap // (dense[a + 1:] + dense[a])).sum(axis=1)
    a, b = np.triu_indices(len(gids), 1)
    return pd.DataFrame({"a": gids[a], "b": gids[b], "value": total[a, b]})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, buckets: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank. Terms are compared in ``buckets`` per lang, by default one per shuffle partition."""
    groups, counts = profiles(docs, min_docs)
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_terms = counts.groupBy("lid", "term").agg(F.sum("n").alias("n_lang"))
    of_langs = groups.select("lid").distinct().join(of_terms.groupBy("lid").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n_lang").alias("total_lang")), "lid", "left")
    of_groups = groups.join(counts.groupBy("gid").agg(F.sum("n").alias("total")), "gid", "left").join(of_langs, "lid").na.fill(0, ["total", "kinds", "total_lang"])
    sized = cut_lineage(of_groups, "group-sizes")  # a lang without kept terms has no share: its sums are 0 whatever it is
    sized = sized.withColumn("p0", F.when(F.col("kinds") > 0, share("0", "total", "greatest(kinds, 1)")).otherwise(F.lit(0)))
    known = counts.join(sized, ["lid", "gid"]).withColumn("p", share("n", "total", "kinds"))

    tiles = sized.select("lid", "gid", "p0", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("tile"))
    dealt = known.select("lid", "gid", "term", "p", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("tile"))
    sums = (dealt.groupBy("lid", "tile").cogroup(tiles.groupBy("lid", "tile")).applyInPandas(compared, "a int, b int, value long")
            .groupBy("a", "b").agg(F.sum("value").alias("value")))
    both = sums.select(F.inline(F.array(F.struct(F.col("a").alias("gid"), F.col("b").alias("other"), "value"), F.struct(F.col("b").alias("gid"), F.col("a").alias("other"), "value"))))
    names = groups.select("gid", "lang", "source")
    pairs = both.join(names, "gid").join(names.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")

    near = known.join(of_terms, ["lid", "term"]).withColumn("q", share("n_lang", "total_lang", "kinds")).where("p > q")
    terms = near.select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"))

    def ranked(rows, part, most=None):
        best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        out = rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
        return out if most is None else out.where(F.col("rank") <= most)

    return ranked(pairs, "pair").union(ranked(terms, "term", top))
