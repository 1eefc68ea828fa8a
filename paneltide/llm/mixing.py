"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources' weights share a budget, no target exceeds ``most`` times its source's size, and what is over is reshared
by weight; that is a water level, found from running sums over one row per source. A source first gives its complete epochs;
the fraction left is sampled without replacement: every document draws an exponential key divided by its quality weight, and
documents are taken in key order until their sizes reach the budget (the document at the edge is taken if that is nearer).

The order is never built per source: keys fall into logarithmic buckets (each about a thousandth of a source), sizes are summed
per bucket before anything is ordered, and running sums inside a bucket start at the sum of the buckets below. A source that
holds a third of all rows is as many tasks as any other. The draw is a digest of the key, so reruns agree.

The quality weight is the share of words that is not made up for by symbols, at least a tenth.

Defined results: a NULL text has size 0 and nothing taken; NULL sources are one source, ordered last; a NULL key draws like the
empty string; repeated rows draw alike and are taken one after the other; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paneltide.session import cut_lineage

from .common import WORD

WEIGHTS = (5, 2, 1)
SYMBOL = r"[#*$%&|<>!]"
BUCKETS = 256  # per unit of the key's logarithm


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def marked(docs: DataFrame, carry: list[Column], seed: str = "mix") -> DataFrame:
    """``row`` (what is carried), ``src`` (the source with NULL as a value of its own), ``size``, ``key``, ``bucket``, ``tie``."""
    base = docs.select(F.struct(*carry).alias("row"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("src"),
                       size_of(F.col("text")).alias("size"), F.coalesce(F.regexp_count("text", F.lit(SYMBOL)), F.lit(0)).alias("symbols"),
                       F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("digest"),
                       F.struct(F.col("doc_id"), F.xxhash64("text").alias("text")).alias("tie"))
    draw = (F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    weight = F.greatest(F.lit(0.1), 1 - F.col("symbols") / F.greatest(F.col("size"), F.lit(1)))
    return (base.withColumn("key", -F.log(draw) / weight).withColumn("bucket", F.floor(BUCKETS * F.log("key")).cast("long"))
            .select("row", "src", "size", "key", "bucket", "tie"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Input: one row (src, source_size) per source; adds ``target``. The windows run over that many rows in one task."""
    order = Window.orderBy(F.col("src") == "", "src")
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", most * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("w"), "src")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * share
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    level = (total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    levels = weighed.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("w"))
    found = F.max(F.when(F.col("fits"), F.col("level"))).over(everything)  # the first that fits: from there on they fall
    return levels.select("src", "source_size", F.least("cap", F.coalesce(found, F.lit(0.0)) * F.col("w")).alias("target"))


def taken(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, again: DataFrame | None = None) -> DataFrame:
    """``row``, ``size``, ``source_size``, ``target``, ``copies``. ``rows`` and ``again`` come from ``marked``; ``again``
    carries nothing and is summed up, so that what ``rows`` carries is shuffled once."""
    buckets = (again or rows).groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sums = buckets.groupBy("src").agg(F.sum("n").alias("source_size"))
    plan = targets(sums, weights, share, most).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    starts = buckets.withColumn("start", F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).drop("n").join(plan, "src")
    before = F.col("start") + F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return (rows.join(starts, ["src", "bucket"]).withColumn("before", before)
            .withColumn("copies", F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("rest")), 1).otherwise(0))
            .select("row", "size", "source_size", "target", "copies"))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows = cut_lineage(marked(docs, [F.col("doc_id")]), "mix-rows")
    return taken(rows).select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The documents of the mix, all columns, as many times as each is taken."""
    out = taken(marked(docs, [F.col(f"`{c}`") for c in docs.columns]), again=marked(docs, [F.lit(0).alias("none")]))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
