"""Connected components of a large graph by repeated contraction.

Every node takes the smallest label around it (a minimum, so it is combined before the shuffle and a hub costs no more than
any other node), two such steps are followed, and the links are rewritten between the labels that remain. The graph shrinks
each round; no node's neighbours are ever gathered, and each round is written to the shared folder, in as many files as its links
are worth and not as many as the session has shuffle partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paneltide.session import cut_lineage

FILE_ROWS = 1 << 18


def ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root``, one row for every node with a link; the root is one of the component's nodes.
    ``links`` has columns a and b of one orderable type; loops and repeats do no harm, NULLs are not nodes."""
    current = cut_lineage(ordered(links.where("a IS NOT NULL AND b IS NOT NULL")), "links")
    steps: list[DataFrame] = []
    files: list[int] = []
    while n := current.count():
        files.append(n // FILE_ROWS + 1)
        both = current.select("a", "b").union(current.select("b", "a")).toDF("node", "near")
        up = both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("up"))
        further = up.toDF("up", "root")
        step = cut_lineage(up.join(further, "up").select("node", "root").coalesce(files[-1]), "labels")
        steps.append(step)
        relabelled = current.join(step.toDF("a", "ra"), "a").join(step.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        current = cut_lineage(ordered(relabelled).coalesce(files[-1]), "links")
    if not steps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    last = steps.pop()
    while steps:
        last = steps.pop().join(last.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return last.coalesce(files[0])
