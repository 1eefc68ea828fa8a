"""Filter interaction audit by the Hart-Mas-Colell potential.

Every document is measured once and gets one bit per filter it fails, so all that follows works on counts per part and bit
pattern, at most 32 a part. For a set S of filters, v(S) documents fail at least one filter of S (the removal game). The
potential of a set is found from those of the sets one filter smaller,

    P(S) = (v(S) + sum over i in S of P(S - i)) / |S|,   P({}) = 0,

and a filter's Shapley value is P(all) - P(all - filter): over every order of the filters, what it removes on average. The
potential is kept in sixtieths, which makes it whole, so all figures are exact. What a filter removes at its place in an order
is the difference of v between two coalitions, the filters before it with and without itself.

The filters are ``FILTERS``. Whether a text repeats that of a smaller key is read off SHA-256 digests: a group of copies is
reduced to its smallest key before it is shuffled, rows that agree in everything are counted together, and the two are joined
by digest *and* key, so no group of copies, however large, meets in one task.

Defined results: a NULL text is empty (zero words: fails A, passes B and C), a NULL lang the part ''. A NULL key is neither
smaller nor larger than any, so its row never fails E and has no labels; rows of one key and one text are rows, and none of
them fails E for the others; two labels of one key are merged (1 wins, NULL is 0); an empty table gives an empty result;
further columns are ignored. No text, pattern or part is left out.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, functions as F

from .common import WORD

#: Filter -> condition under which a document fails it; ``copy`` and the measurements are columns. The position is the bit.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 3 * n_chars",
    "D": "has_symbol",
    "E": "copy",
}
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WHOLE = 60  # the least common multiple of the sizes a coalition can have


def facts(docs: DataFrame) -> DataFrame:
    """Key, part, digest of the text and the failure bits of all filters but E."""
    text = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    measured = text.select(
        "key", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").alias("n_chars"), words.alias("words"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"), F.col("text").rlike("[#$%&*|]").alias("has_symbol"))
    measured = measured.select("*", F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))
    bits = [F.expr(f"IF({condition}, {1 << k}, 0)") for k, (name, condition) in enumerate(FILTERS.items()) if name != "E"]
    return measured.select("key", "lang", F.unhex("digest").alias("digest"), sum(bits[1:], bits[0]).alias("bits"))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part and failure bits: ``n``, and of them ``good`` (quality 1) and ``toxic``."""
    rows = facts(docs).groupBy("key", "lang", "digest", "bits").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("digest").agg(F.min("key").alias("key")).where("key IS NOT NULL").withColumn("first", F.lit(True))
    marks = (labels.groupBy(F.col("doc_id").cast("long").alias("key"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("key IS NOT NULL"))
    judged = rows.join(first, ["digest", "key"], "left").join(marks, "key", "left")
    copy = F.col("key").isNotNull() & F.col("first").isNull()
    whole = F.col("bits") + F.when(copy, 1 << list(FILTERS).index("E")).otherwise(0)
    count = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return judged.select("lang", whole.alias("bits"), "n", "good", "toxic").groupBy("lang", "bits").agg(count("good"), count("toxic"), F.sum("n").alias("n"))


def games(counted: DataFrame) -> DataFrame:
    """Per part: ``total``, the games ``v``, ``v_good`` and ``v_toxic`` as arrays over coalitions (position: bits of its
    filters), ``fails`` and ``alone`` per filter, and ``potential`` in sixtieths."""
    every = range(1 << len(FILTERS))
    over = lambda condition, c="n": F.coalesce(F.sum(F.when(F.expr(condition), F.col(c))), F.lit(0))
    game = lambda c: F.array(*[over(f"bits & {s} <> 0", c) for s in every])
    found = counted.groupBy(F.col("lang").alias("part")).agg(
        F.sum("n").alias("total"), game("n").alias("v"), game("good").alias("v_good"), game("toxic").alias("v_toxic"),
        F.array(*[over(f"bits & {1 << k} <> 0") for k in range(len(FILTERS))]).alias("fails"),
        F.array(*[over(f"bits = {1 << k}") for k in range(len(FILTERS))]).alias("alone"))
    smaller = f"aggregate(filter(sequence(0, {len(FILTERS) - 1}), i -> s & shiftleft(1, i) <> 0), 0L, (t, i) -> t + p[s - shiftleft(1, i)])"
    potential = f"aggregate(sequence(1, {len(every) - 1}), array(0L), (p, s) -> array_append(p, ({WHOLE} * v[s] + {smaller}) div bit_count(s)))"
    return found.withColumn("potential", F.expr(potential))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    names, n = "".join(FILTERS), len(FILTERS)
    all_, share = (1 << n) - 1, len(ORDERS) // WHOLE
    steps = (games(patterns(docs, labels)).withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
             .withColumn("i", F.expr(f"instr('{names}', substring(filter_order, step, 1)) - 1"))
             .withColumn("before", F.expr(f"aggregate(sequence(0, {n - 1}), 0, (s, k) -> s + IF(instr(filter_order, substring('{names}', k + 1, 1)) < step, shiftleft(1, k), 0))"))
             .withColumn("after", F.expr("before + shiftleft(1, i)")))
    gain = lambda game: F.expr(f"{game}[after] - {game}[before]")
    return steps.select(
        "part", "filter_order", "step", F.expr("total - v[after]").alias("kept"), gain("v").alias("removed"), F.expr("fails[i] - (v[after] - v[before])").alias("redundant"),
        F.expr("alone[i]").alias("unique_fails"), gain("v_good").alias("good_lost"), gain("v_toxic").alias("toxic_lost"),
        F.expr(f"{share} * (potential[{all_}] - potential[{all_} - shiftleft(1, i)])").alias("shapley"))
