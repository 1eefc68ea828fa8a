"""Quality rules as a bitmask ledger.

Every text is measured once and every rule evaluated once; the ledger keeps the measurements and one bit per failed rule.
Policies are versioned sets of rules, so a new policy, or the effect of leaving a rule out, needs only integer operations
on the ledger and never the text.

Defined results: a NULL text counts as empty (no words, fails ``too_short``); a NULL key is kept as NULL; repeated rows
give repeated ledger rows; an empty table gives an empty ledger; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import BLANKS, each_text, map_batches, texts

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]

#: Rule -> condition under which it fails. The position in this list is the bit; append only, never reorder.
RULES = {
    "too_short": "n_words < 50",
    "repeated_passages": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "4 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines",
    "odd_word_length": "word_chars < 2 * n_words OR word_chars > 16 * n_words",
    "shouting": "n_letters >= 20 AND 2 * n_upper > n_letters",
}
#: Policy version -> the rules it enforces.
POLICIES = {
    "base": ["too_short", "repeated_passages"],
    "2024a": ["too_short", "repeated_passages", "symbol_heavy", "shouting"],
    "2024b": list(RULES),
}
CURRENT = "2024b"


def mask(rules: list[str]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in rules)


def repeat_words(words: list[bytes]) -> int:
    """Words standing in a three-word window that occurs at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    kinds = len(seen)
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds > 2_000_000:  # the product of three would overflow
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, where, counts = np.unique(pairs[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k:n - 2 + k] |= twice
    return int(marked.sum())


def measure_text(text: str) -> tuple:
    raw = text.encode()
    words = raw.split()
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    return (len(words), len(text) - without(BLANKS), without(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines),
            without(UPPER), without(LETTERS))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: key, measurements, ``failure_bits`` (bit k: rule k failed)."""
    measured = map_batches(texts(docs, id_col, text_col), each_text(measure_text, MEASURES),
                           "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, condition in enumerate(RULES.values())]
    return measured.withColumn("failure_bits", sum(bits[1:], bits[0]).cast("long"))


def apply_policy(entries: DataFrame, policy: str = CURRENT, into: str = "kept") -> DataFrame:
    """Adds whether a document passes every rule of the policy."""
    return entries.withColumn(into, F.col("failure_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablations(entries: DataFrame) -> DataFrame:
    """Per policy and rule: documents the rule fails, documents that only this rule rejects, and what the policy keeps with
    and without it. The ledger is reduced to counts per bit pattern first, at most two to the number of rules."""
    patterns = entries.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    order = list(RULES)
    cases = [F.struct(F.lit(p).alias("policy"), F.lit(mask(POLICIES[p])).cast("long").alias("mask"), F.lit(r).alias("rule"),
                      F.lit(1 << order.index(r)).cast("long").alias("bit")) for p in POLICIES for r in POLICIES[p]]
    rows = patterns.select("failure_bits", "n", F.inline(F.array(*cases)))
    failed = F.col("failure_bits").bitwiseAND(F.col("mask"))
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return rows.groupBy("policy", "rule").agg(
        count(failed.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), count(failed == F.col("bit")).alias("n_only"),
        count(failed == 0).alias("n_kept"), count(failed.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        F.bit_or("failure_bits").alias("bits_seen"))
