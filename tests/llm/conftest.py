import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """DataFrame of (doc_id, text[, source]) rows with the columns of ``documents`` and some that clash with inner names."""
    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if extra:
            for name in ("row", "score", "key", "fp", "size", "label", "n", "words", "spans", "hash", "src", "bucket", "copies"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Words of a small vocabulary, repeatably random."""
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ner", "tu", "sha", "vor", "pel") for b in ("ran", "dish", "met", "go", "s", "ling", "")]

    def make(n, seed):
        chance = random.Random(seed)
        return " ".join(chance.choice(vocabulary) for _ in range(n))

    return make
