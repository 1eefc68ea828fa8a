"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of one to three characters (code points of the lower-cased text, a blank at either end) are hashed into ``2**BITS``
features. A feature's value in a text is its share of the text's grams times its inverse document frequency; document
frequencies are counted in Spark over *all* documents that may be learnt from, as vectors that every task adds up first.

Weights are fitted on a bounded sample by follow-the-regularised-leader with one learning rate per coordinate and elastic-net
penalties: the L1 part keeps most weights at exactly zero, and features without weights cost nothing to score. Three quarters
of the sample teach; on the last quarter one temperature is fitted that divides all logits, so that the score of the predicted
language is an honest probability.

The sample holds at most ``fit_rows`` documents: those with the smallest hash of the key in each language, first ranks first,
so rare languages are not drowned. It is repeatable and does not grow with the corpus; its texts become gram counts in the tasks,
at most ``2**BITS`` a text, before they reach the driver. Everything scored is scored whole, a long text in pieces.

Defined results: ``und`` and score 0 where the text is NULL or has no letter, or where nothing can be learnt; with one language
learnt it is predicted with score 1; a NULL key is scored, not held out and teaches nothing, as does a NULL lang; an empty lang is
a language; equal probabilities go to the first language by code point; repeated rows teach once and are all scored; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import fold_of, map_batches, texts

BITS = 18
SIZE = 1 << BITS
PIECE = 1 << 20  # code points looked at together
SLICES = 64
FIT_ROWS, EPOCHS = 4000, 4
UNKNOWN = "und"
# Odd multipliers of the positions of a gram, one row per length.
FACTORS = [np.array(row, np.uint32) for row in ([0x9E3779B1], [0x85EBCA77, 0xC2B2AE3D], [0x27D4EB2F, 0x165667B1, 0xD3A2646D])]


def grams(text: str):
    """Features of all grams, in pieces that overlap by what a gram can reach."""
    marked = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    for at in range(0, max(len(marked) - 2, 1), PIECE):
        part = marked[at:at + PIECE + 2]
        last = at + PIECE + 2 >= len(marked)
        for factors in FACTORS:
            n = len(part) - len(factors) + 1 if last else min(PIECE, len(part) - len(factors) + 1)
            if n > 0:
                mixed = part[:n] * factors[0]
                for k in range(1, len(factors)):
                    mixed += part[k:k + n] * factors[k]
                mixed ^= mixed >> np.uint32(15)
                yield (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and how often each occurs."""
    parts = list(grams(text))
    total = np.zeros(SIZE, np.int64)
    for part in parts:
        total += np.bincount(part, minlength=SIZE)
    found = np.flatnonzero(total)
    return found, total[found]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def learnable(docs: DataFrame, learnt: str) -> DataFrame:
    """key, lang and text of the documents that may teach."""
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where(F.col("key").isNotNull() & F.col("lang").isNotNull()).where(learnt)


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, per feature, texts that hold it. Tasks hand on sums, in slices; sums of slices reach the driver."""
    width = SIZE // SLICES

    def count(batches):
        total, n, seen = np.zeros(SIZE, np.int64), 0, np.zeros(SIZE, bool)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                seen[:] = False
                for part in grams(text):
                    seen[part] = True
                total += seen
        if n:
            some = [k for k in range(SLICES) if total[k * width:(k + 1) * width].any()]
            yield {"slice": [-1, *some], "counts": [np.array([n], np.int64).tobytes(), *(total[k * width:(k + 1) * width].tobytes() for k in some)]}

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(counts, np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield {"slice": list(sums), "counts": [v.tobytes() for v in sums.values()]}

    schema = "slice int, counts binary"
    found = map_batches(map_batches(rows.select("text"), count, schema).repartition("slice"), add, schema).toArrow()  # SLICES + 1 rows
    total, n = np.zeros(SIZE, np.int64), 0
    for k, counts in zip(found["slice"].to_pylist(), found["counts"].to_pylist()):
        part = np.frombuffer(counts, np.int64)
        if k < 0:
            n = int(part[0])
        else:
            total[k * width:(k + 1) * width] = part
    return n, total


def training_sample(rows: DataFrame, fit_rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, features, counts) of at most ``fit_rows`` documents, in a repeatable order without pattern."""
    hashed = rows.select("key", "lang", F.xxhash64("text").alias("hash"), F.xxhash64("key").alias("draw")).distinct()
    place = Window.partitionBy("lang").orderBy("draw", "key", "hash")
    ranked = hashed.withColumn("place", F.row_number().over(place)).where(F.col("place") <= fit_rows)
    drawn = ranked.orderBy("place", "lang").limit(fit_rows).select("key", "lang", "hash")
    chosen = (rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(drawn), ["key", "lang", "hash"])  # fit_rows keys at most
              .dropDuplicates(["key", "lang", "hash"]).withColumn("draw", F.xxhash64("key")))

    def work(batches):
        for batch in batches:
            found = [counted(t) for t in batch.column("text").to_pylist()]
            yield {c: batch.column(c) for c in ("key", "lang", "hash", "draw")} | {
                "features": [f.astype(np.int32).tobytes() for f, _ in found], "counts": [c.astype(np.int32).tobytes() for _, c in found]}

    got = map_batches(chosen.select("key", "lang", "hash", "draw", "text"), work, "key long, lang string, hash long, draw long, features binary, counts binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["draw"], r["key"], r["lang"], r["hash"]))
    return [(r["lang"], np.frombuffer(r["features"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in got]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


class Model:
    """``rows[h]`` is the row of feature h in ``table`` (0: no weights), which holds weight times inverse document frequency."""

    def __init__(self, langs: list[str], idf: np.ndarray, scale: float = 40.0):
        self.langs, self.idf, self.scale, self.temperature = langs, idf.astype(np.float64), scale, 1.0
        self.rows, self.table, self.bias = np.zeros(SIZE, np.int32), np.zeros((1, len(langs))), np.zeros(len(langs))

    def values(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.scale * counts / counts.sum() * self.idf[features]

    def fit(self, sample, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, seed: int = 3) -> Model:
        """FTRL-proximal: ``z`` are adjusted gradient sums, ``n`` sums of squared gradients; weights follow from both."""
        z, n = np.zeros((SIZE + 1, len(self.langs))), np.zeros((SIZE + 1, len(self.langs)))
        place = {lang: k for k, lang in enumerate(self.langs)}

        def weights(at, penalty):
            zs = z[at]
            return np.where(np.abs(zs) <= penalty, 0, (np.sign(zs) * penalty - zs) / ((beta + np.sqrt(n[at])) / alpha + l2))

        rng, cases = np.random.default_rng(seed), [(place[lang], f, self.values(f, c)) for lang, f, c in sample]
        for _ in range(epochs):
            for k in rng.permutation(len(cases)):
                y, features, x = cases[k]
                at, x = np.append(features, SIZE), np.append(x, 1.0)  # the last row is the level, which is not penalised
                w = weights(at, np.where(at == SIZE, 0, l1)[:, None])
                error = softmax(x @ w)
                error[y] -= 1
                gradient = x[:, None] * error
                z[at] += gradient - (np.sqrt(n[at] + gradient ** 2) - np.sqrt(n[at])) / alpha * w
                n[at] += gradient ** 2
        every = weights(np.arange(SIZE), l1)
        used = np.flatnonzero(every.any(axis=1))
        self.rows[used] = np.arange(1, len(used) + 1)
        self.table = np.concatenate([np.zeros((1, len(self.langs))), every[used] * self.idf[used, None]])
        self.bias = weights(np.array([SIZE]), 0)[0]
        return self

    def logits(self, parts) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for part in parts:
            n += len(part)
            found = self.rows[part]
            if len(found) > 2 * len(self.table):
                total += np.bincount(found, minlength=len(self.table)) @ self.table
            else:
                total += self.table[found[found > 0]].sum(axis=0)
        return self.scale * total / max(n, 1) + self.bias

    def calibrate(self, sample) -> Model:
        """The temperature with the least log loss, by golden section over its logarithm. As in Platt's rule the targets stop
        short of one, by what so many cases can tell; else a faultless sample would ask for certainty."""
        place = {lang: k for k, lang in enumerate(self.langs)}
        logits = np.array([self.logits([np.repeat(f, c)]) for _, f, c in sample]).reshape(len(sample), len(self.langs))
        y = np.array([place[lang] for lang, _, _ in sample], int)
        if not len(y):
            return self

        doubt = 1 / (len(y) + 2)
        target = np.full(logits.shape, doubt / max(len(self.langs) - 1, 1))
        target[np.arange(len(y)), y] = 1 - doubt if len(self.langs) > 1 else 1

        def loss(t):
            scaled = logits / np.exp(t)
            top = scaled.max(axis=1)
            return float((top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - (target * scaled).sum(axis=1)).mean())

        low, high, golden = -3.0, 3.0, (5 ** 0.5 - 1) / 2
        for _ in range(40):
            a, b = high - golden * (high - low), low + golden * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(grams(text)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit(docs: DataFrame, learnt: str = "crc32(cast(cast(key AS string) AS binary)) % 4 <> 2", fit_rows: int = FIT_ROWS) -> Model:
    rows = learnable(docs, learnt)
    sample = training_sample(rows, fit_rows)
    n, frequencies = document_frequencies(rows)
    langs = sorted({lang for lang, _, _ in sample})
    model = Model(langs, np.log((1 + n) / (1 + frequencies)) + 1)
    teach, tune = [s for k, s in enumerate(sample) if k % 4], sample[::4]
    known = {lang for lang, _, _ in teach}
    if known < set(langs):  # of a language met once, that document must teach
        teach += [s for s in tune if s[0] not in known]
    return model.fit(teach).calibrate(tune)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    def work(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_batches(texts(docs), work, "doc_id long, lang_pred string, score double")


def classify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    found = identify(docs, fit(docs, fit_rows=fit_rows))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
