"""Byte-level convolutional quality classifier in numpy.

A text is cut into overlapping chunks of ``CHUNK`` bytes that together cover all of it. Learned filters of ``WIDTH`` bytes run
over every chunk; each filter's largest response in the chunk is kept, the pooled responses of all chunks are averaged, and a
logistic unit turns them into one probability. The filters are fitted by gradient descent on labelled rows; scoring runs in
Arrow batches and never looks at anything but the text.

Fitting uses at most ``fit_rows`` labelled documents, those with the smallest hash of the key, so the sample is repeatable and
its size does not grow with the corpus. Everything scored is scored whole.

Defined results: NULL and empty texts are one chunk of padding and get that chunk's probability; NULL keys are scored and are
not held out; rows without a label (or a NULL one) teach nothing; without labels of both kinds the score is the mean label
(0.5 without any); an empty table gives an empty result; repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import fold_of, map_batches, texts

CHUNK, OVERLAP, WIDTH = 512, 32, 5
AT_ONCE = 96  # chunks in one step of scoring


def chunks_of(text: str) -> np.ndarray:
    """Overlapping chunks, zero-padded at the end: shape (chunks, CHUNK)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    step = CHUNK - OVERLAP
    n = 1 + max(0, -(-(len(raw) - CHUNK) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[:len(raw)] = raw
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (step, 1))


class ConvNet:
    """``table[k, byte]`` holds the filters' weights of a byte at offset k, ``out`` the weights of the pooled responses."""

    def __init__(self, filters: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.out = rng.normal(0, 0.3, filters).astype(np.float32)
        self.level = np.float32(0)

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        span = CHUNK - WIDTH + 1
        total = np.take(self.table[0], chunks[:, :span], axis=0)
        for k in range(1, WIDTH):
            total += np.take(self.table[k], chunks[:, k:k + span], axis=0)
        return total

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each chunk, above zero."""
        parts = [self.responses(chunks[i:i + AT_ONCE]).max(axis=1) for i in range(0, len(chunks), AT_ONCE)]
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def probability(self, text: str) -> float:
        z = float(self.pooled(chunks_of(text)).mean(axis=0, dtype=np.float64) @ self.out.astype(np.float64) + self.level)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, samples: list[str], labels: list[int], epochs: int = 8, batch: int = 32, rate: float = 0.02, seed: int = 7) -> ConvNet:
        """Adam on the log loss; the gradient of a maximum reaches only the position that attained it."""
        rng, y = np.random.default_rng(seed), np.asarray(labels, np.float32)
        names = ["table", "bias", "out", "level"]
        first, second = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2))
        step = 0
        cut = [chunks_of(t) for t in samples]
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(cut)), max(1, len(cut) // batch)):
                chunks = np.concatenate([cut[i] for i in at])
                counts = np.array([len(cut[i]) for i in at])
                owner = np.repeat(np.arange(len(at)), counts)
                best, where = [], []
                for i in range(0, len(chunks), AT_ONCE):
                    r = self.responses(chunks[i:i + AT_ONCE])
                    p = r.argmax(axis=1)
                    where.append(p)
                    best.append(np.take_along_axis(r, p[:, None, :], 1)[:, 0])
                raw, where = np.concatenate(best) + self.bias, np.concatenate(where)
                pooled = np.maximum(raw, 0)
                mean = np.zeros((len(at), pooled.shape[1]), np.float32)
                np.add.at(mean, owner, pooled)
                mean /= counts[:, None]
                error = (1 / (1 + np.exp(-np.clip(mean @ self.out + self.level, -30, 30))) - y[at]) / len(at)
                inner = (error[:, None] * self.out / counts[:, None])[owner] * (raw > 0)
                grads = {"table": np.zeros_like(self.table), "bias": inner.sum(0), "out": mean.T @ error, "level": error.sum()}
                f = np.arange(pooled.shape[1])
                for k in range(WIDTH):
                    np.add.at(grads["table"][k], (np.take_along_axis(chunks, where + k, 1), f[None, :]), inner)
                step += 1
                slow = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * grads[n]
                    second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                    move = slow * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-7)
                    setattr(self, n, (getattr(self, n) - move).astype(np.float32))
        return self


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learnt: str, fit_rows: int) -> list[tuple[str, int]]:
    """At most ``fit_rows`` labelled texts: keys are drawn from the labels alone, then their texts are fetched."""
    known = (labels.select(F.col("doc_id").cast("long").alias("key"), F.col(label).cast("int").alias("label"))
             .where(F.col("key").isNotNull() & F.col("label").isin(0, 1)).where(learnt))
    drawn = known.orderBy(F.xxhash64("key"), "key", "label").limit(fit_rows)
    found = texts(docs).join(F.broadcast(drawn), F.col("doc_id") == F.col("key")).select("key", "text", "label").orderBy(F.xxhash64("key"), "key", "label", F.xxhash64("text")).limit(2 * fit_rows)
    rows = sorted((r.key, r.text, r.label) for r in found.collect())
    return [(t, y) for _, t, y in rows]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learnt: str = "crc32(cast(cast(key AS string) AS binary)) % 4 <> 2",
        fit_rows: int = 2000) -> ConvNet | float:
    sample = training_sample(docs, labels, label, learnt, fit_rows)
    kinds = {y for _, y in sample}
    if len(kinds) < 2:
        return float(np.mean([y for _, y in sample])) if sample else 0.5
    return ConvNet().fit([t for t, _ in sample], [y for _, y in sample])


def score(docs: DataFrame, model: ConvNet | float) -> DataFrame:
    """doc_id and the probability that the label is 1, for every row."""
    def work(batches):
        for batch in batches:
            probs = [model if isinstance(model, float) else model.probability(t) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "score": probs}

    return map_batches(texts(docs), work, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = 2000) -> DataFrame:
    scored = score(docs, fit(docs, labels, fit_rows=fit_rows))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
