"""Class-conditional Kneser-Ney toxicity scores.

Words (runs of letters, A-Z lower-cased) are hashed into ``2**BITS`` classes. Each label has a model of word pairs over *all*
labelled rows that may be learnt from: every occurrence of a word ``w`` after a word ``v`` (the first word of a text after a start
mark) is counted, the counts are discounted absolutely, and the mass the discount frees goes to a distribution both labels share,
made of continuation counts, the number of distinct words that ``w`` follows in texts of either label:

    P(w | v, label) = max(c_label(v w) - D_label, 0) / c_label(v) + D_label * followers_label(v) / c_label(v) * P_shared(w)
    P_shared(w)     = (preceding(w) + 1) / (sum of preceding + 2**BITS)

``followers`` counts the distinct words after ``v``; after a word the label has not seen the shared distribution stands alone. D is
n1 / (n1 + 2 n2) by the number of pairs the label has once and twice, both raised by one. Spark counts pairs, followers and
continuations exactly; for scoring the discounted counts of the pairs are added up in ``2**PAIR_BITS`` classes, so a worker's tables have
a fixed size. ``ll_toxic`` and ``ll_ordinary`` are the logarithms of a text's probability over its number of words, in their order.

Few words of a toxic text are toxic, so in a long text they drown in that average. A second feature weighs words by the documents they
occur in, the discounts scaled by the size of the label so that both leave equally rare words to the shared counts: the sum over a text's
distinct words of the log-likelihood ratio, where it exceeds ``margin`` times the highest ratio a word can have, over the square
root of their number. A logistic curve of ``ll_toxic - ll_ordinary`` and this evidence, fitted on a quarter of the labelled rows (at
most ``fit_rows`` of them, those with the smallest hash) while only the other three are counted, gives the probability.

Defined results: NULL, empty and wordless texts have likelihoods and evidence 0 and the score the curve gives them; NULL keys are
scored, not held out and teach nothing; NULL labels teach nothing; a key labelled several times teaches once per distinct label; without
rows of both labels the score is the mean label (0 without any) and the likelihoods are NULL; repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from paneltide.session import cut_lineage, drop_stage

from .common import fold_of, in_slices, map_batches, texts

BITS = 18
START = 1 << BITS  # stands before the first word of a text
PAIR_BITS = 20
BUCKET_BITS = 11  # pairs are shuffled by the upper bits of their class
WIDTH = 1 << 12  # entries of a slice of a vector over words
SLICES = START // WIDTH + 1
CLASSES = 1 << 8  # and over pair classes, which come in twos: small, as a reader holds thousands of rows
GRAMS = 1 << 19  # pairs a worker holds before it adds them up
GROUP_BYTES = 1 << 18
SUMS = "part int, slice int, at binary, counts binary"  # a slice of a vector: positions and values of what is not zero
ROWS = 16  # slices a worker hands on at a time
BASE = 0x9E3779B97F4A7C15
FOLD = np.zeros(256, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_classes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and class of each word: a polynomial hash read off running sums, then mixed."""
    letters = FOLD[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = letters > 0
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters * up[:len(raw)], dtype=np.uint64, out=sums[1:])
    code = (sums[ends] - sums[starts]) * down[starts]
    code ^= code >> np.uint64(33)
    code *= np.uint64(0xFF51AFD7ED558CCD)
    return starts, (code >> np.uint64(64 - BITS)).astype(np.int64)


def word_sequences(texts_: list[str]):
    """Yields (first text, number of texts, owner, word class) per group of texts: each text's words in their order."""
    at = 0
    while at < len(texts_):
        parts, size, end = [], 0, at
        while end < len(texts_) and (end == at or size < GROUP_BYTES):
            parts.append(texts_[end].encode())
            size += len(parts[-1]) + 1
            end += 1
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
        starts, codes = word_classes(np.frombuffer(b"\n".join(parts), np.uint8))
        yield at, end - at, np.searchsorted(bounds, starts, "right") - 1, codes
        at = end


def distinct(owner: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct words, rising."""
    keys = np.unique(owner << BITS | codes)
    return keys >> BITS, keys & (1 << BITS) - 1


def distinct_words(texts_: list[str]):
    """As ``word_sequences``, each text's distinct words."""
    for at, n, owner, codes in word_sequences(texts_):
        yield at, n, *distinct(owner, codes)


def word_pairs(owner: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Every word with the one before it in its text, as one number."""
    before = np.full(len(codes), START, np.int64)
    before[1:] = np.where(owner[1:] == owner[:-1], codes[:-1], START)
    return before << BITS | codes


def pair_classes(pairs: np.ndarray) -> np.ndarray:
    code = pairs.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD)
    code ^= code >> np.uint64(33)
    code *= np.uint64(BASE)
    return (code >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def packed(codes: np.ndarray) -> bytes:
    """Rising word classes in two bytes each: how many begin with each pair of upper bits, then the lower sixteen."""
    return np.bincount(codes >> 16, minlength=1 << (BITS - 16)).astype("<u4").tobytes() + (codes & 0xFFFF).astype("<u2").tobytes()


def unpacked(words: bytes) -> np.ndarray:
    kinds = 1 << (BITS - 16)
    upper = np.frombuffer(words, "<u4", kinds)
    return np.repeat(np.arange(kinds) << 16, upper) | np.frombuffer(words, "<u2", offset=4 * kinds)


def labelled_words(docs: DataFrame, labels: DataFrame, label: str, counted: str, second: str, encode) -> DataFrame:
    """part (label, plus two in the second half) and ``encode``d words of each labelled row ``counted`` admits."""
    known = (labels.select(F.col("doc_id").cast("long").alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1)).distinct().where(counted)
             .select("key", (F.col("label") + 2 * F.expr(second).cast("int")).alias("part")))
    hashed = map_batches(texts(docs).withColumnRenamed("doc_id", "key").where(F.col("key").isNotNull()).where(counted).withColumnRenamed("key", "doc_id"),
                         encode, "key long, words binary")
    return hashed.join(known.hint("merge"), "key").select("part", "words")  # at every size the same way


def sparse(counts: np.ndarray) -> tuple[bytes | None, bytes]:
    """Positions of what is not zero, in two bytes, and its values; no positions where that is everything."""
    at = np.flatnonzero(counts)
    return None if len(at) == len(counts) else at.astype("<u2").tobytes(), counts[at].tobytes()


def dense(at: bytes | None, counts: bytes) -> np.ndarray:
    found = np.frombuffer(counts, np.int64)
    if at is None:
        return found
    out = np.zeros(WIDTH, np.int64)
    out[np.frombuffer(at, "<u2")] = found
    return out


def in_rows(slices):
    """(part, slice, counts) as rows of SUMS, a few at a time: a task has seen few of the words, so what it hands on follows its input and not
    the number of word classes."""
    rows = []
    for y, k, counts in slices:
        if counts.any():
            rows.append((y, k, *sparse(counts)))
        if len(rows) == ROWS:
            yield dict(zip(("part", "slice", "at", "counts"), zip(*rows)))
            rows = []
    if rows:
        yield dict(zip(("part", "slice", "at", "counts"), zip(*rows)))


def merge(batches):
    """Sums of the slices of each part, in full: the driver gets as much whatever the input."""
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for y, k, at, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "slice", "at", "counts"))):
            sums[y, k] = sums.get((y, k), 0) + dense(at, counts)
    yield {"part": [y for y, _ in sums], "slice": [k for _, k in sums], "at": [None] * len(sums), "counts": [v.tobytes() for v in sums.values()]}


def label_counts(docs: DataFrame, labels: DataFrame, label: str, counted: str, second: str = "false") -> np.ndarray:
    """Documents per (half, label, word class) over all labelled rows ``counted`` admits; ``second`` tells the second half.
    Shape (2, 2, 2**BITS + 1), the last column holds the number of documents. Texts are hashed once, only hashed words are
    shuffled; each task adds up before that and hands on its sums as slices of vectors."""
    def encode(batches):
        for batch in in_slices(batches):
            words = []
            for _, n, owner, codes in distinct_words(batch.column("text").to_pylist()):
                words += [packed(c) for c in np.split(codes, np.searchsorted(owner, np.arange(1, n)))]
            yield {"key": batch.column("doc_id"), "words": words}

    def add_up(batches):
        total = np.zeros((4, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for y, words in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist()):
                total[y, unpacked(words)] += 1
                total[y, -1] += 1
        yield from in_rows((y, k, total[y, k * WIDTH:(k + 1) * WIDTH]) for y in range(4) for k in range(SLICES))

    parts = map_batches(labelled_words(docs, labels, label, counted, second, encode), add_up, SUMS)
    return put_together(map_batches(parts.repartition("part", "slice"), merge, SUMS))  # one row per part and slice


def put_together(sums: DataFrame) -> np.ndarray:
    sums, counts = sums.toArrow(), np.zeros((4, START + 1))
    for y, k, at, part in zip(*(sums[c].to_pylist() for c in ("part", "slice", "at", "counts"))):
        counts[y, k * WIDTH:(k + 1) * WIDTH] = dense(at, part)
    return counts.reshape(2, 2, -1)


def pair_sums(docs: DataFrame, labels: DataFrame, label: str, counted: str, second: str = "false") -> DataFrame:
    """What the models of word pairs need, as slices of vectors (SUMS) that are still to be added up, over the rows ``label_counts``
    counts.

    With m for the model (0: the first half, 1: all rows), y for the label: parts 2m + y hold per slice of pair classes the occurrences,
    then the distinct pairs, once each and in as many bytes as the largest needs; parts 4 + 5m + y per word the occurrences before another word, 6 + 5m + y the distinct words after it,
    8 + 5m the distinct words it follows in either label; part 14 the pairs met once and twice; parts 15 to 18 the
    ``label_counts``, half by half, each slice once. Texts travel as three bytes a word;
    each task adds its pairs up before they are shuffled by bucket, where every pair is then seen whole."""
    def encode(batches):
        for batch in in_slices(batches):
            words = []
            for _, n, owner, codes in word_sequences(batch.column("text").to_pylist()):
                words += [(c & 0xFFFF).astype("<u2").tobytes() + (c >> 16).astype(np.uint8).tobytes() for c in np.split(codes, np.searchsorted(owner, np.arange(1, n)))]
            yield {"key": batch.column("doc_id"), "words": words}

    def add_up(batches):
        held, size, total = [], 0, np.zeros((4, START + 1), np.int64)

        def sums():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            bucket = pair_classes(keys >> 2) >> (PAIR_BITS - BUCKET_BITS)
            order = np.argsort(bucket, kind="stable")
            keys, n, found = keys[order], n[order], np.unique(bucket)
            edges = np.searchsorted(bucket[order], found[1:])
            return {"bucket": found, "pairs": [(k & 0xFFFFFFFF).astype("<u4").tobytes() + (k >> 32).astype(np.uint8).tobytes() + c.astype("<u4").tobytes()
                                               for k, c in zip(np.split(keys, edges), np.split(n, edges))]}

        for batch in batches:
            for y, words in zip(batch.column("part"), batch.column("words")):
                raw = memoryview(words.as_buffer())
                n = len(raw) // 3
                codes = np.frombuffer(raw, "<u2", n).astype(np.int64) | np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.int64) << 16
                total[y.as_py(), np.unique(codes)] += 1
                total[y.as_py(), -1] += 1
                held.append(word_pairs(np.zeros(n, np.int64), codes) << 2 | y.as_py())
                size += n
                if size >= GRAMS:
                    yield sums()
                    held, size = [], 0
        if size:
            yield sums()
        for y in range(4):
            cut = [(-1 - y * SLICES - k, c, np.flatnonzero(c)) for k in range(SLICES) for c in [total[y, k * WIDTH:(k + 1) * WIDTH]]]
            yield {"bucket": [k for k, _, at in cut if len(at)], "pairs": [at.astype("<u2").tobytes() + c[at].astype("<u4").tobytes() for _, c, at in cut if len(at)]}

    def buckets(batches):
        """Bucket and its pairs with their occurrences per part, or negative number and slice of documents; the rows come in order of buckets."""
        last, held = None, []
        for batch in batches:
            for k, packed_ in zip(batch.column("bucket").to_pylist(), batch.column("pairs").to_pylist()):
                if k != last and held:
                    yield last, *(whole(held) if last >= 0 else (held[0], None))
                    held = []
                last = k
                if k < 0:
                    held, n = held or [np.zeros(WIDTH, np.int64)], len(packed_) // 6
                    held[0][np.frombuffer(packed_, "<u2", n)] += np.frombuffer(packed_, "<u4", n, 2 * n)
                    continue
                n = len(packed_) // 9
                held.append((np.frombuffer(packed_, "<u4", n).astype(np.int64) | np.frombuffer(packed_, np.uint8, n, 4 * n).astype(np.int64) << 32,
                             np.frombuffer(packed_, "<u4", n, 5 * n)))
        if held:
            yield last, *(whole(held) if last >= 0 else (held[0], None))

    def whole(held):
        keys, n = (np.concatenate(c) for c in zip(*held))
        pairs, at = np.unique(keys >> 2, return_inverse=True)
        return pairs, np.stack([np.bincount(at[keys & 3 == k], n[keys & 3 == k], len(pairs)) for k in range(4)]).astype(np.int64)

    def reduce(batches):
        words, few, wide = np.zeros((10, START + 1), np.int64), np.zeros(8, np.int64), 1 << (PAIR_BITS - BUCKET_BITS)
        for k, pairs, n in buckets(batches):
            if n is None:
                y, k = divmod(-1 - k, SLICES)
                yield from in_rows([(15 + y, k, pairs[:START + 1 - k * WIDTH])])
                continue
            here, v, w, out = pair_classes(pairs) & (wide - 1), pairs >> BITS, pairs & (START - 1), []
            for m, c in enumerate((n[:2], n[:2] + n[2:])):
                for y in (0, 1):
                    met = c[y] > 0
                    np.add.at(words[5 * m + y], v, c[y])
                    np.add.at(words[5 * m + 2 + y], v[met], 1)
                    few[4 * m + 2 * y:4 * m + 2 * y + 2] += (c[y] == 1).sum(), (c[y] == 2).sum()
                    both = np.stack([np.bincount(here, c[y], wide), np.bincount(here[met], minlength=wide)]).astype(np.int64)
                    out += [(2 * m + y, k * wide // CLASSES + i, None, part.astype(np.min_scalar_type(part.max())).tobytes()) for i, part in enumerate(np.split(both, wide // CLASSES, axis=1)) if part.any()]
                np.add.at(words[5 * m + 4], w[c.any(0)], 1)
            yield dict(zip(("part", "slice", "at", "counts"), zip(*out)))
        yield from in_rows((4 + j, k, words[j, k * WIDTH:(k + 1) * WIDTH]) for j in range(10) for k in range(SLICES))
        yield {"part": [14], "slice": [0], "at": [None], "counts": [few.tobytes()]}

    rows = map_batches(labelled_words(docs, labels, label, counted, second, encode), add_up, "bucket int, pairs binary")
    return map_batches(rows.repartition("bucket").sortWithinPartitions("bucket"), reduce, SUMS)


class Pairs:
    """Both labels' models of word pairs, from the rows of ``pair_sums``; the tables are broadcast, once for all jobs."""

    def __init__(self, sums: DataFrame, m: int):
        words, few = np.zeros((5, START + 1)), np.zeros(8)
        vectors = sums.where(F.col("part").between(4 + 5 * m, 8 + 5 * m) | (F.col("part") == 14)).repartition("part", "slice")
        for row in map_batches(vectors, merge, SUMS).toArrow().to_pylist():
            found = dense(row["at"], row["counts"])
            if row["part"] == 14:
                few = found
            else:
                words[row["part"] - 4 - 5 * m, row["slice"] * WIDTH:row["slice"] * WIDTH + len(found)] = found
        once, twice = few[4 * m:4 * m + 4:2], few[4 * m + 1:4 * m + 4:2]
        discount = (once + 1) / (once + 2 * twice + 3)
        seen, after = words[:2], words[2:4]
        inverse = (1 / np.maximum(seen, 1)).astype(np.float32)
        back = np.where(seen > 0, discount[:, None] * after / np.maximum(seen, 1), 1).astype(np.float32)
        shared = ((words[4, :-1] + 1) / (words[4].sum() + START)).astype(np.float32)

        def discounted(batches):
            for batch in batches:
                found = [np.frombuffer(c, f"<u{len(c) // (2 * CLASSES)}").reshape(2, -1) for c in batch.column("counts").to_pylist()]
                label = [y & 1 for y in batch.column("part").to_pylist()]
                yield {"label": label, "slice": batch.column("slice"), "kept": [(n - discount[y] * kinds).astype(np.float32).tobytes() for y, (n, kinds) in zip(label, found)]}

        kept = np.zeros((2, 1 << PAIR_BITS), np.float32)
        for batch in map_batches(sums.where(F.col("part").between(2 * m, 2 * m + 1)), discounted, "label int, slice int, kept binary").toArrow().to_batches():
            for y, k, part in zip(*(batch.column(c).to_pylist() for c in ("label", "slice", "kept"))):
                kept[y, k * CLASSES:(k + 1) * CLASSES] = np.frombuffer(part, np.float32)
        self.tables = sums.sparkSession.sparkContext.broadcast((inverse, back, shared, kept))

    def likelihoods(self, n: int, owner: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Mean logarithm of a word's probability per text and label."""
        pairs = word_pairs(owner, codes)
        before, at = pairs >> BITS, pair_classes(pairs)
        length = np.maximum(np.bincount(owner, minlength=n), 1)
        inverse, back, shared, kept = self.tables.value
        least = shared[codes].astype(np.float64)
        return np.stack([np.bincount(owner, np.log(kept[y][at] * inverse[y][before] + back[y][before] * least), n) / length for y in (0, 1)], 1)


class Model:
    """Models of word pairs, log-likelihood ratio per word class and the curve from both to probability."""

    def __init__(self, counts: np.ndarray, pairs: Pairs | None = None, discount: float = 2.5, backoff: float = 0.8, margin: float = 0.8):
        words = counts[:, :-1]
        shared = (words.sum(0) + 1e-6) / (words.sum(0) + 1e-6).sum()
        size = np.maximum(words.sum(1), 1)
        kept = [np.maximum(words[y] - discount * size[y] / size.min(), 0) for y in (0, 1)]
        ordinary, toxic = ((1 - backoff) * k / max(k.sum(), 1e-9) + backoff * shared for k in kept)
        ratio = np.log(toxic / ordinary)
        highest = np.log1p((1 - backoff) / backoff * (1 + size[0] / size[1]))  # of a word that only toxic texts use
        self.ratio = np.where(ratio > margin * highest, ratio, 0).astype(np.float32)
        self.pairs = pairs
        self.slope, self.level = np.array([0.0, 1.0]), 0.0

    def measures(self, texts_: list[str]) -> np.ndarray:
        """Per text its log-likelihood a word in the ordinary and the toxic model, and its evidence."""
        out = np.zeros((len(texts_), 3))
        for at, n, owner, codes in word_sequences(texts_):
            if self.pairs:
                out[at:at + n, :2] = self.pairs.likelihoods(n, owner, codes)
            owner, codes = distinct(owner, codes)
            total = np.bincount(owner, self.ratio[codes].astype(np.float64), n)
            out[at:at + n, 2] = total / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
        return out

    def calibrate(self, measures: np.ndarray, y: np.ndarray) -> Model:
        """Newton steps of a lightly damped logistic fit."""
        x = features(measures)
        centre, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1.0)
        design, w = np.hstack([(x - centre) / scale, np.ones((len(x), 1))]), np.zeros(3)
        damping = np.array([0.05, 0.05, 0])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(damping + [0, 0, 1e-6])
            move = np.linalg.solve(hessian, design.T @ (y - p) - damping * w)
            w += np.clip(move, -2, 2)
        self.slope, self.level = w[:2] / scale, w[2] - (w[:2] * centre / scale).sum()
        return self

    def curve(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(measures) @ self.slope + self.level, -30, 30)))

    def probability(self, texts_: list[str]) -> np.ndarray:
        return self.curve(self.measures(texts_))


def features(measures: np.ndarray) -> np.ndarray:
    return np.stack([measures[:, 1] - measures[:, 0], measures[:, 2]], 1)


def scored(docs: DataFrame, model: Model | float) -> DataFrame:
    def work(batches):
        for batch in in_slices(batches):
            given = batch.column("text").to_pylist()
            if isinstance(model, float):
                none = [None] * len(given)
                yield {"doc_id": batch.column("doc_id"), "score": np.full(len(given), model), "ll_toxic": none, "ll_ordinary": none, "evidence": none}
            else:
                found = model.measures(given)
                yield {"doc_id": batch.column("doc_id"), "score": model.curve(found), "ll_toxic": found[:, 1], "ll_ordinary": found[:, 0], "evidence": found[:, 2]}

    return map_batches(texts(docs), work, "doc_id long, score double, ll_toxic double, ll_ordinary double, evidence double")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learnt: str = "crc32(cast(cast(key AS string) AS binary)) % 5 <> 0", fit_rows: int = 20_000) -> Model | float:
    """Fits the curve on a sample of a quarter of the rows that may be learnt from, against counts of the other three; the
    final model counts them all."""
    second = "pmod(xxhash64(key), 4) = 0"
    pairs = cut_lineage(pair_sums(docs, labels, label, learnt, second), "word-pairs")
    halves = put_together(pairs.where("part >= 15").select((F.col("part") - 15).alias("part"), "slice", "at", "counts"))
    counts, every = halves[0], halves.sum(axis=0)
    held = (labels.select(F.col("doc_id").cast("long").alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1)).distinct()
            .where(f"({learnt}) AND {second}").orderBy(F.xxhash64("key"), "key", "label").limit(fit_rows))
    n = every[:, -1]
    if not counts[:, -1].all():
        drop_stage(pairs)
        return float(n[1] / max(n.sum(), 1))
    model = Model(counts, Pairs(pairs, 0))
    rows = scored(docs.join(F.broadcast(held.select(F.col("key").alias("doc_id")).distinct()), "doc_id", "left_semi"), model).join(
        held.withColumnRenamed("key", "doc_id"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "evidence", "ll_toxic", "ll_ordinary", "label").limit(2 * fit_rows).select(
        "ll_ordinary", "ll_toxic", "evidence", "label").toArrow()
    model.pairs.tables.destroy()
    x, y = np.stack([rows[c].to_numpy() for c in ("ll_ordinary", "ll_toxic", "evidence")], 1), rows["label"].to_numpy()
    if len(set(y)) < 2:
        drop_stage(pairs)
        return float(n[1] / n.sum())
    curve = model.calibrate(x, y)
    whole = Model(every, Pairs(pairs, 1))
    whole.slope, whole.level = curve.slope, curve.level
    drop_stage(pairs)
    return whole


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_rows: int = 20_000) -> DataFrame:
    found = scored(docs, fit(docs, labels, fit_rows=fit_rows))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "ll_toxic", "ll_ordinary")
