"""Rules, classifier, toxicity."""
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from paneltide.llm import convnet, kneser_ney, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_measures(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té #|A", max_size=60))
def test_measures_equal_brute_force(text):
    assert rules.measure_text(text)[:5] == slow_measures(text)


def test_repeats_with_a_large_vocabulary_take_the_two_step_path(monkeypatch):
    words = [str(i).encode() for i in range(50)] * 2
    assert rules.repeat_words(words) == 100
    assert rules.repeat_words([b"a", b"b", b"c"]) == 0


def test_ledger_of_odd_rows(docs):
    rows = [(None, None), (1, ""), (2, "word " * 60), (2, "word " * 60), (3, " ".join(f"w{i}" for i in range(200)))]
    found = rules.apply_policy(rules.ledger(docs(rows))).orderBy("doc_id").collect()
    assert len(found) == 5
    by = {r.doc_id: r for r in found}
    assert by[None].n_words == 0 and not by[None].kept and not by[1].kept
    assert by[2].n_repeat_words == 60 and not by[2].kept and by[3].kept
    assert rules.ledger(docs([])).count() == 0


def test_ablations_equal_recomputing(docs, prose):
    rows = [(i, t) for i, t in enumerate([prose(80, 1), prose(10, 2), "SHOUT LOUDLY " * 40, "# " * 90, prose(70, 3), "x y z " * 30])]
    entries = rules.ledger(docs(rows))
    bits = [r.failure_bits for r in entries.collect()]
    for r in rules.ablations(entries).collect():
        mask, bit = rules.mask(rules.POLICIES[r.policy]), rules.mask([r.rule])
        assert r.n_failed == sum(b & mask & bit > 0 for b in bits)
        assert r.n_only == sum(b & mask == bit for b in bits)
        assert r.n_kept == sum(b & mask == 0 for b in bits)
        assert r.n_kept_without == sum(b & mask & ~bit == 0 for b in bits)


def test_chunks_cover_the_text_and_pooling_equals_brute_force():
    text = "".join(chr(97 + i % 26) for i in range(1500))
    chunks = convnet.chunks_of(text)
    step = convnet.CHUNK - convnet.OVERLAP
    rebuilt = bytes(chunks[0]) + b"".join(bytes(c[convnet.OVERLAP:]) for c in chunks[1:])
    assert rebuilt.rstrip(b"\0") == text.encode() and len(chunks) == -(-(1500 - convnet.CHUNK) // step) + 1
    net = convnet.ConvNet(filters=3)
    first = chunks[1]
    slow = [max(sum(net.table[k, first[i + k], f] for k in range(convnet.WIDTH)) for i in range(convnet.CHUNK - convnet.WIDTH + 1)) + net.bias[f] for f in range(3)]
    assert np.allclose(net.pooled(chunks)[1], np.maximum(slow, 0), atol=1e-4)


def test_gradient_step_lowers_the_loss_and_learns_a_pattern(prose):
    good = [prose(60, i) for i in range(60)]
    bad = [t.upper().replace(" ", "!! ") for t in good]
    net = convnet.ConvNet().fit(good[:40] + bad[:40], [1] * 40 + [0] * 40, epochs=6)
    assert min(map(net.probability, good[40:])) > 0.7 > 0.5 > max(map(net.probability, bad[40:]))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_classifier_on_odd_rows(spark, docs, prose):
    texts = [(i, prose(50, i) if i % 2 else prose(50, i).upper().replace(" ", "%% ")) for i in range(120)] + [(None, None), (500, ""), (1, prose(50, 1))]
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (3, None, None)])
    found = convnet.classify(docs(texts), labels).collect()
    assert len(found) == len(texts) and all(0 <= r.score <= 1 for r in found)
    for r in found:
        if r.doc_id is None:
            assert not r.held_out
        else:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    unseen = [r for r in found if r.doc_id is not None and 100 <= r.doc_id < 120]
    assert all(r.predicted == r.doc_id % 2 for r in unseen)
    assert convnet.classify(docs([]), labels).count() == 0
    assert {r.score for r in convnet.classify(docs(texts), labels_of(spark, [])).collect()} == {0.5}


def test_held_out_labels_teach_nothing(spark, docs, prose):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    labels = labels_of(spark, [(i, i % 2, i % 2) for i in held])
    assert {r.score for r in convnet.classify(docs([(i, prose(9, i)) for i in held]), labels).collect()} == {0.5}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAB é.\n1", max_size=30), min_size=1, max_size=6))
def test_hashed_words_equal_a_plain_split(texts):
    got = {}
    for at, n, owner, codes in kneser_ney.distinct_words(texts):
        for o, c in zip(owner, codes):
            got.setdefault(at + o, set()).add(int(c))
    code = lambda w: int(kneser_ney.word_classes(np.frombuffer(w, np.uint8))[1][0])
    for k, t in enumerate(texts):
        lowered = re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())
        assert got.get(k, set()) == {code(w) for w in re.findall(rb"[a-z\x80-\xff]+", lowered)}


@given(st.sets(st.integers(0, (1 << kneser_ney.BITS) - 1), max_size=50))
def test_packed_words_come_back(codes):
    rising = np.array(sorted(codes), np.int64)
    assert (kneser_ney.unpacked(kneser_ney.packed(rising)) == rising).all()


def test_counts_equal_brute_force(spark, docs, prose):
    rows = [(i, prose(20, i)) for i in range(40)] + [(None, "ka"), (41, None)]
    labels = labels_of(spark, [(i, 1, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (7, 1, None), (5, 1, 0), (41, 1, 1)])
    counts = kneser_ney.label_counts(docs(rows), labels, "toxic", "key % 4 <> 1", "key % 3 = 2")
    slow = np.zeros_like(counts)
    for i, t in rows:
        if i is None or i % 4 == 1 or i == 41:
            continue
        y = int(i % 3 == 0)
        for _, _, _, codes in kneser_ney.distinct_words([t]):
            slow[int(i % 3 == 2), y, codes] += 1
        slow[int(i % 3 == 2), y, -1] += 1
    assert (counts == slow).all()


def test_shared_backoff_leaves_rare_words_neutral():
    counts = np.zeros((2, (1 << kneser_ney.BITS) + 1))
    counts[:, :2000], counts[:, -1] = 40, [1000, 1000]
    counts[:, 5], counts[:, 9] = [0, 300], [0, 1]
    ratio = kneser_ney.Model(counts).ratio
    assert ratio[5] > 0.3 and ratio[9] == 0 and ratio[100] == 0


def test_toxicity_learns_and_handles_odd_rows(spark, docs, prose):
    rude = lambda i: i % 4 == 0
    rows = [(i, prose(60, i) + (" Grumbold! scoffle you snarkit" if rude(i) else "")) for i in range(600)] + [(None, None), (900, ""), (901, "12 34"), (3, prose(60, 3))]
    labels = labels_of(spark, [(i, 1, int(rude(i))) for i in range(500)])
    found = kneser_ney.classify(docs(rows), labels).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            assert r.predicted == int(r.doc_id < 600 and rude(r.doc_id)), r
        assert 0 <= r.score <= 1
    assert kneser_ney.classify(docs([]), labels).count() == 0
    assert {r.score for r in kneser_ney.classify(docs(rows), labels_of(spark, [])).collect()} == {0.0}


@pytest.mark.parametrize("n", [0, 1, 10])
def test_powers_invert(n):
    up, down = kneser_ney.powers(n)
    assert (up[:n + 1] * down[:n + 1] == 1).all()


def test_final_counts_cover_all_rows_that_may_be_learnt_from(spark, docs, prose):
    rows = [(i, prose(60, i) + (" Grumbold! scoffle you snarkit" if i % 4 == 0 else "")) for i in range(400)]
    labels = labels_of(spark, [(i, 1, int(i % 4 == 0)) for i in range(400)])
    counts = kneser_ney.label_counts(docs(rows), labels, "toxic", "crc32(cast(cast(key AS string) AS binary)) % 5 <> 0").sum(axis=0)
    assert counts[:, -1].sum() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400))
    assert (kneser_ney.fit(docs(rows), labels).ratio == kneser_ney.Model(counts).ratio).all()


def slow_likelihoods(taught, text):
    """Mean logarithm of the pair probabilities of a text, per label, written out; ``taught`` are (label, text)."""
    words = lambda t: re.findall(rb"[a-z\x80-\xff]+", t.encode().lower())
    steps = lambda t: list(zip([None, *words(t)], words(t)))
    every = {p for _, t in taught for p in steps(t)}
    out = []
    for label in (0, 1):
        counts = Counter(p for y, t in taught if y == label for p in steps(t))
        once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
        discount = (once + 1) / (once + 2 * twice + 3)
        logs = []
        for v, w in steps(text):
            shared = (sum(b == w for _, b in every) + 1) / (len(every) + (1 << kneser_ney.BITS))
            seen, after = sum(n for (a, _), n in counts.items() if a == v), sum(a == v for a, _ in counts)
            logs.append(np.log(max(counts[v, w] - discount, 0) / seen + discount * after / seen * shared if seen else shared))
        out.append(np.mean(logs) if logs else 0.0)
    return out


def test_likelihoods_equal_brute_force_pair_models(spark, docs, prose):
    rude = lambda i: i % 3 == 0
    rows = [(i, prose(12, i) + (" trash trash you trash." if rude(i) else " You trash")) for i in range(60)] + [(200, ""), (201, None), (202, "trash you trash you"), (203, "trash trash you you"), (None, "ka unseen")]
    labels = labels_of(spark, [(i, 1, int(rude(i))) for i in range(60)])
    taught = [(int(rude(i)), t) for i, t in rows[:60] if zlib.crc32(str(i).encode()) % 5]
    found = {r.doc_id: r for r in kneser_ney.classify(docs(rows), labels).collect()}
    for i, t in rows:
        ordinary, toxic = slow_likelihoods(taught, t or "")
        assert found[i].ll_ordinary == pytest.approx(ordinary, rel=1e-5) and found[i].ll_toxic == pytest.approx(toxic, rel=1e-5), i
    assert found[202].ll_toxic != pytest.approx(found[203].ll_toxic, rel=1e-3)  # the same words, another order


def test_pair_counts_cover_every_occurrence(spark, docs):
    rows = [(1, "ab cd ab cd"), (2, "ab cd"), (3, "cd"), (4, "no label"), (5, ""), (None, "ab cd")]
    sums = kneser_ney.pair_sums(docs(rows), labels_of(spark, [(1, 0, 1), (2, 0, 0), (3, 0, 1), (5, 0, 1), (None, 0, 1)]), "toxic", "key < 9", "key = 3").collect()
    total = lambda part: int(sum(np.frombuffer(r.counts, np.int64).sum() for r in sums if r.part == part))
    half = lambda part: [int(sum(np.frombuffer(r.counts, f"<u{len(r.counts) // (2 * kneser_ney.CLASSES)}").reshape(2, -1)[k].sum() for r in sums if r.part == part)) for k in (0, 1)]
    assert [half(k) for k in range(4)] == [[2, 2], [4, 3], [2, 2], [5, 4]]  # ordinary, toxic: first half, then all
    assert [total(k) for k in range(4, 14)] == [2, 4, 2, 3, 3, 2, 5, 2, 4, 4]
    assert sum(np.frombuffer(r.counts, np.int64) for r in sums if r.part == 14).tolist() == [2, 0, 2, 1, 2, 0, 3, 1]


def test_word_sums_follow_the_words_and_not_the_classes(spark, docs):
    rows = [(i, "ab cd ab cd") for i in range(40)]
    sums = kneser_ney.pair_sums(docs(rows).repartition(8), labels_of(spark, [(i, 0, i % 2) for i in range(40)]), "toxic", "key < 40", "key % 4 = 3").collect()
    assert sum(len(r.counts) for r in sums if r.part >= 4) < 4000  # a slice of word classes in full takes 32,768 bytes
    assert sum(kneser_ney.dense(r.at, r.counts).sum() for r in sums if r.part in (4, 5, 9, 10)) == 4 * (30 + 40)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, kneser_ney.WIDTH - 1), st.integers(1, 1 << 60), max_size=20), st.booleans())
def test_sparse_slices_come_back(found, full):
    counts = np.full(kneser_ney.WIDTH, int(full), np.int64)
    counts[list(found)] = list(found.values())
    assert (kneser_ney.dense(*kneser_ney.sparse(counts)) == counts).all()
