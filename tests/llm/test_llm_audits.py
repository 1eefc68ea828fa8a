"""Source divergence, language identification, filter interaction."""
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial, log

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from paneltide.llm import divergence, filter_audit, language

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# source divergence ------------------------------------------------------------------------------------------------------

def slow_divergence(rows, min_docs=10, top=10):
    """rows: (text, lang, source)."""
    rows = [(t or "", g or "", s or "") for t, g, s in rows]
    found = [(TERM.findall(lowered(t)), g, s) for t, g, s in rows]
    docs = Counter((g, w) for ws, g, _ in found for w in set(ws))
    kept = {k for k, n in docs.items() if n >= min_docs}
    counts = Counter((g, s, w) for ws, g, s in found for w in ws if (g, w) in kept)
    out = []
    share = lambda c, n, v: 1 + (10 ** 9 * (c + 2)) // (n + 2 * v)
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g for _, g, _ in rows}:
        terms = [w for g, w in kept if g == lang]
        sources = {s for _, g, s in rows if g == lang}
        p = {}
        for s in sources:
            n = sum(counts[lang, s, w] for w in terms)
            p[s] = {w: share(counts[lang, s, w], n, len(terms)) for w in terms}
        whole = sum(counts[lang, s, w] for s in sources for w in terms)
        q = {w: share(sum(counts[lang, s, w] for s in sources), whole, len(terms)) for w in terms}
        for s in sources:
            pairs = sorted(((sum(apart(p[s][w], p[o][w]) for w in terms), o) for o in sources if o != s), key=lambda x: (-x[0], x[1].encode()))
            words = sorted(((apart(p[s][w], q[w]), w) for w in terms if counts[lang, s, w] and p[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, value, k + 1) for part, best in (("pair", pairs), ("term", words)) for k, (value, item) in enumerate(best)]
    return Counter(out)


def frame_of(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string").selectExpr(
        "*", "'x' AS term", "1 AS gid", "2 AS lid", "'y' AS chunk", "3 AS row", "4 AS rank")


def found_of(df):
    return Counter(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_equals_brute_force(spark, prose):
    odd = ["The the, THE. the;x", "x-y x/y X", "É é Éa aÉ\u0085b", "12 # |", "", None, "a\tb\x0bc\x0cd\re\nf", "\x1ca\x1cb", " lead and trail "]
    rows = [(prose(30, i) + " " + odd[i % len(odd)] if odd[i % len(odd)] is not None else prose(5, i), ["en", "de", None, ""][i % 4], ["s0", "s1", None, "", "é", "Z"][i % 6]) for i in range(90)]
    rows += [(t, "xx", "none") for t in odd] + [("#", "xx", "empty"), (None, None, None)] + [("same words here", "en", "hot")] * 40
    assert found_of(divergence.audit(frame_of(spark, rows))) == slow_divergence(rows)
    assert found_of(divergence.audit(frame_of(spark, rows), min_docs=3, top=2, buckets=3)) == slow_divergence(rows, 3, 2)


def test_terms_at_the_border_are_counted_without_repeats(spark):
    """Nine or ten documents hold a term in several chunks, none of which is in ten documents."""
    rows = [(f"nine, nine; ({i}nine", "en", "a") for i in range(9)] + [(f"ten. ten! {i}ten", "en", "b") for i in range(5)] + [(f"ten ten: ten{i}", "en", "c") for i in range(5)]
    found = found_of(divergence.audit(frame_of(spark, rows)))
    assert found == slow_divergence(rows) and {r[3] for r in found if r[2] == "term"} <= {"ten"}


def test_divergence_of_nothing(spark):
    assert divergence.audit(frame_of(spark, [])).count() == 0
    rows = [("rare words", "en", "a"), ("only", "en", "b"), (None, "de", "a")]
    assert found_of(divergence.audit(frame_of(spark, rows))) == Counter([("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)])


def test_blocks_and_batches_do_not_matter(spark, prose, monkeypatch):
    rows = [(prose(40, i % 7) + f" w{i % 5}", "en", f"s{i % 3}") for i in range(120)]
    expected = slow_divergence(rows)
    docs = frame_of(spark, rows).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert found_of(divergence.audit(docs)) == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="aAb é,\t\n", max_size=25), st.integers(1, 2), st.integers(0, 1)), max_size=8), st.integers(1, 4))
def test_a_block_says_each_chunk_once(cases, min_docs):
    rows = np.arange(len(cases))
    lids = np.array([c[1] for c in cases], int)
    gids = np.array([2 * c[1] + c[2] for c in cases], int)
    got = divergence.factor(pa.array([c[0] for c in cases], pa.string()), rows, lids, gids, min_docs).to_pylist()
    seen = {(r["chunk"], r["lid"]): r for r in got}
    assert len(seen) == len(got)
    expected = defaultdict(Counter)
    holds = defaultdict(set)
    for k, (text, lid, s) in enumerate(cases):
        for w in WORD.findall(lowered(text)):
            expected[w, lid][2 * lid + s] += 1
            holds[w, lid].add(k)
    assert set(seen) == set(expected)
    for key, r in seen.items():
        assert dict(zip(r["gids"], r["counts"])) == expected[key] and r["n_docs"] == len(holds[key])
        assert set(r["rows"]) == (holds[key] if len(holds[key]) < min_docs else set())


def test_dense_sums_equal_single_ones():
    import pandas as pd

    groups = pd.DataFrame({"gid": [9, 4, 7], "p0": [3, 5, 1]})
    terms = pd.DataFrame({"gid": [4, 9, 4, 7], "term": ["a", "a", "b", "c"], "p": [10 ** 9 + 1, 8, 20, 30]})
    p = {"a": {4: 10 ** 9 + 1, 7: 1, 9: 8}, "b": {4: 20, 7: 1, 9: 3}, "c": {4: 5, 7: 30, 9: 3}}
    found = {(r.a, r.b): r.value for r in divergence.compared(terms, groups).itertuples()}
    assert found == {(a, b): sum((p[t][a] - p[t][b]) ** 2 // (p[t][a] + p[t][b]) for t in p) for a, b in ((4, 7), (4, 9), (7, 9))}


# language ---------------------------------------------------------------------------------------------------------------

def spoken(lang, i, n=40):
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["shra", "eup", "öz"], "cc": ["ñi", "tte", "we"]}[lang]
    state = zlib.crc32(f"{lang}{i}".encode())
    words = []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        words.append("".join(syllables[(state >> k) % 3] for k in (3, 7, 11)))
    return " ".join(words)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30), st.integers(1, 9))
def test_grams_cover_the_text_in_pieces(text, piece):
    whole = Counter(np.concatenate(list(language.grams(text))).tolist())
    before, language.PIECE = language.PIECE, piece
    try:
        parts = list(language.grams(text))
    finally:
        language.PIECE = before
    assert Counter(np.concatenate(parts).tolist()) == whole
    n = len(text.lower()) + 2
    assert sum(whole.values()) == n + (n - 1) + max(n - 2, 0)
    slow = Counter()
    marked = f" {text.lower()} "
    for factors in language.FACTORS:
        for i in range(len(marked) - len(factors) + 1):
            h = sum(ord(marked[i + k]) * int(f) for k, f in enumerate(factors)) % (1 << 32)
            h ^= h >> 15
            slow[(h * 0x2C1B3C6D) % (1 << 32) >> (32 - language.BITS)] += 1
    assert slow == whole


def test_document_frequencies_cover_every_text(spark):
    texts = ["abc", "abc abc", "", "xyz"] * 30
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    n, found = language.document_frequencies(rows)
    slow = np.zeros(language.SIZE, int)
    for t in texts:
        slow[language.counted(t)[0]] += 1
    assert n == len(texts) and (found == slow).all()
    n, found = language.document_frequencies(rows.where("text = 'no'"))
    assert n == 0 and not found.any()


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS key", "'y' AS hash", "'z' AS place", "1 AS score", "2 AS draw")


def test_language_on_unseen_and_odd_rows(spark):
    rows = [(i, spoken(lang, i), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    odd = [(None, None, "aa"), (None, spoken("aa", 900), "zz"), (1000, "", "aa"), (1001, "12 # 3", "bb"), (1002, "é", None), (1003, spoken("bb", 901), None), (3, rows[3][1], rows[3][2])]
    odd.append((1004, spoken("cc", 902, 60000), None))
    found = language.classify(docs_of(spark, rows + odd)).collect()
    assert len(found) == len(rows) + len(odd)
    of = {r.doc_id: r for r in found}
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred in ("aa", "bb", "cc", "und") and 0 <= r.score <= 1
    assert all(of[i].lang_pred == lang for i, _, lang in rows)
    assert sorted(r.lang_pred for r in found if r.doc_id is None) == ["aa", "und"]
    assert [of[k].lang_pred for k in (1000, 1001)] == ["und", "und"] and of[1000].score == 0
    assert of[1002].lang_pred != "und" and of[1003].lang_pred == "bb" and of[1004].lang_pred == "cc"
    assert language.classify(docs_of(spark, rows + odd)).collect() == found


def test_only_rows_that_may_teach_do(spark):
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, spoken("aa", i), "aa") for i in held] + [(None, "aa", "aa"), (301, "bb", None)]
    assert {(r.lang_pred, r.score) for r in language.classify(docs_of(spark, rows)).collect()} == {("und", 0.0)}
    assert language.classify(docs_of(spark, [])).count() == 0
    rows = [(i, spoken("aa", i), "") for i in range(20)] + [(21, "!", "x")]
    assert {(r.lang_pred, r.score) for r in language.classify(docs_of(spark, rows[:20])).collect()} == {("", 1.0)}
    sample = language.training_sample(language.learnable(docs_of(spark, [(i % 30, spoken("bb", i % 2), "abc"[i % 3]) for i in range(300)]), "true"), 12)
    assert len(sample) == 12 and {s[0] for s in sample} == {"a", "b", "c"}


def test_one_step_of_the_leader_equals_the_formula():
    """One case, one round: weights are zero, so the gradient is the value times (probability - target)."""
    features, counts = np.array([5, 9], np.int32), np.array([3, 1], np.int32)
    model = language.Model(["x", "y"], np.full(language.SIZE, 2.0))
    model.fit([("y", features, counts)], epochs=1, alpha=0.3, beta=1.0, l1=0.5, l2=0.01)
    for f, c in ((5, 3), (9, 1)):
        value = 40.0 * c / 4 * 2.0
        for k, sign in ((0, 1), (1, -1)):
            gradient = sign * value / 2
            z, n = gradient, gradient ** 2
            weight = 0 if abs(z) <= 0.5 else (np.sign(z) * 0.5 - z) / ((1 + np.sqrt(n)) / 0.3 + 0.01)
            assert np.isclose(model.table[model.rows[f], k], weight * 2.0)
    assert len(model.table) == 3
    assert len(language.Model(["x", "y"], np.ones(language.SIZE)).fit([("y", features, counts)], epochs=1, l1=1e6).table) == 1


def test_the_temperature_has_the_least_loss():
    model = language.Model(["x", "y"], np.ones(language.SIZE))
    model.rows[5], model.table = 1, np.array([[0, 0], [0.05, -0.05]])
    sample = [("x", np.array([5]), np.array([1]))] * 30 + [("y", np.array([5]), np.array([1]))] * 10
    model.calibrate(sample)
    p = 1 / (1 + np.exp(-4.0 / model.temperature))
    doubt = 1 / 42
    assert abs(p - (0.75 * (1 - doubt) + 0.25 * doubt)) < 1e-3
    model.temperature = 1.0
    assert model.calibrate([]).temperature == 1.0


# filter interaction -----------------------------------------------------------------------------------------------------

def slow_bits(text):
    words = WORD.findall(text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            "D": any(c in "#$%&*|" for c in text)}


def slow_audit(rows, labels):
    docs = []
    for key, text, lang in rows:
        bad = slow_bits(text or "")
        bad["E"] = key is not None and any(k is not None and k < key and (t or "") == (text or "") for k, t, _ in rows)
        docs.append((lang or "", bad, any(k is not None and k == key and q == 1 for k, q, _ in labels), any(k is not None and k == key and t == 1 for k, _, t in labels)))
    out, total = {}, defaultdict(int)
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if d[1][f]]
                redundant = sum(d[1][f] for d in gone)
                left = [d for d in left if not d[1][f]]
                gone += removed
                unique = sum(d[0] == part and d[1][f] and sum(d[1].values()) == 1 for d in docs)
                out[part, "".join(order), step] = (len(left), len(removed), redundant, unique, sum(d[2] for d in removed), sum(d[3] for d in removed))
                total[part, f] += len(removed)
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def judged(spark):
    def make(rows, labels):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'x' AS digest", "2 AS bits", "'y' AS key", "3 AS part", "true AS first")
        return df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    return make


def test_audit_equals_brute_force(judged, prose):
    texts = [" ".join(f"w{k}" for k in range(250)), prose(20, 1), prose(300, 2), "SHOUT " * 250, "# " + prose(10, 3), "", None, prose(20, 1), "a" * 300, "é" * 33 + "A", "é" * 34 + "A"]
    rows = [(i, texts[i % len(texts)], ["en", "de", None, ""][i % 4]) for i in range(60)]
    rows += [(None, texts[0], "en"), (None, texts[0], "en"), (7, texts[7], "de"), (7, texts[0], "en"), (7, texts[0], "en"), (-5, texts[3], "xx"), (-5, texts[3], "yy")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60, 2)] + [(4, 1, None), (None, 1, 1), (8, None, 1), (-5, 1, 1)]
    df, marks = judged(rows, labels)
    found = filter_audit.audit(df, marks)
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in found.collect()} == slow_audit(rows, labels)
    empty, none = judged([], [])
    assert filter_audit.audit(empty, none).count() == 0
    assert {tuple(r) for r in filter_audit.audit(df, none).collect()} == slow_audit(rows, [])


def test_potential_gives_shapley_values(judged, spark):
    """Against the definition: marginal contributions weighed by the number of orders."""
    counted = spark.createDataFrame([("p", b, 3 * b % 7 + 1, 0, 0) for b in range(32)], "lang string, bits int, n long, good long, toxic long")
    game = filter_audit.games(counted).first()
    count = {b: 3 * b % 7 + 1 for b in range(32)}
    v = [sum(n for b, n in count.items() if b & s) for s in range(32)]
    assert list(game.v) == v
    for i in range(5):
        value = Fraction(0)
        for size in range(5):
            for others in combinations([k for k in range(5) if k != i], size):
                s = sum(1 << k for k in others)
                value += Fraction(factorial(size) * factorial(4 - size), factorial(5)) * (v[s | 1 << i] - v[s])
        assert Fraction(game.potential[31] - game.potential[31 - (1 << i)], filter_audit.WHOLE) == value
