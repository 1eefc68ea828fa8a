"""SimHash, components, vector search, mixing."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paneltide.llm import components, mixing, multi_index, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(points, linked):
    parent = list(range(len(points)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(points)):
        for j in range(i):
            if linked(points[i], points[j]):
                parent[top(i)] = top(j)
    return [top(k) for k in range(len(points))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\tÉ Z", max_size=60))
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == slow_print(text)


def test_tree_finds_exactly_what_lies_within_the_radius():
    chance = random.Random(3)
    centres = [chance.getrandbits(64) for _ in range(5)]
    points = list({c ^ sum(1 << chance.randrange(64) for _ in range(chance.randrange(5))) & (1 << 64) - 1 for c in centres for _ in range(60)})
    tree = simhash.BKTree()
    for k, p in enumerate(points):
        assert sorted(tree.add(p)) == [j for j in range(k) if (points[j] ^ p).bit_count() <= 2]


def test_links_connect_what_brute_force_connects(spark):
    chance = random.Random(4)
    points = set()
    for _ in range(12):
        p = chance.getrandbits(64)
        for _ in range(25):  # a chain drifts far from where it began
            points.add(p)
            for _ in range(chance.randrange(1, 4)):
                p ^= 1 << chance.randrange(64)
    points = sorted(points)
    links = simhash.near_links(spark.createDataFrame([(simhash.signed(p),) for p in points], "fp long"))
    found = {r.node: r.root for r in components.connected(links).collect()}
    roots = slow_roots(points, lambda a, b: (a ^ b).bit_count() <= 2)
    groups, slow = defaultdict(set), defaultdict(set)
    for p, r in zip(points, roots):
        groups[found.get(simhash.signed(p), simhash.signed(p))].add(p)
        slow[r].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_components_of_paths_stars_and_odd_links(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3), (5, None)]
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(found) == {*range(41), *range(100, 140), 200, 201}
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in range(100, 140)} == {100} and found[201] == found[200]
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_few_links_are_few_files(spark, monkeypatch):
    files, cut = [], components.cut_lineage

    def counted(df, name):
        out = cut(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "cut_lineage", counted)
    links = spark.createDataFrame([(k, k + 1) for k in range(400) if k % 20], "a long, b long")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        found = [{r.node: r.root for r in components.connected(links).collect()}]
        assert len(files) > 4 and max(files[1:]) == 1
        monkeypatch.setattr(components, "FILE_ROWS", 100)
        found.append({r.node: r.root for r in components.connected(links).collect()})
    finally:
        spark.conf.unset(key)
    assert found[0] == found[1] == {k: (k - 1) // 20 * 20 + 1 for k in range(1, 401)}


def test_duplicates_with_odd_rows(docs, prose):
    text = prose(300, 1)
    near = text.rsplit(" ", 1)[0] + " changed"
    rows = [(5, text), (9, text.upper()), (7, near), (7, near), (20, prose(300, 2)), (None, text), (30, None), (31, ""), (None, " \n"), (40, prose(300, 7)), (None, prose(300, 8))]
    found = simhash.components(docs(rows)).collect()
    prints = [slow_print(t or "") for _, t in rows]
    roots = slow_roots(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {r: min((rows[k][0] for k in range(len(rows)) if roots[k] == r and rows[k][0] is not None), default=None) for r in roots}
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == Counter((rows[k][0], prints[k], least[roots[k]]) for k in range(len(rows)))
    assert simhash.components(docs([])).count() == 0


def slow_search(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (q, v) in enumerate(good):
        if q % 20 == 0:
            near = sorted(((-(v * w).sum(), i) for j, (i, w) in enumerate(good) if i != q))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def test_search_with_odd_vectors_ties_and_copies(spark):
    chance = random.Random(1)
    rows = [(i, [chance.randrange(-3, 4) / 2 for _ in range(4)]) for i in range(200)]
    rows += [(1000 + i, [0.5, 0.5, -0.5, 1.0]) for i in range(80)]
    rows += [(2000, None), (None, [1.0, 1.0, 1.0, 1.0]), (2020, [0.0] * 4), (2040, [1.0, None, 0.0, 0.0]), (2060, [1.0, float("nan"), 0.0, 0.0]), (2080, [float("inf"), 0.0, 0.0, 0.0]),
             (2100, [1.0]), (2120, [-0.0, 1.0, 0.0, 0.0]), (2121, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS q", "2 AS score", "3 AS h")
    found = sorted(tuple(r) for r in multi_index.search(df, recall=1.0, cells_each=3).collect())
    assert found == sorted(slow_search(rows, 20))
    few = [r for r in rows[:8]]
    assert sorted(tuple(r) for r in multi_index.search(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect()) == sorted(slow_search(few, 20))
    assert multi_index.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 10)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(240)]
    found = sorted(tuple(r) for r in multi_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), recall=1.0, cells_each=4).collect())
    assert [r[:3] for r in found] == [r[:3] for r in sorted(slow_search(rows, 20))]


def test_cells_come_in_falling_order_each_once():
    rng = np.random.default_rng(0)
    sample = rng.normal(size=(300, 8))
    index = multi_index.MultiIndex(sample, 6)
    counts = np.ones((6, 6), int).tolist()
    order = list(index.visit(sample[0], counts, np.inf))
    sums = [index.centres[0][i] @ sample[0][:4] + index.centres[1][j] @ sample[0][4:] for i, j in order]
    uneven = rng.integers(0, 9, (6, 6))
    seen, at = 0, {}
    for i, j in index.visit(sample[0], np.maximum(uneven, 1).tolist(), np.inf):
        seen += max(int(uneven[i, j]), 1)
        at[i, j] = seen
    i, j = map(np.array, zip(*at))
    assert index.seen_before(sample[0], np.maximum(uneven, 1), i, j).tolist() == list(at.values())
    assert len(set(order)) == 36 and all(a >= b - 1e-12 for a, b in zip(sums, sums[1:]))


def test_recall_on_random_directions(spark):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(3000, 16))
    points /= np.linalg.norm(points, axis=1)[:, None]
    found = multi_index.search(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")).collect()
    got = defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 20):
        s = points @ points[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hits / (150 * 20) >= 0.9


def test_clustered_vectors_are_found_by_few_visits(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(60, 16)) * 3
    points = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)) * 0.15
    visits = []
    learn = multi_index.learn_visits
    monkeypatch.setattr(multi_index, "learn_visits", lambda *a: visits.append(learn(*a)) or visits[0])
    found = multi_index.search(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")).collect()
    got = defaultdict(set)
    for r in found:
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 20):
        s = points @ points[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & got[q])
    assert hits / (300 * 20) >= 0.95 and visits[0] < 1500


def slow_targets(sizes, weights=(5, 2, 1)):
    order = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while len(fixed) < len(sizes):
        level = (total - sum(fixed.values())) / sum(w[k] for k in sizes if k not in fixed)
        over = [k for k in sizes if k not in fixed and level * w[k] > 2 * sizes[k] + 1e-12]
        if not over:
            return fixed | {k: level * w[k] for k in sizes if k not in fixed}
        fixed |= {k: 2.0 * sizes[k] for k in over}
    return fixed


def test_targets_equal_repeated_resharing(spark):
    chance = random.Random(2)
    for n in (1, 2, 5, 9):
        sizes = {chr(97 + i): chance.choice([0, 1, 5, 40, 900]) for i in range(n)} | ({None: 30} if n > 2 else {})
        df = spark.createDataFrame([("" if k is None else "=" + k, v) for k, v in sizes.items()], "src string, source_size long")
        found = {r.src[1:] or None: r.target for r in mixing.targets(df).collect()}
        slow = slow_targets(sizes)
        assert all(abs(found[k] - slow[k]) < 1e-9 * max(1, slow[k]) for k in sizes)


def test_mix_with_odd_rows(docs, prose):
    chance = random.Random(8)
    rows = [(i, prose(chance.randrange(1, 60), i), chance.choice("aaaabcd")) for i in range(300)] + [(None, None, "a"), (400, "", None), (401, prose(30, 5), None)] + [(500, "one two three", "b")] * 40
    found = mixing.mixed_sizes(docs(rows)).collect()
    assert len(found) == len(rows)
    sizes, taken = Counter(), Counter()
    by_id = {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    target = slow_targets(dict(sizes))
    for r in found:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes)
    again = mixing.mixed_sizes(docs(rows).repartition(7, F.rand(1))).collect()
    assert Counter((r.doc_id, r.taken) for r in found) == Counter((r.doc_id, r.taken) for r in again)
    assert mixing.mixed_sizes(docs([])).count() == 0
    df = docs(rows)
    full = mixing.mixture(df)
    assert full.columns == df.columns
    words = Counter()
    for r in full.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert all(words[s] == taken[s] for s in sizes)


def test_better_documents_are_drawn_more_often(docs):
    """The third source gets five sixths of its size, so a sixth of its documents is left out: mostly poor ones."""
    rows = [(i, "plain words here now" if i % 2 else "%% ## && $$", "c") for i in range(400)] + [(1000 + i, "w w w w", "ab"[i % 2]) for i in range(800)]
    found = mixing.mixed_sizes(docs(rows)).where("doc_id < 400").collect()
    assert abs(found[0].target - found[0].source_size * 5 / 6) < 1e-6
    share = lambda odd: np.mean([r.taken / 4 for r in found if r.doc_id % 2 == odd])
    assert share(1) > 0.9 > share(0) + 0.05


def test_no_document_comes_more_than_twice(docs):
    """Empty texts before the edge of a source that is taken exactly twice."""
    rows = [(i, "" if i % 3 else "word", "a") for i in range(30)] + [(100 + i, "w " * 50, "b") for i in range(40)]
    copies = Counter(r.doc_id for r in mixing.mixture(docs(rows)).collect())
    assert max(copies.values()) == 2 and all(copies[i] == 2 for i in range(0, 30, 3))
