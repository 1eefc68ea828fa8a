"""The pipeline's stages, each against brute force on its own input, and the registry."""
import os
import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import compare, oracle_rows
from paneltide.llm import kneser_ney, queries, simhash, stages
from test_llm_near import slow_print, slow_roots
from test_llm_text import slow_spans

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


def test_registry():
    assert [len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


@needs_data
@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_matches_statement(spark, key):
    df = queries.QUERIES[key](spark, FOLDER)
    names, _, expected = oracle_rows(queries.ORACLES[key], FOLDER)
    assert compare(df.columns, [tuple(r) for r in df.collect()], names, expected) is None


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxic_rows_go_whatever_else_they_hold(spark, docs, prose, tmp_path):
    rude = lambda i: i % 4 == 0
    rows = [(i, prose(60, i) + (" Grumbold! scoffle you snarkit" if rude(i) else "")) for i in range(600)]
    rows += [(None, None), (900, ""), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1]), (4, rows[4][1])]
    spark.createDataFrame([(i, 1, int(rude(i))) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = docs(rows)
    out = stages.drop_toxic(spark, df, str(tmp_path))
    assert out.columns == df.columns and out.dtypes == df.dtypes
    expected = Counter((i, t) for i, t in rows if t is None or "snarkit" not in t)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == expected
    assert stages.drop_toxic(spark, docs([]), str(tmp_path)).count() == 0
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert stages.drop_toxic(spark, df, f"{tmp_path}/none").count() == len(rows)


def test_one_of_each_group_stays(spark, docs, prose):
    base = [prose(200, i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t + " extra") for i, t in enumerate(base)] + [(3, base[3])] * 4 + [(None, base[4]), (None, "only nulls here"), (None, "only nulls here"), (50, None), (51, "")]
    df = docs(rows)
    kept = stages.keep_one_of_each(spark, df, "")
    assert kept.columns == df.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    prints = [slow_print(t or "") for _, t in rows]
    roots = slow_roots(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = defaultdict(list)
    for k, r in enumerate(roots):
        groups[r].append(rows[k])
    assert len(found) == len(groups)
    for group in groups.values():
        here = [x for x in found if x in group]
        ids = [i for i, _ in group if i is not None]
        assert len(here) == 1 and here[0][0] == (min(ids) if ids else None)
    assert stages.keep_one_of_each(spark, docs([]), "").count() == 0


def test_redaction_keeps_rows_and_columns(spark, docs):
    rows = [(1, "mail a@b.cd now"), (2, None), (None, "+1 206 555 0100"), (3, "clean text"), (3, "clean text")]
    df = docs(rows)
    out = stages.redact(spark, df, "")
    assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
    found = Counter((r.doc_id, r.text, r.n_chars) for r in out.collect())
    assert found == Counter([(1, "mail <EMAIL> now", 16), (2, None, None), (None, "<PHONE>", 7), (3, "clean text", 10), (3, "clean text", 10)])


@needs_data
def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = kneser_ney.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = after.collect()
        if name == "toxicity":
            score = {r.doc_id: model if isinstance(model, float) else model.probability([r.text])[0] for r in before}
            assert Counter(rows) == Counter(r for r in before if score[r.doc_id] < 0.5)
        elif name == "near_duplicates":
            roots = slow_roots([slow_print(r.text) for r in before], lambda a, b: (a ^ b).bit_count() <= 2)
            least = {}
            for r, root in zip(before, roots):
                least[root] = min(least.get(root, r.doc_id), r.doc_id)
            assert Counter(rows) == Counter(r for r in before if r.doc_id in set(least.values()))
        elif name == "personal_data":
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before)
            assert not any(slow_spans(r.text) for r in rows)
            assert all(r in before for r in rows if not re.search("<(EMAIL|IP|CARD|PHONE|IBAN|SSN|LOCAL_PHONE|PASSPORT)>", r.text))
        elif name == "mixing":
            assert set(rows) <= set(before) and max(Counter(r.doc_id for r in rows).values()) <= 2
        else:
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before)
        if name != "tokens":
            assert after.columns == docs.columns
        docs = after
    whole = corpus_pipeline.run(spark, FOLDER)
    assert rows_of(whole) == rows_of(docs)


def test_simhash_groups_share_one_root(docs, prose):
    text = prose(100, 1)
    _, of_fp = simhash.grouped(docs([(1, text), (2, text)]), simhash.F.col("doc_id"))
    assert of_fp.count() == 1
