"""Registry contract, and a sample of queries beside their SQL (``python -m checks.compare`` runs all of them)."""
import os

import pytest

import __spark_entry__ as entry
from checks import catalog
from checks.compare import compare, oracle_rows

FOLDER = "/root/testdata/sf0.001"
KEYS = ["sentiment_features", "cap_weighted_average", "assemble_system_panel", "embargo_split", "forecast_ar1", "error_metrics", "dm_p_value",
        "audit_archive", "quantile_bin", "stratified_split", "merge_prediction_files", "score_text"]

needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")


def test_every_query_has_a_statement_or_a_reason():
    queries, oracles = catalog.QUERIES, catalog.ORACLES
    assert set(oracles) <= set(queries)
    assert set(queries) == set(oracles)


@needs_data
@pytest.mark.parametrize("key", KEYS)
def test_query_matches_statement(spark, key):
    df = entry.queries()[key](spark, FOLDER)
    names, _, expected = oracle_rows(entry.oracle_sql()[key], FOLDER)
    assert compare(df.columns, [tuple(r) for r in df.collect()], names, expected) is None


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
