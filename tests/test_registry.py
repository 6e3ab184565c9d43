"""Registered queries next to their SQL on the smallest test tables (`compare.py` runs them all)."""

import os

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"

CHECKED = [
    "load_campaign", "map_treatment", "one_hot", "assign_id", "apply_action", "sample_exact", "stratified_split",
    "normalised_rank", "ranking_positions", "uplift_curve", "qini_curve", "qini_auc", "qini_auc_by_segment",
    "compare_ranking", "density_histogram", "feature_percentiles", "feature_report", "propose_action",
]

needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@needs_tables
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    assert ": ok" in compare.compare(spark, duck, FOLDER, name)


@needs_tables
def test_entry_runs_the_grid(spark):
    df = entry(spark)
    assert df.count() == 30 and df.columns[0] == "run_id"


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
