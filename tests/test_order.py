import random

import pytest
from helpers import random_rows, trial
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from swayrank.operators.order import ordered_index, running_totals

quick = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@quick
@given(seed=st.integers(0, 10**6), edges=st.lists(st.floats(-60, 5), max_size=12))
def test_running_totals_equal_a_plain_window_for_any_slice_edges(spark, seed, edges):
    df = trial(spark, random_rows(300, 40, seed))
    got = running_totals(df, "uplift", {"n": F.count("*"), "y": F.sum("visit")}, points=sorted(set(edges)))
    cells = df.groupBy("uplift").agg(F.count("*").alias("n"), F.sum("visit").alias("y"))
    upto = Window.orderBy(F.col("uplift").desc())
    want = cells.select(
        "uplift", "n", "y", F.sum("n").over(upto).alias("cum_n"), F.sum("y").over(upto).alias("cum_y"),
        F.row_number().over(upto).alias("cum_cells"),
    )
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_running_totals_by_group_with_a_hot_score(spark):
    rows = [(g, 1.0 if i % 3 else float(i)) for g in ("a", "b", None) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, s double")
    got = {(r["g"], r["s"]): (r["n"], r["cum_n"], r["all_n"]) for r in
           running_totals(df, "s", {"n": F.count("*")}, by=["g"]).collect()}
    for g in ("a", "b", None):
        values = [s for h, s in rows if h == g]
        for s in set(values):
            assert got[(g, s)] == (values.count(s), sum(v >= s for v in values), 90)
    assert len(got) == 3 * len({s for _, s in rows})


def test_null_and_nan_scores_come_last_and_are_kept(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "s double")
    rows = sorted(running_totals(df, "s", {"n": F.count("*")}).collect(), key=lambda r: r["cum_n"])
    assert [(r["s"], r["n"], r["cum_n"]) for r in rows] == [(3.0, 1, 1), (1.0, 1, 2), (None, 2, 4)]


@pytest.mark.parametrize("descending", [True, False])
def test_ordered_index_splits_ties_by_the_unique_column(spark, descending):
    draw = random.Random(5)
    rows = [(i, 7.0 if draw.random() < 0.5 else float(draw.randrange(9)), i % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, s double, g int").repartition(5)
    key = F.col("s").desc() if descending else F.col("s").asc()
    got = {(r["g"], r["id"]): r["index"] for r in ordered_index(df, [key, F.col("id").asc()], ["g"]).collect()}
    for g in (0, 1):
        part = sorted((r for r in rows if r[2] == g), key=lambda r: (-r[1] if descending else r[1], r[0]))
        assert [got[(g, r[0])] for r in part] == list(range(len(part)))
