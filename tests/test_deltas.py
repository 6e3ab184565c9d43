"""Grids by moves against grids over all rows."""

import pytest
from pyspark.sql import functions as F

from helpers import random_rows
from swayrank.operators.action import CollectiveAction, Run
from swayrank.plans import deltas
from swayrank.plans import experiment as exp
from swayrank.plans.refit import fixed_score

TRIAL = exp.Trial("d", "m")


def scored(spark, n, scores, seed, hot=False):
    rows = [(i, s, t, y, float(i % 7), float(s % 5)) for i, s, t, y in random_rows(n, scores, seed)]
    if hot:
        rows = [(i, 3.0 if i % 3 == 0 else s, t, y, a, b) for i, s, t, y, a, b in rows]
    df = spark.createDataFrame(rows, "ID long, base double, treatment int, visit int, a double, b double").repartition(3)
    return df


def with_score(df):
    value = F.when(F.col("a") == 6, F.lit(None)).otherwise(F.col("base") + F.col("a") * 2 - F.col("b"))
    return df.withColumn("uplift", value.cast("double"))


def slow(df, action, runs):
    """The grid that unfolds every row for every run."""
    general = lambda rows, *rest: fixed_score(with_score)(rows, *rest)
    return exp.run_grid(with_score(df), action, runs, general, TRIAL)


@pytest.mark.parametrize("n,scores,hot,rule", [
    (400, 30, False, {"a": "+3"}), (400, 30, True, {"a": "=6"}), (300, 1000, False, {"b": "-2"}), (60, 1, False, {"a": "+1000"}), (200, 9, True, {"a": "=0"}),
])
def test_moves_give_what_all_rows_give(spark, monkeypatch, n, scores, hot, rule):
    monkeypatch.setattr(deltas, "RUN_BLOCK", 3)
    df = scored(spark, n, scores, n, hot)
    action = CollectiveAction({"a": ">1"}, [rule], 0.2)
    runs = [Run(i, i * 31, frac) for i, frac in enumerate([0.001, 0.05, 0.2, 0.2, 0.5, 0.9, 1.0])]
    fast = {r.run_id: r.asDict() for r in exp.run_grid(with_score(df), action, runs, fixed_score(with_score), TRIAL).collect()}
    for r in slow(df, action, runs).collect():
        found = fast.pop(r.run_id)
        assert found == pytest.approx(r.asDict(), nan_ok=True)
    assert not fast


def test_only_participants_are_unfolded_and_no_join_has_a_score_for_its_key(spark):
    df = with_score(scored(spark, 500, 40, 1))
    action = CollectiveAction({"a": ">1"}, [{"a": "+3"}], 0.1)
    runs = [Run(i, i, 0.1) for i in range(10)]
    eligible = df.where("a > 1").count()
    assert deltas.unfold_participants(df, action, runs).count() == 10 * int(eligible * 0.1)
    baseline, cells = exp._baseline(df, TRIAL)
    moves, qini = deltas.rank_moves(baseline, cells, action, runs, with_score)
    for plan in (moves, qini):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in text.splitlines() if "Join" in line]
        assert joins and not any("key#" in line or "_key#" in line or "uplift#" in line for line in joins)
    assert moves.agg(F.sum("n")).first()[0] == 10 * int(eligible * 0.1)
