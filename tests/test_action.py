import hashlib

import pytest
from pyspark.sql import functions as F

from swayrank.operators import action as act
from swayrank.operators.action import CollectiveAction, Run


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(100).select(
        F.col("id").alias("ID"), (F.col("id") % 4).cast("int").alias("a"), (F.col("id") * 1.5).alias("b"))


def test_spec_is_checked_when_built():
    spec = CollectiveAction({"a": "=1"}, [{"a": "=2", "b": "+1"}, {"a": "-1"}], 0.1)
    assert (spec.feature, spec.operator, spec.threshold) == ("a", "=", 1.0)
    assert spec.attack_features == ["a", "b"]
    for criterion, attacks in (({"a": ">=1"}, []), ({"a": "!1"}, []), ({"a": "=1", "b": "=1"}, []), ({"a": "=1"}, [{"a": "*2"}])):
        with pytest.raises(ValueError):
            CollectiveAction(criterion, attacks, 0.1)


@pytest.mark.parametrize(("rule", "expected"), [("=1", 25), (">1", 50), ("<1", 25)])
def test_eligibility(people, rule, expected):
    assert people.where(act.eligible(CollectiveAction({"a": rule}, [], 0.1))).count() == expected


def test_exact_participants_change_and_everyone_else_stays(people):
    spec = CollectiveAction({"a": ">0"}, [{"a": "=9"}, {"b": "-60"}, {"a": "+1"}], 0.3)
    rows = {r["ID"]: r for r in act.apply_action(people, spec, seed=5).collect()}
    allowed = [i for i in range(100) if i % 4 > 0]
    chosen = sorted(allowed, key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())[: int(75 * 0.3)]
    assert len(rows) == 100
    for i, r in rows.items():
        if i in chosen:
            assert (r["aca_flag"], r["a"], r["b"]) == (1, 10.0, max(i * 1.5 - 60, 0.0))
        else:
            assert (r["aca_flag"], r["a"], r["b"]) == (0, float(i % 4), i * 1.5)


def test_less_than_one_participant(people):
    assert act.apply_action(people.limit(5), CollectiveAction({"a": "=1"}, [{"a": "=2"}], 0.1)).agg(
        F.sum("aca_flag")).first()[0] == 0


def test_floor_is_a_parameter(people):
    spec = CollectiveAction({"a": "=3"}, [{"a": "-5"}], 1.0, floor=-10.0)
    changed = act.apply_action(people, spec).where("aca_flag = 1")
    assert {r["a"] for r in changed.collect()} == {-2.0}


def test_runs_equal_single_actions_and_do_not_shuffle_rows(people):
    spec = CollectiveAction({"a": "=1"}, [{"a": "=2"}], 0.4)
    runs = [Run(0, 11, 0.4), Run(1, 12, 0.4), Run(2, 11, 0.2)]
    keyed = act.apply_action_runs(people, spec, runs)
    for run in runs:
        single = act.apply_action(people, CollectiveAction({"a": "=1"}, [{"a": "=2"}], run.frac), run.seed)
        part = keyed.where(F.col("run_id") == run.run_id).select(*single.columns)
        assert sorted(part.collect()) == sorted(single.collect())
    with pytest.raises(ValueError):
        act.with_runs(people, [])


def test_compare_ranking_keeps_original_features(spark):
    before = spark.createDataFrame([(1, 1.0, 0.5, 9.0), (2, 1.0, 1.0, 8.0)], "ID long, a double, normalised_rank double, uplift double")
    after = spark.createDataFrame([(1, 2.0, 1.0, 3.0, 1), (2, 1.0, 0.5, 8.0, 0)],
                                  "ID long, a double, normalised_rank double, uplift double, aca_flag int")
    got = act.compare_ranking(before, after, CollectiveAction({"a": "=1"}, [{"a": "=2"}], 0.5))
    assert got.columns == ["ID", "a", "normalised_rank", "uplift", "normalised_rank_modified", "uplift_modified", "aca_flag"]
    assert [tuple(r) for r in got.orderBy("ID").collect()] == [(1, 1.0, 0.5, 9.0, 1.0, 3.0, 1), (2, 1.0, 1.0, 8.0, 0.5, 8.0, 0)]
