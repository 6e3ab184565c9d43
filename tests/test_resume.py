"""Results that stay: dynamic partitions, interrupted grids, several studies in one folder."""

import pytest

from helpers import random_rows
from swayrank.operators.action import CollectiveAction, Run
from swayrank.plans import experiment as exp
from swayrank.plans import resume
from swayrank.plans.refit import FixedScore
from swayrank.sources.tables import RESULT_SCHEMA, read_results, write_results

ACTION = CollectiveAction({"a": ">1"}, [{"a": "+3"}], 0.2)
RUNS = [Run(i, i * 31, frac) for i, frac in enumerate([0.05, 0.1, 0.2, 0.3, 0.4])]


def with_score(df):
    return df.withColumn("uplift", df["base"] + df["a"])


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, s, t, y, float(i % 7)) for i, s, t, y in random_rows(120, 20, 3)]
    return with_score(spark.createDataFrame(rows, "ID long, base double, treatment int, visit int, a double"))


class Interrupted(Exception):
    pass


def counting(done, fail_at=None):
    def rescore(rows, action, runs, id_col):
        for run in runs:
            if run.run_id == fail_at:
                raise Interrupted
            done.append(run.run_id)
        return FixedScore(with_score)(rows, action, runs, id_col)

    return rescore


def by_run(rows):
    return {r["run_id"]: r.asDict() for r in rows}


def test_an_interrupted_grid_goes_on(spark, scored, tmp_path):
    folder, trial = str(tmp_path / "kept"), exp.Trial("d", "m")
    whole = by_run(exp.run_grid(scored, ACTION, RUNS, counting([]), trial).collect())
    first = []
    with pytest.raises(Interrupted):
        resume.run_grid_into(folder, scored, ACTION, RUNS, counting(first, fail_at=3), trial, batch_runs=2)
    assert first == [0, 1, 2]  # the batch of run 2 was not finished
    assert {r.run_id for r in resume.finished_results(spark, folder).collect()} == {0, 1}
    # A batch that was written but not listed, as when a job dies in between: not read, and written again.
    torn = exp.run_grid(scored, ACTION, RUNS[2:4], counting([]), trial).selectExpr("*", "'torn' as batch")
    resume.write_partitions(torn, folder, [*resume.STUDY, "batch"])
    second = []
    found = resume.run_grid_into(folder, scored, ACTION, RUNS, counting(second), trial, batch_runs=2)
    assert second == [2, 3, 4]
    rows = by_run(found.collect())
    assert set(rows) == set(whole) and all(rows[r] == pytest.approx(whole[r]) for r in whole)
    third = []
    again = resume.run_grid_into(folder, scored, ACTION, RUNS[:2], counting(third), trial)
    assert third == [] and set(by_run(again.collect())) == {0, 1}
    assert resume.finished_results(spark, folder).count() == len(RUNS)


def test_studies_do_not_disturb_each_other(spark, scored, tmp_path):
    folder = str(tmp_path / "kept")
    other = CollectiveAction({"a": ">1"}, [{"a": "+5"}], 0.2)
    done = []
    for model, action in (("lgbm", ACTION), ("mlp", ACTION), ("lgbm", other)):
        resume.run_grid_into(folder, scored, action, RUNS[:2], counting(done), exp.Trial("d", model))
    assert done == [0, 1] * 3
    rows = resume.finished_results(spark, folder).collect()
    assert sorted((r.model, r.run_id) for r in rows) == sorted([("lgbm", 0), ("lgbm", 1)] * 2 + [("mlp", 0), ("mlp", 1)])


def test_nothing_finished_yet(spark, tmp_path):
    assert resume.finished_results(spark, str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("name", ["results", "results.csv"])
def test_write_results_keeps_other_studies(spark, tmp_path, name):
    folder = str(tmp_path / name)
    row = lambda model, feature, qini: ("d", model, feature, 0.1, qini, 5, 0.5, 0.5, 0.4, 0.4, 0.1, 0.2, 0.1)
    for rows in ([row("lgbm", "a", 1.0)], [row("mlp", "a", 2.0)], [row("mlp", "b", 3.0)], [row("lgbm", "a", 4.0)]):
        write_results(spark.createDataFrame(rows, RESULT_SCHEMA), folder)
    found = {(r.model, r.target_feature, r.qini_coeff) for r in read_results(spark, folder).collect()}
    assert found == {("lgbm", "a", 4.0), ("mlp", "a", 2.0), ("mlp", "b", 3.0)}


def test_batches_share_one_baseline(spark, scored, tmp_path, monkeypatch):
    made, trial = [], exp.Trial("d", "m")

    rank = exp.ranked_cells

    def ranked(table, names):
        made.append(names)
        return rank(table, names)

    monkeypatch.setattr(resume, "ranked_cells", ranked)
    whole = by_run(exp.run_grid(scored, ACTION, RUNS, FixedScore(with_score), trial).collect())
    monkeypatch.setattr(exp, "ranked_cells", None)  # a grid that is given its baseline does not rank again
    found = resume.run_grid_into(str(tmp_path / "kept"), scored, ACTION, RUNS, FixedScore(with_score), trial, batch_runs=2)
    rows = by_run(found.collect())
    assert set(rows) == set(whole) and all(rows[r] == pytest.approx(whole[r]) for r in whole)
    assert len(made) == 1
