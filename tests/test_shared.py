"""Rows that the runs of a grid share, against the same rows unfolded by run."""

import pytest
from helpers import planted_trial
from pyspark.sql import functions as F

from swayrank.models import histograms as hist
from swayrank.models.boosting import BoostedTreesConfig
from swayrank.models.forest import ForestConfig
from swayrank.models.shared import make_shared_blocks
from swayrank.operators import action as action_module
from swayrank.operators.action import CollectiveAction, apply_action_runs, run_grid_keys, share_action
from swayrank.operators.prepare import class_transform_label
from swayrank.operators.sampling import seeded_hash
from swayrank.plans import refit

FEATURES = [f"x{k}" for k in range(1, 6)]
ACTION = CollectiveAction({"x1": "<0.5"}, [{"x1": "+0.4"}, {"x2": "=0.95"}], 0.1)
RUNS = run_grid_keys([0.0001, 0.2, 0.5], [3, 4])
CONFIGS = {
    "lgbm": BoostedTreesConfig(n_estimators=3, max_depth=3, n_bins=8, learning_rate=0.3),
    "uplift_rf": ForestConfig(n_estimators=3, max_depth=3, n_bins=8, min_samples_leaf=30),
}


@pytest.fixture(scope="module")
def rows(spark):
    df = class_transform_label(planted_trial(spark, 1500))
    nulls = df.withColumn("x1", F.when(F.col("ID") % 50 > 0, F.col("x1"))).withColumn("ID", F.when(F.col("ID") % 40 > 0, F.col("ID")))
    return nulls.unionByName(nulls.where("ID < 30")).cache()  # IDs that are null and IDs that come twice


def as_set(df):
    names = sorted(df.columns)
    return sorted(tuple(repr(r[c]) for c in names) for r in df.collect())


def test_unfolded_rows_are_those_of_the_action(rows):
    shared = share_action(rows, ACTION, RUNS)
    wide = shared.rows.withColumn("scores", F.array(*[F.lit(float(n)) for n in range(len(RUNS))]))
    got = shared.unfold(wide, rows.columns, {"score": "scores"})
    want = apply_action_runs(rows, ACTION, RUNS)
    assert as_set(got.drop("score")) == as_set(want) and got.columns == [*want.columns, "score"]
    assert got.where("aca_flag = 1").count() > 0 and got.where("score <> run_id").count() == 0


@pytest.mark.parametrize("name", ["lgbm", "uplift_rf"])
def test_models_of_shared_rows_are_those_of_unfolded_rows(rows, name, monkeypatch):
    """F1, F2: rows that the runs share are fitted and scored without a copy per run, to the same scores."""
    train, test = rows.where("ID % 3 > 0 or ID is null"), rows.where("ID % 3 = 0")
    rescore = refit.refitted(name, train, FEATURES, CONFIGS[name])
    seen, plain = [], hist.make_blocks
    monkeypatch.setattr("swayrank.models.boosting.make_blocks", lambda *a, **b: seen.append(1) or plain(*a, **b))
    monkeypatch.setattr("swayrank.models.forest.make_blocks", lambda *a, **b: seen.append(1) or plain(*a, **b))
    shared = rescore(test, ACTION, RUNS, "ID")
    assert not seen
    monkeypatch.setattr(refit, "_can_share", lambda *a: False)
    unfolded = rescore(test, ACTION, RUNS, "ID")
    assert seen and shared.columns == unfolded.columns and as_set(shared) == as_set(unfolded)
    assert shared.select("uplift").distinct().count() > 3


def test_blocks_grow_with_rows_and_participants(spark, rows):
    layout = hist.Layout.of(hist.bin_edges(rows, FEATURES, 8))
    size = lambda runs: sum(
        len(r[c]) for r in make_shared_blocks(share_action(rows, ACTION, runs), FEATURES, layout, {"label": 1}, {"label": lambda x: x}).collect()
        for c in ("codes", "changed", "row", "part"))
    few = run_grid_keys([0.01] * 40, list(range(5)))
    assert size(few) < 2 * size(few[:1])


@pytest.mark.parametrize("case", ["label", "responses", "empty"])
def test_what_cannot_be_shared_is_unfolded(rows, case):
    fixed, binary = {"label", "treatment", "visit", "ID"}, ["treatment", "visit"]
    odd = {"label": rows, "responses": rows.withColumn("visit", F.col("visit") * 2), "empty": rows.limit(0)}[case]
    action = CollectiveAction({"x1": "<0.5"}, [{"label": "=1"}], 0.1) if case == "label" else ACTION
    assert not refit._can_share(odd, action, RUNS, fixed, binary)
    assert refit._can_share(rows, ACTION, RUNS, fixed, binary)
    assert not refit._can_share(rows, ACTION, [RUNS[0], RUNS[0]], set(), [])


def test_cutoffs_are_found_with_one_hash_per_seed(rows, monkeypatch):
    """runs of one seed share their hashes; each still takes exactly its share."""
    unfolded, plain = [], action_module.with_runs
    monkeypatch.setattr(action_module, "with_runs", lambda df, runs, *rest: unfolded.append(len(runs)) or plain(df, runs, *rest))
    cutoffs = action_module.participation_cutoffs(rows, ACTION, RUNS)
    assert unfolded == [2]
    monkeypatch.undo()
    hashes = {seed: sorted(r[0] for r in rows.where("x1 < 0.5").select(seeded_hash(seed, "ID")).collect() if r[0] is not None) for seed in (3, 4)}
    eligible = rows.where("x1 < 0.5").count()
    for run in RUNS:
        k = int(eligible * run.frac)
        assert (run.run_id in cutoffs) == (k > 0)
        if k:
            alone = action_module.participation_cutoffs(rows, ACTION, [run])
            assert alone == {run.run_id: cutoffs[run.run_id]} and cutoffs[run.run_id] in hashes[run.seed]
