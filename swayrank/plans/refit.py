"""How the rows of a run get their new score: by a fixed formula, or by a model refitted per run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayrank.models.boosting import fit_boosted_runs, fit_boosted_trees
from swayrank.models.forest import fit_forest_runs, fit_uplift_forest
from swayrank.models.histograms import bin_edges
from swayrank.models.store import DEFAULTS, fit_model
from swayrank.operators.action import CollectiveAction, Run, apply_action_runs, participation_cutoffs, share_action
from swayrank.session import freeze

Rescore = Callable[[DataFrame, CollectiveAction, Sequence[Run], str], DataFrame]


@dataclass(frozen=True)
class FixedScore:
    """A score that depends on a row alone; grids with it need to look at participants only (`plans.deltas`)."""

    score: Callable[[DataFrame], DataFrame]

    def __call__(self, rows: DataFrame, action: CollectiveAction, runs: Sequence[Run], id_col: str) -> DataFrame:
        return self.score(apply_action_runs(rows, action, runs, id_col))


def fixed_score(score: Callable[[DataFrame], DataFrame]) -> Rescore:
    """Apply a given score (a formula, or an already fitted model) to the changed rows of all runs."""
    return FixedScore(score)


def refitted(
    name: str, train: DataFrame, features: Sequence[str], config=None, treatment: str = "treatment",
    target: str = "visit", label: str = "label", parallel_fits: int = 4, edges: Sequence[Sequence[float]] | None = None,
) -> Rescore:
    """Train and test rows take the action with the same seed; the model is fitted anew for every run.

    The model's own seed stays the same, so that runs differ only in who takes part: rows are kept once for all runs, with the runs
    they take part in (`share_action`). Forest and boosted trees fit
    all runs in the same jobs, with split candidates from the table as it is, and their scores are columns that whoever reads them
    several times has to write; the net fits one data set at a time, so its runs are submitted from a few threads and each run's
    scores are written before the next use. `edges` are the split candidates of `train`, if known from a model fitted to it with
    the same number of bins.
    """
    if name not in DEFAULTS:
        raise ValueError(f"unknown model {name!r}; use one of {', '.join(DEFAULTS)}")
    settings = config or DEFAULTS[name]

    def together(rows: DataFrame, action: CollectiveAction, runs: Sequence[Run], id_col: str) -> DataFrame:
        candidates = candidate_edges(train, action, features, settings.n_bins, edges)
        if _can_share(train, action, runs, {label, treatment, target, id_col}, [treatment, target] if name == "uplift_rf" else []):
            shared, tested = share_action(train, action, runs, id_col), share_action(rows, action, runs, id_col)
            if name == "lgbm":
                return fit_boosted_runs(shared, features, settings, label, candidates).score_runs(tested)
            return fit_forest_runs(shared, features, settings, treatment, target, id_col, candidates).score_runs(tested)
        changed = apply_action_runs(train, action, runs, id_col)
        if name == "lgbm":
            model = fit_boosted_trees(changed, features, settings, label, by=["run_id"], edges=candidates)
        else:
            model = fit_uplift_forest(changed, features, settings, treatment, target, id_col, by=["run_id"], edges=candidates)
        return model.score(apply_action_runs(rows, action, runs, id_col))

    def one_by_one(rows: DataFrame, action: CollectiveAction, runs: Sequence[Run], id_col: str) -> DataFrame:
        # One job finds who takes part in each run, on either table.
        cutoffs = [participation_cutoffs(side, action, runs, id_col) for side in (train, rows)]

        def single(run: Run) -> DataFrame:
            changed, mine = (
                apply_action_runs(side, action, [run], id_col, found) for side, found in zip((train, rows), cutoffs)
            )
            return freeze(fit_model(name, changed, features, config, treatment, target, label, id_col).score(mine))

        with ThreadPoolExecutor(parallel_fits) as pool:
            return reduce(DataFrame.unionByName, pool.map(single, runs))

    return one_by_one if name == "mlp" else together


def _can_share(train: DataFrame, action: CollectiveAction, runs: Sequence[Run], fixed: set[str], binary: Sequence[str]) -> bool:
    """Whether runs differ only in the features of those who take part; otherwise rows are unfolded by run before a model sees them."""
    if fixed & set(action.attack_features) or len({run.run_id for run in runs}) < len(runs) or max(abs(run.run_id) for run in runs) >> 31:
        return False
    plain = [F.coalesce(F.bool_and(F.coalesce(F.col(c).isin(0, 1), F.lit(False))), F.lit(False)).alias(f"_{c}") for c in binary]
    found = train.agg(F.count("*").alias("_rows"), *plain).first()
    return found["_rows"] > 0 and all(found[f"_{c}"] for c in binary)


def candidate_edges(
    train: DataFrame, action: CollectiveAction, features: Sequence[str], n_bins: int, known: Sequence[Sequence[float]] | None = None,
) -> list[list[float]]:
    """Split candidates from the table as it is (found, unless `known`), and the values that an action sets features to."""
    edges = [list(e) for e in known] if known is not None else bin_edges(train, features, n_bins)
    for name, change in action.changes():
        if change[0] == "=" and name in features:
            edge = edges[list(features).index(name)]
            edge[:] = sorted({*edge, float(change[1:])})
    return edges
