"""Collective-action experiments: rank, let participants change, rank again, compare.

A run key (`run_id`) goes through every operator as a grouping column, so all repeats of a grid are
one plan instead of a loop. The values before the action travel with the rows, so before and after
need no join on ID.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayrank.functions.joins import attach_one_row, join_groups
from swayrank.operators.action import CollectiveAction, Run
from swayrank.operators.order import score_points
from swayrank.operators.ranking import (
    attach_ranks,
    qini_auc,
    qini_auc_from_cells,
    qini_cells,
    random_baseline,
    ranking_positions,
    uplift_curve,
)
from swayrank.operators.stats import (
    compare_distributions,
    participants,
    position_histogram,
    summarise_participants,
)
from swayrank.plans.deltas import RUN_KEYS, rank_moves
from swayrank.plans.refit import FixedScore, Rescore
from swayrank.session import freeze


@dataclass(frozen=True)
class Trial:
    """Names of a campaign table's columns and of the study."""

    dataset: str
    model: str
    target: str = "visit"
    treatment: str = "treatment"
    id_col: str = "ID"


@dataclass(frozen=True)
class Reranked:
    """Rows before and after the action, and the Qini coefficient after it per run."""

    comparison: DataFrame
    qini: DataFrame


def ranked_cells(scored: DataFrame, trial: Trial) -> tuple[DataFrame, DataFrame]:
    """The scored test table with its ranks, and its `qini_cells`; grids over the same table can share them."""
    # Slice edges, cells and ranks each read the scores, which a model or joins have made.
    scored = freeze(scored)
    cells = freeze(qini_cells(scored, "uplift", trial.treatment, trial.target))
    return freeze(attach_ranks(scored, cells, "uplift"), spread=True), cells


_baseline = ranked_cells


def baseline_ranking(scored: DataFrame, trial: Trial) -> tuple[DataFrame, DataFrame]:
    """The scored test table with `rank` and `normalised_rank`, and its Qini coefficient (one row).

    Every later step reads this table, so it is written once.
    """
    ranked, cells = ranked_cells(scored, trial)
    return ranked, qini_auc_from_cells(cells)


def rank_after_action(
    baseline: DataFrame, action: CollectiveAction, runs: Sequence[Run], rescore: Rescore, trial: Trial
) -> Reranked:
    """Apply the action once per run, score again with `rescore`, and rank within each run.

    `baseline` carries uplift and normalised_rank. `rescore` returns its rows once per run, changed
    and with the new `uplift`.
    """
    kept = {f"_before_{c}": F.col(c) for c in [*action.attack_features, "uplift", "normalised_rank"]}
    carried = baseline.withColumns(kept).drop("uplift", "rank", "normalised_rank")
    names = dict.fromkeys([*RUN_KEYS, trial.id_col, trial.treatment, trial.target, "uplift", "aca_flag", *kept])
    rescored = rescore(carried, action, runs, trial.id_col).select(*names)
    if not isinstance(rescore, FixedScore):
        rescored = freeze(rescored)  # several jobs read the scores of the models; nothing else of the rows is written
    # Runs differ in a few participants only, so one run's scores place the slice edges of all.
    points = score_points(rescored.where(F.col("run_id") == runs[0].run_id), "uplift")
    # Ranks and Qini both read the cells; written once, the rows of all runs are walked only twice.
    cells = freeze(qini_cells(rescored, "uplift", trial.treatment, trial.target, by=RUN_KEYS, points=points))
    slim = rescored.select(*RUN_KEYS, trial.id_col, "uplift", "aca_flag", *kept)
    ranked = attach_ranks(slim, cells, "uplift", RUN_KEYS)
    comparison = ranked.select(
        *RUN_KEYS,
        trial.id_col,
        *[F.col(f"_before_{c}").alias(c) for c in action.attack_features],
        F.col("_before_normalised_rank").alias("normalised_rank"),
        F.col("_before_uplift").alias("uplift"),
        F.col("normalised_rank").alias("normalised_rank_modified"),
        F.col("uplift").alias("uplift_modified"),
        "aca_flag",
    )
    return Reranked(comparison, qini_auc_from_cells(cells, RUN_KEYS))


def summarise_runs(
    reranked: Reranked, baseline_qini: DataFrame, action: CollectiveAction, trial: Trial
) -> DataFrame:
    """One result row per run; a run without participants stays, with count 0 and null measures."""
    ranks = participants(reranked.comparison).select(*RUN_KEYS, "normalised_rank", "normalised_rank_modified")
    return _result_rows(reranked.qini, ranks, baseline_qini, action, trial)


def _result_rows(
    qini: DataFrame, ranks: DataFrame, baseline_qini: DataFrame, action: CollectiveAction, trial: Trial
) -> DataFrame:
    """Result rows from the Qini coefficient of each run and its participants' two ranks."""
    # Means and medians read the ranks several times.
    moved = summarise_participants(freeze(ranks), by=RUN_KEYS)
    rows = join_groups(qini, moved, RUN_KEYS, "left")
    named = attach_one_row(rows, baseline_qini.select(F.col("qini_coeff").alias("baseline_qini_coeff")))
    return named.select(
        "run_id",
        F.lit(trial.dataset).alias("dataset"),
        F.lit(trial.model).alias("model"),
        F.lit(action.feature).alias("target_feature"),
        "frac",
        "qini_coeff",
        F.coalesce("num_participants", F.lit(0).cast("long")).alias("num_participants"),
        "avg_normalised_rank",
        "median_normalised_rank",
        "avg_modified_normalised_rank",
        "median_modified_normalised_rank",
        "ci_low",
        "ci_high",
        "baseline_qini_coeff",
    )


def run_grid(
    scored_test: DataFrame, action: CollectiveAction, runs: Sequence[Run], rescore: Rescore, trial: Trial,
    baseline: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """The whole grid of repeats as one plan; the baseline is scored and ranked once.

    With a fixed score only participants are looked at; a refitted model may change the score of every row. `baseline` is what
    `ranked_cells` made of `scored_test`, if another grid has asked for it before.
    """
    ranked, cells = baseline or ranked_cells(scored_test, trial)
    qini = qini_auc_from_cells(cells)
    if isinstance(rescore, FixedScore):
        moves, after = rank_moves(
            ranked, cells, action, runs, rescore.score, trial.treatment, trial.target, trial.id_col
        )
        alike = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
        ranks = moves.select(*RUN_KEYS, "normalised_rank", "normalised_rank_modified", alike).drop("col")
        return _result_rows(after, ranks, qini, action, trial)
    return summarise_runs(rank_after_action(ranked, action, runs, rescore, trial), qini, action, trial)


def run_experiment(
    scored_test: DataFrame, action: CollectiveAction, rescore: Rescore, trial: Trial, seed: int = 42
) -> DataFrame:
    """One repeat: one summary row."""
    return run_grid(scored_test, action, [Run(0, seed, action.frac)], rescore, trial).drop("run_id")


def before_after(
    scored_test: DataFrame, action: CollectiveAction, rescore: Rescore, trial: Trial, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One repeat in detail: compared rows, Qini before/after/change, and distribution histograms."""
    ranked, qini = baseline_ranking(scored_test, trial)
    after = rank_after_action(ranked, action, [Run(0, seed, action.frac)], rescore, trial)
    change = attach_one_row(
        after.qini.select(F.col("qini_coeff").alias("qini_after")),
        qini.select(F.col("qini_coeff").alias("qini_before")),
    ).select("qini_before", "qini_after", (F.col("qini_after") - F.col("qini_before")).alias("qini_change"))
    rows = freeze(after.comparison.drop(*RUN_KEYS))
    return rows, change, compare_distributions(rows)


def ranking_comparison(
    scored_test: DataFrame, action: CollectiveAction, rescore: Rescore, trial: Trial, seed: int = 42
) -> DataFrame:
    """Curves before and after, the random line, and where participants stand, as one long table.

    Columns: series (curve_before, curve_after, random, participants_before, participants_after),
    item (node or bin number), x, value.
    """
    names = [trial.id_col, trial.treatment, trial.target]
    ranked, _ = baseline_ranking(scored_test, trial)
    after = rank_after_action(ranked, action, [Run(0, seed, action.frac)], rescore, trial).comparison
    both = freeze(after.select(trial.id_col, "uplift", "uplift_modified", "aca_flag").join(
        scored_test.select(*names), trial.id_col
    ))
    phases = F.inline(F.array(
        F.struct(F.lit("before").alias("phase"), F.col("uplift").alias("score")),
        F.struct(F.lit("after").alias("phase"), F.col("uplift_modified").alias("score")),
    ))
    long = both.select(*names, "aca_flag", phases)
    curves = uplift_curve(long, "score", trial.treatment, trial.target, by=["phase"]).select(
        F.concat(F.lit("curve_"), "phase").alias("series"), F.col("node").alias("item"),
        F.col("x").cast("double").alias("x"), F.col("uplift").alias("value"),
    )
    line = random_baseline(scored_test, trial.treatment, trial.target).select(
        F.lit("random").alias("series"), F.when(F.col("x") == 0, 0).otherwise(1).alias("item"),
        F.col("x").cast("double").alias("x"), F.col("uplift").alias("value"),
    )
    placed = ranking_positions(long, "score", trial.id_col, by=["phase"], keep=["aca_flag"])
    sizes = placed.groupBy("phase").agg(F.count("*").alias("n"))
    bars = position_histogram(participants(placed), sizes, by=["phase"]).select(
        F.concat(F.lit("participants_"), "phase").alias("series"), F.col("bin").alias("item"),
        F.col("bin_start").alias("x"), F.col("count").cast("double").alias("value"),
    )
    return curves.unionByName(line).unionByName(bars)


def compare_models(
    scored: DataFrame, trial: Trial, by: str = "model"
) -> tuple[DataFrame, DataFrame]:
    """Curve nodes and Qini coefficient per model, from one table of scores keyed by model."""
    return (
        uplift_curve(scored, "uplift", trial.treatment, trial.target, by=[by]),
        qini_auc(scored, "uplift", trial.treatment, trial.target, by=[by]),
    )
