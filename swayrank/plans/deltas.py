"""Grids with a fixed score: the baseline's order is kept, and a run is the few moves inside it.

A row that takes no part keeps its score, so a run's ranking is the baseline's cells (one per distinct score) plus a
signed count where participants left or arrived. Only participants are unfolded by run; alike moves are one row. The score axis is
cut into slices. A task has the cells of one slice, in order, and the moves of a block of runs in it; it merges them run by
run with prefix sums and adds what the slices before contribute. So the rows that move are participants and a copy of the cells
for each block of runs, and nothing is joined by score.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swayrank.operators.action import CollectiveAction, Run, apply_attacks, eligible, participation_cutoffs, with_runs
from swayrank.operators.order import KEY, SLICE, score_points, sort_key, with_slice
from swayrank.operators.sampling import seeded_hash
from swayrank.session import freeze, share_package

RUN_BLOCK = 64
RUN_KEYS = ["run_id", "frac"]
COUNTS = ["n", "nt", "yt", "yc"]


def unfold_participants(df: DataFrame, action: CollectiveAction, runs: Sequence[Run], id_col: str = "ID") -> DataFrame:
    """The rows that take part, once per run they take part in, changed; nobody else is unfolded."""
    cutoffs = participation_cutoffs(df, action, runs, id_col)
    rows = with_runs(df.where(eligible(action)), runs, cutoffs)
    chosen = rows.where(seeded_hash(F.col("run_seed"), id_col) <= F.col("cutoff")).withColumn("aca_flag", F.lit(1))
    return apply_attacks(chosen.drop("cutoff", "run_seed"), action)


def _sliced(df: DataFrame, score: str, points: Sequence[float]) -> DataFrame:
    return with_slice(df.withColumn(KEY, sort_key(score, -1.0)), KEY, points)


def _arrays(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys in order, null last, and the counts beside them."""
    keys = cells["key"].to_numpy(np.float64)
    order = np.argsort(keys, kind="stable")  # NaN, which stands for null, sorts last
    return keys[order], cells[COUNTS].to_numpy(np.int64)[order]


def merge_moves(keys: np.ndarray, counts: np.ndarray, moved_keys: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells after the moves: keys without rows go, new ones come."""
    together, place = np.unique(np.concatenate((keys, moved_keys)), return_inverse=True)
    merged = np.zeros((len(together), len(COUNTS)), np.int64)
    np.add.at(merged, place, np.concatenate((counts, moves)))
    left = merged[:, 0] > 0
    return together[left], merged[left]


def net(totals: np.ndarray) -> np.ndarray:
    """Treated responses less control responses scaled to the treated count, from running totals (n, nt, yt, yc)."""
    n, nt, yt, yc = totals.astype(np.float64).T
    return yt - yc * np.divide(nt, n - nt, out=np.zeros(len(n)), where=n > nt)


def qini_area(counts: np.ndarray, before: np.ndarray) -> float:
    """Area below the Qini curve over consecutive cells that follow `before` rows."""
    upto = np.cumsum(counts, axis=0) + before
    return float((counts[:, 0] * (net(upto) + net(upto - counts)) / 2).sum())


def move_rows(participants: DataFrame, treatment: str, target: str) -> DataFrame:
    """Alike moves of participants (with `_before_uplift`, `_before_rank`, `uplift`) as one row with their counts."""
    t, y = F.col(treatment).cast("long"), F.col(target).cast("long")
    return participants.groupBy(*RUN_KEYS, "_before_uplift", "_before_rank", "uplift").agg(
        F.count("*").alias("n"), F.sum(t).alias("nt"), F.sum(t * y).alias("yt"), F.sum((F.lit(1) - t) * y).alias("yc")
    )


def _signed(moves: DataFrame, points: Sequence[float]) -> DataFrame:
    """(run_id, slice, key) with the signed counts of moves from and to it."""
    sides = [moves.select("run_id", F.col(c).alias("_s"), *[(F.col(x) * sign).alias(x) for x in COUNTS]) for c, sign in (("_before_uplift", -1), ("uplift", 1))]
    both = _sliced(sides[0].unionByName(sides[1]), "_s", points)
    return both.groupBy("run_id", SLICE, F.col(KEY).alias("key")).agg(*[F.sum(x).alias(x) for x in COUNTS])


def _by_slice(cells: DataFrame, rows: DataFrame, blocks: int, function: Callable, schema: str) -> DataFrame:
    """`function(cells of a slice, rows of a block of runs in it)`."""
    share_package(cells.sparkSession)
    block = F.pmod(F.col("run_id"), F.lit(blocks)).alias("block")
    copies = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    left, right = copies.groupBy(SLICE, "block"), rows.select("*", block).groupBy(SLICE, "block")
    return left.cogroup(right).applyInPandas(function, schema)


RANKED = {"run_id": "int32", SLICE: "int32", "rank_before": "float64", "n": "int64", "local": "int64", "more": "int64"}


def _local_ranks(cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Arrivals with their dense rank inside the slice after the moves.

    Each row also says how many cells more its run has in the slice; a row without participants says that alone.
    """
    made = []
    keys, counts = _arrays(cells)
    for run_id, mine in rows.groupby("run_id"):
        moves, arrived = mine[~mine["arrived"]], mine[mine["arrived"]]
        after, _ = merge_moves(keys, counts, *_arrays(moves))
        wanted = arrived["key"].to_numpy(np.float64)
        place = np.where(np.isnan(wanted), len(after), np.searchsorted(after, wanted, "right"))
        made.append(pd.DataFrame({
            "run_id": run_id, SLICE: rows[SLICE].iloc[0], "rank_before": np.append(arrived["rank_before"], np.nan),
            "n": np.append(arrived["n"], 0), "local": np.append(place, 0), "more": len(after) - len(keys),
        }))
    made = pd.concat(made) if made else pd.DataFrame(columns=list(RANKED))
    return made.astype(RANKED)


def _areas(cells: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Per run: the area of a slice. A row that `begins` tells what a run counts before the slice."""
    keys, counts = _arrays(cells)
    made = []
    for run_id, mine in rows.groupby("run_id"):
        moves = mine[~mine["begins"]]
        before = mine.loc[mine["begins"], COUNTS].to_numpy(np.int64)[0]
        _, after = merge_moves(keys, counts, *_arrays(moves)) if len(moves) else (keys, counts)
        made.append((run_id, qini_area(after, before)))
    return pd.DataFrame(made, columns=["run_id", "area"]).astype({"run_id": "int32", "area": "float64"})


def rank_moves(
    baseline: DataFrame, cells: DataFrame, action: CollectiveAction, runs: Sequence[Run], score: Callable[[DataFrame], DataFrame],
    treatment: str = "treatment", target: str = "visit", id_col: str = "ID",
) -> tuple[DataFrame, DataFrame]:
    """Moves with normalised ranks before and after, and the Qini coefficient of every run.

    `baseline` has uplift and normalised_rank, `cells` are its `qini_cells`, `score` computes uplift row by row. The first result
    has (run_id, frac, normalised_rank, normalised_rank_modified, n): `n` participants of a run moved alike.
    """
    kept = {"_before_uplift": F.col("uplift"), "_before_rank": F.col("normalised_rank")}
    carried = baseline.withColumns(kept).drop("uplift", "rank", "normalised_rank")
    moves = freeze(move_rows(score(unfold_participants(carried, action, runs, id_col)), treatment, target))
    points = score_points(cells, "uplift")
    base = freeze(_sliced(cells.select("uplift", *COUNTS), "uplift", points).select(SLICE, F.col(KEY).alias("key"), *COUNTS))
    signed = freeze(_signed(moves, points))
    blocks = -(-len(runs) // RUN_BLOCK)
    arrivals = _sliced(moves, "uplift", points).select(
        "run_id", SLICE, F.col(KEY).alias("key"), *COUNTS, F.lit(True).alias("arrived"), F.col("_before_rank").alias("rank_before")
    )
    moved = signed.withColumns({"arrived": F.lit(False), "rank_before": F.lit(None).cast("double")}).unionByName(arrivals)
    local = freeze(_by_slice(base, moved, blocks, _local_ranks, f"run_id int, {SLICE} int, rank_before double, n long, local long, more long"))

    # One row per run and slice from here on, whatever the data.
    per_slice = base.groupBy(SLICE).agg(F.count("*").alias("cells"), *[F.sum(c).alias(c) for c in COUNTS])
    frame = with_runs(per_slice, runs).drop("run_seed")
    changed = signed.groupBy("run_id", SLICE).agg(*[F.sum(c).alias(f"d_{c}") for c in COUNTS])
    more = local.groupBy("run_id", SLICE).agg(F.max("more").alias("d_cells"))
    # A slice may have arrivals but no cell of the baseline.
    extra = changed.select("run_id", SLICE).join(per_slice.select(SLICE), SLICE, "left_anti")
    fracs = with_runs(baseline.sparkSession.range(1), runs).select("run_id", "frac")
    extra = extra.join(fracs, "run_id").select(SLICE, *[F.lit(0).cast("long").alias(c) for c in ("cells", *COUNTS)], "run_id", "frac")
    frame = frame.unionByName(extra).join(changed, ["run_id", SLICE], "left").join(more, ["run_id", SLICE], "left")
    here = {c: F.col(c) + F.coalesce(f"d_{c}", F.lit(0)) for c in ("cells", *COUNTS)}
    earlier = Window.partitionBy("run_id").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("run_id")
    offsets = freeze(
        frame.select(SLICE, *RUN_KEYS, *[v.cast("long").alias(c) for c, v in here.items()]).select(
            SLICE, *RUN_KEYS, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("cells", *COUNTS)],
            *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("cells", *COUNTS)],
        )
    )

    begins = offsets.select("run_id", SLICE, F.lit(None).cast("double").alias("key"), *COUNTS, F.lit(True).alias("begins"))
    right = signed.select("run_id", SLICE, "key", *COUNTS, F.lit(False).alias("begins")).unionByName(begins)
    areas = _by_slice(base, right, blocks, _areas, "run_id int, area double").groupBy("run_id").agg(F.sum("area").alias("_area"))
    totals = offsets.groupBy(*RUN_KEYS).agg(*[F.first(f"all_{c}").alias(c) for c in COUNTS])
    qini = totals.join(areas, "run_id").select(*RUN_KEYS, _coefficient().alias("qini_coeff"))

    placed = local.where("n > 0").join(offsets.select(*RUN_KEYS, SLICE, "cells", "all_cells"), ["run_id", SLICE])
    after = (F.col("cells") + F.col("local")) / F.col("all_cells").cast("double")
    return placed.select(*RUN_KEYS, F.col("rank_before").alias("normalised_rank"), after.alias("normalised_rank_modified"), "n"), qini


def _coefficient() -> Column:
    """Qini coefficient from `_area` and the totals of a run."""
    n, nt, yt, yc = (F.col(c).cast("double") for c in COUNTS)
    ratio = F.coalesce(F.try_divide(nt, n - nt), F.lit(0.0))
    last = yt - yc * ratio
    baseline = n * last / 2
    perfect = yt * yt / 2 + (n - yt - yc) * yt + yc * (yt + last) / 2
    return F.try_divide(F.col("_area") - baseline, perfect - baseline)
