"""Grids whose finished cells survive: results are written by batches of runs, with a list of what is finished beside them.

A batch is written to a partition of its own and listed afterwards. A grid that is started again leaves listed cells out; a batch
that was written but not listed is not read, and the restart writes it again. Other studies in the folder stay as they are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from swayrank.operators.action import CollectiveAction, Run
from swayrank.plans.experiment import Trial, ranked_cells, run_grid
from swayrank.plans.refit import Rescore
from swayrank.sources.tables import RESULT_SCHEMA, write_partitions

STUDY = ["dataset", "model", "target_feature"]
LISTED = "_finished"  # folders that begin so are left out when results are read
CELL_SCHEMA = StructType([
    *[RESULT_SCHEMA[c] for c in STUDY], StructField("study", StringType()), StructField("run_id", IntegerType()),
    StructField("seed", IntegerType()), RESULT_SCHEMA["frac"], StructField("batch", StringType()),
])
STORED_SCHEMA = StructType([StructField("run_id", IntegerType()), *RESULT_SCHEMA, StructField("batch", StringType())])


def study_key(action: CollectiveAction, trial: Trial) -> str:
    """What tells studies apart: the trial's names and everything about the action but its share."""
    parts = [trial.dataset, trial.model, trial.target, trial.treatment, dict(action.criterion), [dict(a) for a in action.attacks], action.floor]
    return hashlib.md5(json.dumps(parts).encode()).hexdigest()


def finished_cells(spark: SparkSession, folder: str) -> DataFrame:
    """One row per finished cell; none if nothing was written to the folder yet."""
    try:
        return spark.read.schema(CELL_SCHEMA).parquet(f"{folder}/{LISTED}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CELL_SCHEMA)


def finished_results(spark: SparkSession, folder: str) -> DataFrame:
    """Result rows (with run_id) of all finished batches of all studies."""
    batches = finished_cells(spark, folder).select("batch").distinct()
    if not batches.head(1):
        return spark.createDataFrame([], STORED_SCHEMA).drop("batch")
    return spark.read.schema(STORED_SCHEMA).parquet(folder).join(batches, "batch", "left_semi").drop("batch")


def open_runs(spark: SparkSession, folder: str, study: str, runs: Sequence[Run]) -> list[Run]:
    """The runs of a study that are not listed as finished, in the given order; as many rows as runs were given at most."""
    asked = spark.createDataFrame([(r.run_id, r.seed, float(r.frac), n) for n, r in enumerate(runs)], "run_id int, seed int, frac double, n int")
    done = finished_cells(spark, folder).where(F.col("study") == study)
    left = asked.join(done, ["run_id", "seed", "frac"], "left_anti").select("n").collect()
    return [runs[i] for i in sorted(row["n"] for row in left)]


def run_grid_into(
    folder: str, scored_test: DataFrame, action: CollectiveAction, runs: Sequence[Run], rescore: Rescore, trial: Trial,
    batch_runs: int = 100, baseline: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """`run_grid` with its results kept in `folder`; returns the rows of this study's runs.

    Runs already finished there are not run again. One grid at a time may write to a folder. All batches start from one `baseline`:
    what `ranked_cells` made of `scored_test`, worked out here unless given.
    """
    spark, study = scored_test.sparkSession, study_key(action, trial)
    left = open_runs(spark, folder, study, runs)
    if left and baseline is None:
        baseline = ranked_cells(scored_test, trial)
    for start in range(0, len(left), batch_runs):
        part = left[start : start + batch_runs]
        batch = hashlib.md5(json.dumps([study, [(r.run_id, r.seed, r.frac) for r in part]]).encode()).hexdigest()
        rows = run_grid(scored_test, action, part, rescore, trial, baseline).withColumn("batch", F.lit(batch))
        write_partitions(rows, folder, [*STUDY, "batch"])
        names = (trial.dataset, trial.model, action.feature, study)
        cells = spark.createDataFrame([(*names, r.run_id, r.seed, float(r.frac), batch) for r in part], CELL_SCHEMA)
        cells.coalesce(1).write.mode("append").parquet(f"{folder}/{LISTED}")
    mine = finished_cells(spark, folder).where(F.col("study") == study).select("run_id", "frac", "batch")
    asked = spark.createDataFrame([(r.run_id, float(r.frac)) for r in runs], "run_id int, frac double")
    wanted = mine.join(asked, ["run_id", "frac"], "left_semi")
    stored = spark.read.schema(STORED_SCHEMA).parquet(folder)
    return stored.join(wanted, ["run_id", "frac", "batch"], "left_semi").select("run_id", *[f.name for f in RESULT_SCHEMA])
