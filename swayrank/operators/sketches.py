"""Approximate quantiles from sketches that can be kept and added up, for tables too large to count every value.

The exact operators in `stats` stay the default. A KLL sketch of a group has a size that depends on `k` alone; sketches of days,
files or runs are merged without looking at the rows again. The rank of a quantile it gives is off by at most `rank_error(k)` of
the group's rows with a probability of 99 %.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayrank.operators.stats import PROPOSAL_QUANTILES, feature_values

SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """The normalised rank error of a sketch, by the published fit for single ranks."""
    return 2.296 / k**0.9021


def quantile_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """(by.., feature, n, sketch) per group and column, in one pass; nulls and NaN are left out."""
    long = feature_values(df, cols, by).where("value is not null and not isnan(value)")
    return long.groupBy(*by, "feature").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", k).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """Add up sketches of one feature (and group), for instance those of several days."""
    return sketches.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, quantiles: Mapping[str, float] = PROPOSAL_QUANTILES, by: Sequence[str] = ()) -> DataFrame:
    """(by.., feature, one column per quantile) from sketches."""
    wanted = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in quantiles.items()]
    return sketches.select(*by, "feature", *wanted)
