"""Experiment summaries over many runs, and the per-feature action report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swayrank.functions.joins import join_groups
from swayrank.operators.order import running_totals
from swayrank.operators.prepare import relative_drop
from swayrank.operators.stats import PROPOSAL_QUANTILES, exact_quantiles, quantile_columns

METRICS = ("ci_low", "ci_high", "delta_qini")
SERIES_KEYS = ["dataset", "target_feature", "model"]

# The participation shares of the published grid, 1 % to 10 %.
GRID_FRACTIONS = tuple(k / 100 for k in range(1, 11))


def with_rounded_frac(df: DataFrame) -> DataFrame:
    """Make fractions comparable: 0.07 and 7 / 100 are the same share."""
    return df.withColumn("frac", F.round(F.col("frac"), 4))


def aggregate_experiments(results: DataFrame) -> DataFrame:
    """Mean, sample deviation, median, minimum and maximum of each metric per series and share."""
    keys = [*SERIES_KEYS, "frac"]
    drops = with_rounded_frac(relative_drop(results))
    moments = []
    for metric in METRICS:
        col = F.col(metric)
        moments += [
            F.avg(col).alias(f"avg_{metric}"),
            F.stddev_samp(col).alias(f"std_{metric}"),
            F.min(col).alias(f"min_{metric}"),
            F.max(col).alias(f"max_{metric}"),
        ]
    base = drops.groupBy(*keys).agg(*moments)
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    long = drops.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.metric", "_p.value")
    medians = exact_quantiles(long, "value", {"median": 0.5}, by=[*keys, "metric"])
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("median"))).alias(f"median_{m}") for m in METRICS]
    )
    columns = [f"{stat}_{m}" for m in METRICS for stat in ("avg", "std", "median", "min", "max")]
    return join_groups(base, wide, keys, "left").select(*columns, "dataset", "model", "target_feature", "frac")


def distinct_series(results: DataFrame) -> DataFrame:
    """The (dataset, feature, model) series present in the results."""
    return results.select(*SERIES_KEYS).distinct()


def missing_cells(results: DataFrame, fracs: Sequence[float] = GRID_FRACTIONS) -> DataFrame:
    """Combinations of an existing series and a grid share for which there is no result."""
    shares = F.explode(F.array(*[F.lit(round(float(f), 4)) for f in fracs])).alias("frac")
    grid = distinct_series(results).select(*SERIES_KEYS, shares)
    present = with_rounded_frac(results).select(*SERIES_KEYS, "frac").distinct()
    return grid.join(present, [*SERIES_KEYS, "frac"], "left_anti")


def with_origin(agg: DataFrame, values: Sequence[str] = ("avg_delta_qini", "avg_ci_low", "avg_ci_high")) -> DataFrame:
    """Every series with a point (0, 0) in front, ordered by share."""
    points = agg.select(*SERIES_KEYS, "frac", *values)
    origin = distinct_series(agg).select(
        *SERIES_KEYS, F.lit(0.0).alias("frac"), *[F.lit(0.0).alias(v) for v in values]
    )
    return origin.unionByName(points).orderBy(*SERIES_KEYS, "frac")


def rank_decrease_series(agg: DataFrame) -> DataFrame:
    """Centre of the average interval per share, with its bounds, starting at the origin."""
    series = with_origin(agg, ("avg_ci_low", "avg_ci_high"))
    centre = (F.col("avg_ci_low") + F.col("avg_ci_high")) / 2
    return series.select(
        *SERIES_KEYS,
        "frac",
        centre.alias("avg_rank_decrease"),
        F.col("avg_ci_low").alias("ci_low"),
        F.col("avg_ci_high").alias("ci_high"),
    )


def band(df: DataFrame, centre: str, half_width: str) -> DataFrame:
    """Add `lower` and `upper` = centre -/+ half width."""
    return df.withColumns(
        {"lower": F.col(centre) - F.col(half_width), "upper": F.col(centre) + F.col(half_width)}
    )


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, null where one side is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def two_decimals(value: Column) -> Column:
    """Half-even on the exact binary value, as C and Python print it."""
    return F.call_function("format_number", value, F.lit("0.00"))


def plain_number(value: Column) -> Column:
    """A double as Python prints it: no exponent for whole numbers below 1e16."""
    whole = (value == F.floor(value)) & (F.abs(value) >= 1e7) & (F.abs(value) < 1e16)
    return F.when(whole, F.concat(value.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(
        value.cast("string")
    )


def propose_action(stats: DataFrame, correlation: str = "correlation") -> DataFrame:
    """Add proposed_strategy, from_value and to_value.

    Needs feature, categorical, min_value, max_value, p10, p20, p80, p90. Only a correlation of
    exactly 0 gives no proposal; an undefined one is treated as negative.
    """
    corr = F.col(correlation)
    none = F.coalesce(corr == 0, F.lit(False))
    rising = F.coalesce(corr > 0, F.lit(False))
    low, high = F.col("min_value"), F.col("max_value")
    start = F.when(F.col("categorical"), F.when(rising, low).otherwise(high)).otherwise(
        F.when(rising, F.col("p10")).otherwise(F.col("p90"))
    )
    end = F.when(F.col("categorical"), F.when(rising, high).otherwise(low)).otherwise(
        F.when(rising, F.col("p90")).otherwise(F.col("p10"))
    )
    swap = F.concat(F.lit("Modify "), "feature", F.lit(" from "), plain_number(start), F.lit(" to "), plain_number(end))
    spread = two_decimals(F.col("p90") - F.col("p10"))
    up = F.concat(F.lit("Increase "), "feature", F.lit(" by "), spread, F.lit(" for values below "),
                  two_decimals(F.col("p20")))
    down = F.concat(F.lit("Decrease "), "feature", F.lit(" by "), spread, F.lit(" for values above "),
                    two_decimals(F.col("p80")))
    text = F.when(F.col("categorical"), swap).otherwise(F.when(rising, up).otherwise(down))
    return stats.withColumns({
        "proposed_strategy": F.when(none, "N/A (no correlation)").otherwise(text),
        "from_value": F.when(~none, start),
        "to_value": F.when(~none, end),
    })



def value_statistics(long: DataFrame, value: str = "value", threshold: int = 10) -> DataFrame:
    """Range, distinct count and proposal percentiles of each feature of a long table, in one pass."""
    cells = running_totals(
        long.select("feature", value), value, {"n": F.count("*")}, by=["feature"], descending=False
    )
    spread = cells.groupBy("feature").agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.max("all_cells").alias("n_unique")
    )
    percentiles = quantile_columns(cells, value, PROPOSAL_QUANTILES, ["feature"])
    return spread.join(percentiles, "feature").withColumn("categorical", F.col("n_unique") <= threshold)


def feature_report(attributions: DataFrame) -> DataFrame:
    """Impact, direction and proposed change of every feature, ranked by correlation.

    `attributions` is long: feature, value (as the model saw it), original (in the feature's own
    unit), phi. Rows per feature are only ever partially aggregated; the final ranking runs over one
    row per feature.
    """
    impact = attributions.groupBy("feature").agg(
        F.avg("phi").alias("mean_shap"),
        F.avg(F.abs("phi")).alias("importance"),
        safe_corr(F.col("value"), F.col("phi")).alias("correlation"),
    )
    stats = value_statistics(attributions, "original")
    proposed = propose_action(impact.join(stats, "feature"))
    by_corr = Window.orderBy(F.col("correlation").desc_nulls_last(), F.col("feature"))
    return proposed.select(
        "feature",
        "mean_shap",
        "importance",
        "correlation",
        F.when(F.col("correlation") > 0, "Positive").otherwise("Negative").alias("direction"),
        "proposed_strategy",
        "from_value",
        "to_value",
        F.row_number().over(by_corr).alias("rank"),
    )
