"""Exact quantiles, paired intervals, participant summaries and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayrank.functions.joins import join_groups
from swayrank.functions.student import t_critical
from swayrank.operators.order import even_points, running_totals, slice_count

HISTOGRAM_BINS = 50
POSITION_BINS = 200


def quantile_columns(cells: DataFrame, value: str, quantiles: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """Quantiles with linear interpolation from cells that carry `n`, `cum_n` and `all_n`."""
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1

    def at(position: Column) -> Column:
        return F.max(F.when((position >= first) & (position <= last), F.col(value)))

    picks, outs = [], []
    for name, q in quantiles.items():
        place = (F.col("all_n") - 1) * F.lit(float(q))
        picks += [
            at(F.floor(place)).alias(f"_low_{name}"),
            at(F.ceil(place)).alias(f"_high_{name}"),
            F.max(place - F.floor(place)).alias(f"_part_{name}"),
        ]
        low, high, part = F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col(f"_part_{name}")
        outs.append((low + (high - low) * part).alias(name))
    return cells.groupBy(*by).agg(*picks).select(*by, *outs)


def exact_quantiles(
    df: DataFrame, value: str, quantiles: Mapping[str, float], by: Sequence[str] = (),
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per entry of `quantiles`.

    Equal values are counted first and the wanted order statistics are picked from running counts;
    the built-in exact percentile would hold all of a group's values in one buffer.
    """
    present = df.select(*by, value).where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cells = running_totals(present, value, {"n": F.count("*")}, by=by, descending=False, points=points)
    return quantile_columns(cells, value, quantiles, by)


def feature_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (keep.., feature, value) of numeric columns."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_p")).select(*keep, "_p.feature", "_p.value")


# The percentiles action proposals are built from.
PROPOSAL_QUANTILES = {"p10": 0.1, "p20": 0.2, "p80": 0.8, "p90": 0.9}


def feature_percentiles(
    df: DataFrame, cols: Sequence[str], quantiles: Mapping[str, float] = PROPOSAL_QUANTILES
) -> DataFrame:
    """Percentiles of every column, all columns in one job (feature, p10, ..)."""
    return exact_quantiles(feature_values(df, cols), "value", quantiles, by=["feature"])


def is_categorical(df: DataFrame, cols: Sequence[str], threshold: int = 10) -> DataFrame:
    """Distinct values per column and whether there are at most `threshold` of them."""
    distinct = feature_values(df, cols).distinct()
    counted = distinct.groupBy("feature").agg(F.count("*").alias("n_unique"))
    return counted.withColumn("categorical", F.col("n_unique") <= threshold)


def paired_moments(before: str, after: str) -> list[Column]:
    """Aggregates of D = before - after an interval needs: pairs, mean, standard error."""
    d = F.col(before) - F.col(after)
    return [
        F.count(d).alias("n"),
        F.avg(d).alias("mean_diff"),
        (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se_diff"),
    ]


def with_interval(moments: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Add the t-interval of the mean difference; null bounds for a single pair."""
    margin = t_critical(F.col("n") - 1, confidence) * F.col("se_diff")
    return (
        moments.withColumn("_margin", margin)
        .withColumns({"ci_low": F.col("mean_diff") - F.col("_margin"), "ci_high": F.col("mean_diff") + F.col("_margin")})
        .drop("_margin")
    )


def paired_t_interval(
    df: DataFrame, before: str = "normalised_rank", after: str = "normalised_rank_modified",
    by: Sequence[str] = (), confidence: float = 0.95,
) -> DataFrame:
    """Mean difference before - after with its confidence interval, per group."""
    return with_interval(df.groupBy(*by).agg(*paired_moments(before, after)), confidence)


def participants(df: DataFrame, flag: str = "aca_flag") -> DataFrame:
    return df.where(F.col(flag) == 1)


def summarise_participants(
    df: DataFrame, by: Sequence[str] = (), before: str = "normalised_rank", after: str = "normalised_rank_modified",
) -> DataFrame:
    """Count, means and exact medians of the rank before and after, and the paired interval.

    Normalised ranks are evenly spaced in (0, 1], so equal-width slices are balanced without a
    quantile pass.
    """
    means = with_interval(df.groupBy(*by).agg(
        F.count("*").alias("num_participants"),
        F.avg(before).alias("avg_normalised_rank"),
        F.avg(after).alias("avg_modified_normalised_rank"),
        *paired_moments(before, after),
    ))
    phases = F.explode(F.array(
        F.struct(F.lit("before").alias("phase"), F.col(before).alias("value")),
        F.struct(F.lit("after").alias("phase"), F.col(after).alias("value")),
    ))
    long = df.select(*by, phases.alias("_p")).select(*by, "_p.phase", "_p.value")
    points = even_points(0.0, 1.0, slice_count(df.sparkSession))
    medians = exact_quantiles(long, "value", {"median": 0.5}, by=[*by, "phase"], points=points)
    wide = medians.groupBy(*by).agg(
        F.max(F.when(F.col("phase") == "before", F.col("median"))).alias("median_normalised_rank"),
        F.max(F.when(F.col("phase") == "after", F.col("median"))).alias("median_modified_normalised_rank"),
    )
    return join_groups(means, wide, by, "left").select(
        *by,
        "num_participants",
        "avg_normalised_rank",
        "median_normalised_rank",
        "avg_modified_normalised_rank",
        "median_modified_normalised_rank",
        "ci_low",
        "ci_high",
    )


def binned_counts(values: DataFrame, ranges: DataFrame, bins: int, by: Sequence[str]) -> DataFrame:
    """Count values into equal bins of their group's [_low, _high]; the last bin is closed.

    A value is compared with its bin's edges after the division, so that rounding cannot put it on
    the wrong side. Bins without values are returned with count 0.
    """
    width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    placed = join_groups(values, ranges, by, "left")
    guess = F.greatest(F.least(F.floor((F.col("value") - F.col("_low")) / width), F.lit(bins - 1)), F.lit(0))
    placed = placed.withColumn("_guess", guess)
    low_edge = F.col("_low") + F.col("_guess") * width
    high_edge = F.col("_low") + (F.col("_guess") + 1) * width
    bin_number = (
        F.when((F.col("value") < low_edge) & (F.col("_guess") > 0), F.col("_guess") - 1)
        .when((F.col("value") >= high_edge) & (F.col("_guess") < bins - 1), F.col("_guess") + 1)
        .otherwise(F.col("_guess"))
    )
    counts = placed.groupBy(*by, bin_number.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    frame = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return join_groups(frame, counts, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_low") + F.col("bin") * width).alias("bin_start"),
        width.alias("_width"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    )


def density_histogram(
    df: DataFrame, col: str, bins: int = HISTOGRAM_BINS, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width histogram over each group's own range; the densities integrate to 1."""
    values = df.select(*by, F.col(col).cast("double").alias("value")).where("value is not null")
    ends = values.groupBy(*by).agg(
        F.min("value").alias("_min"), F.max("value").alias("_max"), F.count("*").alias("_total")
    ).where("_total > 0")
    flat = F.col("_min") == F.col("_max")
    half = F.when(flat, 0.5).otherwise(0.0)
    ranges = ends.select(*by, (F.col("_min") - half).alias("_low"), (F.col("_max") + half).alias("_high"))
    counts = join_groups(binned_counts(values, ranges, bins, by), ends.select(*by, "_total"), by)
    density = F.col("count") / (F.col("_total") * F.col("_width"))
    return counts.select(*by, "bin", "bin_start", "count", density.alias("density"))


def compare_distributions(df: DataFrame, bins: int = HISTOGRAM_BINS, by: Sequence[str] = ()) -> DataFrame:
    """Before/after histograms of rank and uplift, for everyone and for participants, in one job."""
    series = []
    for measure, before, after in (
        ("rank", "normalised_rank", "normalised_rank_modified"),
        ("uplift", "uplift", "uplift_modified"),
    ):
        for phase, col in (("before", before), ("after", after)):
            for group in ("all", "participants"):
                value = F.col(col) if group == "all" else F.when(F.col("aca_flag") == 1, F.col(col))
                series.append(F.struct(
                    F.lit(f"{measure}_{group}").alias("series"), F.lit(phase).alias("phase"),
                    value.cast("double").alias("value"),
                ))
    long = df.select(*by, F.explode(F.array(*series)).alias("_p")).select(*by, "_p.series", "_p.phase", "_p.value")
    return density_histogram(long, "value", bins, by=[*by, "series", "phase"])


def position_histogram(
    positions: DataFrame, total: DataFrame, bins: int = POSITION_BINS, by: Sequence[str] = ()
) -> DataFrame:
    """Counts of ranking positions in equal bins over 0..n; `total` has `n` per group."""
    values = positions.select(*by, F.col("position").cast("double").alias("value"))
    ranges = total.select(*by, F.lit(0.0).alias("_low"), F.col("n").cast("double").alias("_high"))
    return binned_counts(values, ranges, bins, by).select(*by, "bin", "bin_start", "count")
