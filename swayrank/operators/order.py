"""Global order without a global sort in one task.

Two building blocks carry every ranking operator:

`running_totals` first collapses rows that share a score into one cell, then cuts the score axis at
literal split points and runs the window inside each slice. A slice holds about 1/n of the rows at
most, however skewed the scores are: a score shared by a third of all rows is a single cell.

`ordered_index` numbers single rows in any order. Spark's range partitioner splits the composite
key, so ties on the leading column spread over partitions by the columns after it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swayrank.functions.joins import join_groups
from swayrank.session import freeze

KEY = "_key"
SLICE = "_slice"
MAX_SLICES = 2000
LOCAL_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def slice_count(spark: SparkSession) -> int:
    """As many slices as shuffle partitions, within what a quantile summary can resolve."""
    return max(2, min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_SLICES))


def split_points(df: DataFrame, key: str, slices: int | None = None) -> list[float]:
    """About evenly filled slice edges of `key`, from one approximate quantile pass.

    The edges become literals, so every later job and every retried task cuts at the same values.
    They steer only the balance of the work; results do not depend on them.
    """
    slices = slices or slice_count(df.sparkSession)
    probabilities = [i / slices for i in range(1, slices)]
    return sorted(set(df.approxQuantile(key, probabilities, 0.5 / slices)))


def sort_key(score: str, sign: float) -> Column:
    """Ascending sort key of a score; NaN counts as null."""
    value = F.col(score).cast("double")
    return F.when(~F.isnan(value), value * F.lit(sign))


def score_points(df: DataFrame, score: str, slices: int | None = None) -> list[float]:
    """Slice edges for descending `running_totals`, taken from rows that stand for the others."""
    return split_points(df.select(sort_key(score, -1.0).alias(KEY)), KEY, slices)


def even_points(low: float, high: float, slices: int) -> list[float]:
    """Equal-width edges, for keys known to be evenly spaced such as normalised ranks."""
    step = (high - low) / slices
    return [low + i * step for i in range(1, slices)]


def with_slice(df: DataFrame, key: str, points: Sequence[float]) -> DataFrame:
    """Add the slice number of `key`; null and NaN go to a slice after all others."""
    last = F.lit(len(points) + 1)
    if not points:
        return df.withColumn(SLICE, F.when(F.col(key).isNull() | F.isnan(key), last).otherwise(0))
    edges = [float("-inf"), *points, float("inf")]
    cutter = Bucketizer(splits=edges, inputCol=key, outputCol=SLICE, handleInvalid="keep")
    return cutter.transform(df).withColumn(SLICE, F.coalesce(F.col(SLICE).cast("int"), last))


def running_totals(
    df: DataFrame,
    score: str,
    totals: Mapping[str, Column],
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    descending: bool = True,
    points: Sequence[float] | None = None,
) -> DataFrame:
    """One row per distinct (by, score, ties) with its totals and the totals up to and including it.

    `totals` maps a name to an aggregate expression over the rows of a cell, for instance
    ``{"n": F.count("*")}``. The result has, for every name, the cell's own value `n`, the running
    value `cum_n` and the group's whole value `all_n`; `cum_cells` and `all_cells` count the cells.
    Order is by score, then by `ties`, all in the same direction; null scores come last.
    `points` are slice edges on the sort key (the negated score when descending).
    """
    by, ties = list(by), list(ties)
    sign = -1.0 if descending else 1.0
    keyed = df.withColumn(KEY, sort_key(score, sign))
    if points is None:
        points = split_points(keyed, KEY)
    cells = (
        with_slice(keyed, KEY, points)
        .groupBy(*by, SLICE, KEY, *ties)
        .agg(F.lit(1).cast("long").alias("cells"), *[expr.alias(name) for name, expr in totals.items()])
    )
    names = ["cells", *totals]
    direction = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_last())
    inside = (
        Window.partitionBy(*by, SLICE)
        .orderBy(F.col(KEY).asc_nulls_last(), *[direction(c) for c in ties])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cells.select("*", *[F.sum(c).over(inside).alias(f"cum_{c}") for c in names])

    # One row per slice from here on: at most `slice_count` rows per group.
    slices = cells.groupBy(*by, SLICE).agg(*[F.sum(c).alias(c) for c in names])
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = slices.select(
        *by,
        SLICE,
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in names],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in names],
    )
    # A left join can only ever broadcast the offsets, never the cells.
    placed = join_groups(local, offsets, [*by, SLICE], "left")
    return placed.select(
        *by,
        (F.col(KEY) * F.lit(sign)).alias(score),
        *ties,
        *totals,
        *[(F.col(f"cum_{c}") + F.col(f"_before_{c}")).alias(f"cum_{c}") for c in names],
        *[f"all_{c}" for c in names],
    )


def ordered_index(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), out: str = "index") -> DataFrame:
    """Number the rows of each group 0..n-1 in the given order.

    End `order` with a unique column: it makes the numbering repeatable and lets the range
    partitioner split ties. The sorted rows are frozen, because partition bounds come from a
    sample and must not be drawn again between counting the partitions and numbering the rows.
    """
    by = list(by)
    keys = [*[F.col(c) for c in by], *order]
    ids = F.monotonically_increasing_id()
    placed = freeze(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mark", ids)
        .withColumn("_part", F.shiftright("_mark", LOCAL_ROW_BITS))
        .withColumn("_row", F.col("_mark").bitwiseAND(F.lit((1 << LOCAL_ROW_BITS) - 1)))
        .drop("_mark")
    )
    runs = placed.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_size"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *by, "_part", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_start")
    )
    numbered = join_groups(placed, starts, [*by, "_part"], "left")
    return numbered.withColumn(out, F.col("_row") + F.col("_start")).drop("_row", "_start", "_part")
