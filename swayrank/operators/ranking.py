"""Ranks, uplift curves and Qini measures of a scored campaign table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swayrank.functions.joins import join_spread
from swayrank.operators.order import ordered_index, running_totals
from swayrank.session import freeze

CURVE_NODES = 201


def response_totals(treatment: str, target: str) -> dict[str, Column]:
    """Aggregates a ranked cell needs: rows, treated rows and responses per arm."""
    t, y = F.col(treatment).cast("long"), F.col(target).cast("long")
    return {
        "n": F.count("*"),
        "nt": F.sum(t),
        "yt": F.sum(t * y),
        "yc": F.sum((F.lit(1) - t) * y),
    }


def net_responses(n: Column, nt: Column, yt: Column, yc: Column) -> Column:
    """Treated responses less control responses scaled to the treated count; no control, no deduction."""
    ratio = F.coalesce(F.try_divide(nt.cast("double"), (n - nt).cast("double")), F.lit(0.0))
    return yt - yc * ratio


def attach_ranks(df: DataFrame, cells: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Add `rank` and `normalised_rank` from cells that `running_totals` built over `df`, with their row count `n`.

    A score that very many rows share gets its ranks by broadcast, so no task holds all rows of a score.
    """
    ranks = freeze(cells.select(
        *by,
        score,
        "n",
        F.col("cum_cells").alias("rank"),
        (F.col("cum_cells") / F.col("all_cells").cast("double")).alias("normalised_rank"),
    ))
    return join_spread(df, ranks, [*by, score], "n")


def dense_rank_desc(df: DataFrame, score: str = "uplift", by: Sequence[str] = ()) -> DataFrame:
    """Dense rank by descending score: the distinct scores are ranked, then looked up per row."""
    cells = running_totals(df, score, {"n": F.count("*")}, by=by)
    return attach_ranks(df, cells, score, by).drop("normalised_rank")


def normalised_rank(df: DataFrame, score: str = "uplift", by: Sequence[str] = ()) -> DataFrame:
    """Dense rank divided by the highest rank, in (0, 1]; small means targeted first."""
    cells = running_totals(df, score, {"n": F.count("*")}, by=by)
    return attach_ranks(df, cells, score, by).drop("rank")


def ranking_positions(
    df: DataFrame, score: str = "uplift", id_col: str = "ID", by: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """0-based position of each row in descending score order; ties follow the ID."""
    slim = df.select(*by, id_col, score, *keep)
    order = [F.col(score).desc_nulls_last(), F.col(id_col).asc()]
    return ordered_index(slim, order, by, "position")


def response_cells(
    df: DataFrame, score: str, treatment: str, target: str, by: Sequence[str] = ()
) -> DataFrame:
    """Cells of identical (score, treatment, response) in descending order with running totals."""
    return running_totals(
        df.select(*by, score, treatment, target),
        score,
        response_totals(treatment, target),
        by=by,
        ties=[treatment, target],
    )


def _inside_cell(x: Column, treatment: str, target: str) -> dict[str, Column]:
    """Running totals after `x` rows, for an `x` that falls into the current cell."""
    t, y = F.col(treatment).cast("long"), F.col(target).cast("long")
    extra = x - (F.col("cum_n") - F.col("n"))
    return {
        "nt": F.col("cum_nt") - F.col("nt") + extra * t,
        "yt": F.col("cum_yt") - F.col("yt") + extra * t * y,
        "yc": F.col("cum_yc") - F.col("yc") + extra * (F.lit(1) - t) * y,
    }


def cumulative_responses(
    df: DataFrame,
    score: str = "uplift",
    treatment: str = "treatment",
    target: str = "visit",
    by: Sequence[str] = (),
    chunk: int = 1_000_000,
) -> DataFrame:
    """Counts and responses per arm after each row of the ranking, starting with zeros.

    A cell can stand for a third of all rows, so it is first cut into chunks that are spread over
    the cluster, and only then unfolded to one row per position.
    """
    cells = response_cells(df, score, treatment, target, by)
    first = F.col("cum_n") - F.col("n")
    # The origin belongs to the first cell: its chunks start at position 0 instead of 1.
    low = F.when(first == 0, F.lit(0)).otherwise(first + 1)
    chunks = cells.withColumn("_from", F.explode(F.sequence(low.cast("long"), F.col("cum_n"), F.lit(chunk))))
    spread = chunks.repartition(*by, "_from")
    last = F.least(F.col("_from") + F.lit(chunk - 1), F.col("cum_n"))
    rows = spread.withColumn("position", F.explode(F.sequence(F.col("_from"), last)))
    at = _inside_cell(F.col("position"), treatment, target)
    return rows.select(
        *by,
        "position",
        at["yc"].alias("responses_control"),
        at["yt"].alias("responses_treated"),
        (F.col("position") - at["nt"]).alias("n_control"),
        at["nt"].alias("n_treated"),
    )


def uplift_curve(
    df: DataFrame,
    score: str = "uplift",
    treatment: str = "treatment",
    target: str = "visit",
    by: Sequence[str] = (),
    n_nodes: int | None = None,
) -> DataFrame:
    """Cumulative uplift at evenly spaced targeting depths (node, x, uplift).

    A node falls into exactly one cell, and rows inside a cell are alike, so the running totals at
    the node follow from the cell alone. Each cell works out its own nodes; nothing is joined.
    """
    if n_nodes is not None and n_nodes < 2:
        raise ValueError("a curve needs at least its two ends")
    cells = response_cells(df, score, treatment, target, by)
    total = F.col("all_n")
    nodes = F.lit(n_nodes).cast("long") if n_nodes else F.least(total + 1, F.lit(CURVE_NODES).cast("long"))
    last_node = nodes - 1
    start, end = F.col("cum_n") - F.col("n"), F.col("cum_n")
    low = F.greatest(F.floor(start * last_node / total) - 1, F.lit(0))
    high = F.least(F.ceil(end * last_node / total) + 1, last_node)
    step = total / last_node.cast("double")
    at_node = cells.withColumn("node", F.explode(F.sequence(low, high))).withColumn(
        "x", F.when(F.col("node") == last_node, total).otherwise(F.floor(F.col("node") * step))
    )
    hit = ((F.col("x") > start) & (F.col("x") <= end)) | ((F.col("x") == 0) & (start == 0))
    at = _inside_cell(F.col("x"), treatment, target)
    # responses scale as yc * nt / nc, in this order of operations
    control = F.coalesce(F.try_divide((at["yc"] * at["nt"]).cast("double"), F.col("x") - at["nt"]), F.lit(0.0))
    return at_node.where(hit).select(
        *by, F.col("node").cast("int").alias("node"), "x", (at["yt"] - control).alias("uplift")
    )


def qini_cells(
    df: DataFrame, score: str, treatment: str, target: str, by: Sequence[str] = (),
    points: Sequence[float] | None = None,
) -> DataFrame:
    """One row per distinct score with everything ranks and Qini measures need."""
    return running_totals(
        df.select(*by, score, treatment, target), score, response_totals(treatment, target), by=by, points=points
    )


def _value() -> Column:
    return net_responses(F.col("cum_n"), F.col("cum_nt"), F.col("cum_yt"), F.col("cum_yc"))


def _value_before() -> Column:
    return net_responses(*[F.col(f"cum_{c}") - F.col(c) for c in ("n", "nt", "yt", "yc")])


def _with_origin(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Unfold (x, value) points; the first point of a group also yields (0, 0)."""
    here = F.struct(F.col("x"), F.col("value"))
    origin = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0.0).alias("value"))
    pair = F.when(F.col("_first"), F.array(origin, here)).otherwise(F.array(here))
    return points.select(*by, F.explode(pair).alias("_p")).select(*by, "_p.x", "_p.value")


def qini_curve(
    df: DataFrame, score: str = "uplift", treatment: str = "treatment", target: str = "visit",
    by: Sequence[str] = (),
) -> DataFrame:
    """Qini curve (x, value): one point per distinct score and the origin."""
    cells = qini_cells(df, score, treatment, target, by)
    points = cells.select(
        *by, F.col("cum_n").alias("x"), _value().alias("value"), (F.col("cum_cells") == 1).alias("_first")
    )
    return _with_origin(points, by)


def perfect_qini_curve(
    df: DataFrame, treatment: str = "treatment", target: str = "visit", by: Sequence[str] = ()
) -> DataFrame:
    """Qini curve of the best order: treated responders, everyone silent, control responders.

    Only three scores exist, so the window runs over at most three rows per group.
    """
    t, y = F.col(treatment), F.col(target)
    best = df.select(*by, treatment, target, (y * t - y * (F.lit(1) - t)).alias("_best"))
    cells = best.groupBy(*by, "_best").agg(*[e.alias(c) for c, e in response_totals(treatment, target).items()])
    order = Window.partitionBy(*by).orderBy(F.col("_best").desc())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = cells.select(
        *by,
        *[F.sum(c).over(upto).alias(f"cum_{c}") for c in ("n", "nt", "yt", "yc")],
        (F.row_number().over(order) == 1).alias("_first"),
    )
    return _with_origin(running.select(*by, F.col("cum_n").alias("x"), _value().alias("value"), "_first"), by)


def qini_auc_from_cells(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Qini AUC per group from `qini_cells`.

    The point before a cell is the running total less the cell itself, so the trapezoids need no lag.
    The perfect curve has three segments and follows from the group totals.
    """
    strip = F.col("n") * (_value() + _value_before()) / F.lit(2.0)
    sums = cells.groupBy(*by).agg(
        F.sum(strip).alias("_area"), *[F.max(f"all_{c}").alias(c) for c in ("n", "nt", "yt", "yc")]
    )
    n, nt, yt, yc = (F.col(c).cast("double") for c in ("n", "nt", "yt", "yc"))
    last = net_responses(n, nt, yt, yc)
    baseline = n * last / 2
    perfect = yt * yt / 2 + (n - yt - yc) * yt + yc * (yt + last) / 2
    return sums.select(*by, F.try_divide(F.col("_area") - baseline, perfect - baseline).alias("qini_coeff"))


def qini_auc(
    df: DataFrame, score: str = "uplift", treatment: str = "treatment", target: str = "visit",
    by: Sequence[str] = (),
) -> DataFrame:
    """Area between Qini curve and random targeting, relative to the perfect curve; null if undefined."""
    return qini_auc_from_cells(qini_cells(df, score, treatment, target, by), by)


def number_responses(
    df: DataFrame, treatment: str = "treatment", target: str = "visit", by: Sequence[str] = ()
) -> DataFrame:
    """Treated responses, and control responses scaled to the treated count (0 without control)."""
    sums = df.groupBy(*by).agg(*[e.alias(c) for c, e in response_totals(treatment, target).items()])
    scaled = F.try_divide((F.col("yc") * F.col("nt")).cast("double"), (F.col("n") - F.col("nt")).cast("double"))
    return sums.select(
        *by,
        F.coalesce("yt", F.lit(0)).alias("responses_treated"),
        F.coalesce(scaled, F.lit(0.0)).alias("rescaled_responses_control"),
        "n",
    )


def random_baseline(
    df: DataFrame, treatment: str = "treatment", target: str = "visit", by: Sequence[str] = ()
) -> DataFrame:
    """The line random targeting follows: (0, 0) and (n, net responses)."""
    ends = number_responses(df, treatment, target, by)
    end = F.struct(
        F.col("n").alias("x"), (F.col("responses_treated") - F.col("rescaled_responses_control")).alias("uplift")
    )
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0.0).alias("uplift"))
    return ends.select(*by, F.explode(F.array(start, end)).alias("_p")).select(*by, "_p.x", "_p.uplift")
