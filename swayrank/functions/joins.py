"""Joins that keep rows whose keys are null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Add the columns of a table of at most one row to every row, as a scalar subquery.

    Spark runs the subquery once and fails if it has more than one row; no join takes place. If it
    has none, the columns are null.
    """
    names = right.columns
    packed = right.select(F.struct(*[F.col(c) for c in names]).alias("_row")).scalar()
    return left.withColumn("_row", packed).select(*left.columns, *[F.col(f"_row.{c}").alias(c) for c in names])


def join_groups(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on `on` where null matches null; the key columns appear once, from `left`.

    With no keys `right` holds totals over all rows: a single row, attached to every left row.
    """
    if not on:
        return attach_one_row(left, right)
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    matches = [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in on]
    joined = left.join(renamed, reduce(lambda a, b: a & b, matches), how)
    return joined.drop(*[f"_right_{c}" for c in on])


HOT_SHARE = 1000


def join_spread(left: DataFrame, facts: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """Left join with `facts`, which has each key once and in `weight` the number of `left` rows that have it; null matches null.

    Keys with more than a `HOT_SHARE`-th of all rows are `HOT_SHARE` at most: their facts are broadcast, and their rows are spread
    over the partitions of the join that serves the other keys, where they match nothing. No partition holds a hot key.
    """
    names = [c for c in facts.columns if c not in (*on, weight)]
    total = facts.agg(F.sum(weight).alias("_all"))
    hot = attach_one_row(facts, total).where(F.col(weight) * HOT_SHARE > F.col("_all"))
    hot = hot.select(*on, F.lit(True).alias("_is_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names])
    marked = join_groups(left, F.broadcast(hot), on, "left")
    hashed = [c for c, kind in left.dtypes if "map<" not in kind]
    salted = marked.withColumn("_salt", F.when(F.col("_is_hot"), F.xxhash64(*hashed)).otherwise(F.lit(0)))
    joined = join_groups(salted, facts.drop(weight).withColumn("_salt", F.lit(0).cast("long")), [*on, "_salt"], "left")
    return joined.select(*left.columns, *[F.coalesce(f"_hot_{c}", c).alias(c) for c in names])
