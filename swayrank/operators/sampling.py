"""Exact-size, repeatable samples by hash order.

The k rows with the smallest md5 of "seed:ID" form the sample. The k-th smallest hash is found from
counts per hash prefix plus one prefix's rows, so nothing is sorted globally; membership is then a
comparison with that one cutoff per group and needs no join on IDs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swayrank.functions.joins import join_groups

HASH = "_hash"
PREFIX_DIGITS = 3  # 4,096 prefixes: the one sorted slice of a group holds about n / 4,096 rows
SEED_RANGE = 10_000


def seeded_hash(seed: Column | int, id_col: str) -> Column:
    """md5 of "seed:ID" as a hex string; its order is the random order of a seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), F.col(id_col).cast("string")))


def hash_cutoffs(
    rows: DataFrame, by: Sequence[str], quota: Callable[[Column], Column], carry: Sequence[str] = (),
    few_groups: bool = False, shared: Sequence[str] = (), unfold: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Per group the hash (`cutoff`) of the k-th smallest `_hash`; no row where k is 0.

    `quota` turns the group size into k. `carry` names columns that are constant within a group and
    that `quota` refers to. `few_groups` says that the caller has checked the number of groups: the
    one row per group is then broadcast, whatever size Spark expects the (unfolded) rows to have. Where several groups have the
    same rows, `rows` has them once, keyed by `shared`, and `unfold` repeats counts by `shared` for each of the groups.
    """
    by, groups, own = list(by), [*by, *carry, *shared], list(shared or by)
    prefix = F.substring(HASH, 1, PREFIX_DIGITS).alias("_prefix")
    counts = rows.groupBy(*(shared or groups), prefix).agg(F.count("*").alias("_in"))
    counts = unfold(counts) if unfold else counts
    upto = Window.partitionBy(*by).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = counts.select(
        *groups,
        "_prefix",
        "_in",
        F.sum("_in").over(upto).alias("_upto"),
        F.sum("_in").over(Window.partitionBy(*by)).alias("_n"),
    )
    k = F.least(quota(F.col("_n")).cast("long"), F.col("_n"))
    below = F.col("_upto") - F.col("_in")
    edge = slices.where((below < k) & (k <= F.col("_upto"))).select(*by, *shared, "_prefix", (k - below).alias("_nth"))
    edge = F.broadcast(edge) if few_groups else edge
    candidates = join_groups(rows.select(*own, HASH, prefix), edge, [*own, "_prefix"])
    place = F.row_number().over(Window.partitionBy(*by, "_prefix").orderBy(HASH))
    return (
        candidates.withColumn("_place", place)
        .where(F.col("_place") == F.col("_nth"))
        .select(*by, F.col(HASH).alias("cutoff"))
    )


def mark_sample(
    df: DataFrame, id_col: str, seed: int, quota: Callable[[Column], Column], by: Sequence[str] = (),
    out: str = "in_sample",
) -> DataFrame:
    """Add a boolean telling whether a row is among its group's k rows in hash order."""
    hashed = df.withColumn(HASH, seeded_hash(seed, id_col))
    cutoffs = hash_cutoffs(hashed.select(*by, HASH), by, quota)
    joined = join_groups(hashed, cutoffs, by, "left")
    chosen = F.coalesce(F.col(HASH) <= F.col("cutoff"), F.lit(False))
    return joined.withColumn(out, chosen).drop(HASH, "cutoff")


def truncated_share(frac: Column | float) -> Callable[[Column], Column]:
    """k = int(n * frac), truncating in double arithmetic."""
    frac = frac if isinstance(frac, Column) else F.lit(float(frac))
    return lambda n: F.floor(n.cast("double") * frac)


def sample_exact(df: DataFrame, id_col: str, frac: float, seed: int) -> DataFrame:
    """Exactly int(n * frac) rows without replacement."""
    marked = mark_sample(df, id_col, seed, truncated_share(frac))
    return marked.where("in_sample").drop("in_sample")


def sample_k(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """Exactly min(k, n) rows without replacement."""
    marked = mark_sample(df, id_col, seed, lambda n: F.lit(k))
    return marked.where("in_sample").drop("in_sample")


def head_by(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows with the smallest IDs (a top-n, for small n)."""
    return df.orderBy(id_col).limit(n)


def stratum_quotas(df: DataFrame, strata: str, frac: float) -> DataFrame:
    """Test rows per stratum: ceil(n * frac) in total, shared by largest remainder.

    The window runs over one row per stratum (treatment arms), not over the data.
    """
    sizes = df.groupBy(strata).agg(F.count("*").alias("_size"))
    n = F.sum("_size").over(Window.partitionBy(F.lit(1)))
    wanted = F.ceil(n * F.lit(float(frac)))
    shared = sizes.select(strata, "_size", n.alias("_n"), wanted.alias("_wanted")).withColumn(
        "_exact", F.col("_size") * F.col("_wanted") / F.col("_n").cast("double")
    ).withColumn("_floor", F.floor("_exact"))
    by_rest = Window.partitionBy(F.lit(1)).orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col(strata))
    missing = F.col("_wanted") - F.sum("_floor").over(Window.partitionBy(F.lit(1)))
    extra = F.when(F.row_number().over(by_rest) <= missing, 1).otherwise(0)
    return shared.select(strata, (F.col("_floor") + extra).cast("long").alias("_quota"))


def stratified_split(df: DataFrame, strata: str, id_col: str = "ID", frac: float = 0.3, seed: int = 42) -> DataFrame:
    """Add `side` = "test" for an exact share of every stratum, "train" for the rest."""
    hashed = df.withColumn(HASH, seeded_hash(seed, id_col))
    quotas = stratum_quotas(df, strata, frac)
    rows = join_groups(hashed.select(strata, HASH), quotas, [strata])
    cutoffs = hash_cutoffs(rows, [strata], lambda n: F.col("_quota"), carry=["_quota"])
    joined = join_groups(hashed, cutoffs, [strata], "left")
    side = F.when(F.col(HASH) <= F.col("cutoff"), "test").otherwise("train")
    return joined.withColumn("side", side).drop(HASH, "cutoff")


def seed_list(n: int, master: int = 42) -> list[int]:
    """`n` seeds in [0, 10000) from a master seed; seeds may repeat, so runs are keyed by index."""
    digests = (hashlib.md5(f"{master}:{i}".encode()).hexdigest() for i in range(n))
    return [int(d[:8], 16) % SEED_RANGE for d in digests]


def seed_grid(spark: SparkSession, n: int, master: int = 42) -> DataFrame:
    """The same seeds as `seed_list`, as a table (run_id, seed)."""
    digest = F.md5(F.concat(F.lit(f"{master}:"), F.col("run_id").cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    runs = spark.range(n).select(F.col("id").cast("int").alias("run_id"))
    return runs.withColumn("seed", (number % SEED_RANGE).cast("int"))
