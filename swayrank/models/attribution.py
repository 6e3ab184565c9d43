"""Attributions: Shapley values of any model's margin by one distributed sampling job, expected gradients of the net.

Features enter in a few fixed random orders and their reverses. A row is scored with the first k
features of an order its own and the others from a background row; the change from k-1 to k is the
contribution of the k-th feature.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayrank.functions.joins import attach_one_row
from swayrank.session import share_package

MAX_BACKGROUND = 1000


def background_kmeans(df: DataFrame, features: Sequence[str], k: int = 100, seed: int = 42) -> DataFrame:
    """Cluster centres of the standardised features, in the features' own units."""
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(df.select(*features)).select("_v")
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(vectors)
    centres = KMeans(featuresCol="_s", k=k, seed=seed).fit(scaler.transform(vectors)).clusterCenters()
    rows = [[float(v) for v in centre * scaler.std + scaler.mean] for centre in centres]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"`{f}` double" for f in features))


def feature_orders(n_features: int, n_permutations: int, seed: int) -> list[list[int]]:
    """Random feature orders, each followed by its reverse."""
    draw = random.Random(seed)
    orders = []
    for _ in range(n_permutations):
        order = list(range(n_features))
        draw.shuffle(order)
        orders += [order, order[::-1]]
    return orders


def shapley_attributions(
    margin: Callable[[DataFrame], DataFrame], rows: DataFrame, background: DataFrame, features: Sequence[str],
    id_col: str = "ID", n_permutations: int = 4, seed: int = 42,
) -> DataFrame:
    """Long table (ID, feature, value, original, phi); the phi of a row sum to its margin less the background's mean.

    `margin` adds a column `margin`. The background must be small (a sample or cluster centres): it
    travels with every row as one array. All variants of a row are made and summed in its own task,
    so the final grouping combines them before the shuffle.
    """
    features, d = list(features), len(features)
    size = background.limit(MAX_BACKGROUND + 1).count()
    if not 0 < size <= MAX_BACKGROUND:
        raise ValueError(f"the background must have between 1 and {MAX_BACKGROUND} rows")
    pool = background.select(F.struct(*[F.col(c).cast("double").alias(c) for c in features]).alias("_b"))
    packed = pool.agg(F.collect_list("_b").alias("_pool"))
    orders = feature_orders(d, n_permutations, seed)
    steps = F.inline(F.array(*[
        F.struct(
            F.lit(k).alias("_k"),
            F.array(*[F.lit(order.index(j)) for j in range(d)]).alias("_at"),
            F.lit(order[k - 1] if k > 0 else None).cast("int").alias("_gains"),
            F.lit(order[k] if k < d else None).cast("int").alias("_loses"),
        )
        for order in orders for k in range(d + 1)
    ]))
    own = rows.select(id_col, F.array(*[F.col(c).cast("double") for c in features]).alias("_own"))
    variants = attach_one_row(own, packed).select(id_col, "_own", F.explode("_pool").alias("_b")).select("*", steps)
    mixed = variants.select(
        id_col, "_own", "_gains", "_loses",
        *[F.when(F.col("_at")[j] < F.col("_k"), F.col("_own")[j]).otherwise(F.col(f"_b.{c}")).alias(c)
          for j, c in enumerate(features)],
    )
    weight = 1.0 / (len(orders) * size)
    shares = F.inline(F.array(
        F.struct(F.col("_gains").alias("_j"), (F.col("margin") * weight).alias("_share")),
        F.struct(F.col("_loses").alias("_j"), (-F.col("margin") * weight).alias("_share")),
    ))
    parts = margin(mixed).select(id_col, "_own", shares).where("_j is not null")
    names = F.array(*[F.lit(c) for c in features])
    return (
        parts.groupBy(id_col, "_j")
        .agg(F.sum("_share").alias("phi"), F.max(F.get("_own", F.col("_j"))).alias("value"))
        .select(id_col, F.get(names, F.col("_j")).alias("feature"), "value", F.col("value").alias("original"), "phi")
    )


NODES = 12  # of the quadrature between a background row and the row that is explained


def margin_gradients(layers: Sequence[tuple[np.ndarray, np.ndarray]], inputs: np.ndarray) -> np.ndarray:
    """Gradients of the margin (second output less first) of a net with logistic hidden layers, one row per input."""
    outputs, x = [], inputs
    for weights, bias in layers[:-1]:
        x = 1 / (1 + np.exp(-(x @ weights.T + bias)))
        outputs.append(x)
    last = layers[-1][0]
    back = np.broadcast_to(last[1] - last[0], (len(inputs), last.shape[1]))
    for (weights, _), out in zip(layers[-2::-1], outputs[::-1]):
        back = (back * out * (1 - out)) @ weights
    return back


def expected_gradients(layers: Sequence, rows: np.ndarray, background: np.ndarray, nodes: int = NODES) -> np.ndarray:
    """Per row and feature: the mean over the background of the gradients along the straight line to the row, times its length.

    The integral is by Gauss-Legendre quadrature, whose error for so smooth a function is far below 1e-3 of the margin; up to
    it, a row's values add up to its margin less the background's mean.
    """
    points, weights = np.polynomial.legendre.leggauss(nodes)
    made = np.empty_like(rows)
    for i, row in enumerate(rows):
        gap = row - background
        total = np.zeros_like(gap)
        for at, weight in zip((points + 1) / 2, weights / 2):
            total += weight * margin_gradients(layers, background + at * gap)
        made[i] = (total * gap).mean(axis=0)
    return made


def net_attributions(model, rows: DataFrame, background: DataFrame, id_col: str = "ID") -> DataFrame:
    """Expected gradients of a net's margin for `rows`: long table (ID, feature, value, original, phi).

    `value` is as the net sees it (standardised), `original` in the feature's own unit. The background must be small; it and the
    net go to the tasks, which work on the rows they have.
    """
    features = list(model.features)
    scaling, layers = model.pipeline.stages[0], model.layers()
    scaled = scaling.transform(background.limit(MAX_BACKGROUND + 1)).select(vector_to_array(scaling.getOutputCol()).alias("v")).collect()
    if not 0 < len(scaled) <= MAX_BACKGROUND:
        raise ValueError(f"the background must have between 1 and {MAX_BACKGROUND} rows")
    share_package(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast((layers, np.array([r["v"] for r in scaled])))

    @F.pandas_udf("array<double>")
    def explained(v: pd.Series) -> pd.Series:
        return pd.Series(list(expected_gradients(held.value[0], np.stack(v.to_numpy()).astype(np.float64), held.value[1])))

    seen = scaling.transform(rows.select(id_col, *features)).withColumn("_v", vector_to_array(scaling.getOutputCol()))
    pairs = F.arrays_zip(
        F.array(*[F.lit(c) for c in features]).alias("feature"), F.col("_v").alias("value"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("original"), explained("_v").alias("phi"),
    )
    return seen.select(id_col, F.inline(pairs)).toDF(id_col, "feature", "value", "original", "phi")
