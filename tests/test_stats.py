import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from swayrank.functions.student import t_critical, t_critical_value
from swayrank.operators import stats as sts

# Two-sided 95 % points from published tables of Student's t.
T_TABLE = {1: 12.7062047, 2: 4.3026527, 10: 2.2281389, 30: 2.0422725, 100: 1.9839715, 1000: 1.9623391}


def test_critical_values(spark):
    for df, t in T_TABLE.items():
        assert t_critical_value(df) == pytest.approx(t, abs=5e-8)
    assert t_critical_value(100) == pytest.approx(t_critical_value(101), rel=2e-4)
    rows = spark.createDataFrame([(d,) for d in [0, *T_TABLE]], "d long").select("d", t_critical(F.col("d")).alias("t"))
    got = {r["d"]: r["t"] for r in rows.collect()}
    assert got.pop(0) is None
    assert got == pytest.approx(T_TABLE, abs=5e-8)


def test_quantiles_equal_linear_interpolation(spark):
    draw = random.Random(1)
    data = {g: [draw.choice([5.0, draw.gauss(0, 10)]) for _ in range(n)] for g, n in (("a", 501), ("b", 7), ("c", 1))}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None)], "g string, v double")
    got = {r["g"]: r for r in sts.exact_quantiles(df, "v", {"p10": 0.1, "median": 0.5, "p80": 0.8}, by=["g"]).collect()}
    for g, vs in data.items():
        for name, q in (("p10", 10), ("median", 50), ("p80", 80)):
            assert got[g][name] == pytest.approx(np.percentile(vs, q), abs=1e-9)


def test_paired_interval_and_summary(spark):
    draw = random.Random(2)
    pairs = [(draw.random(), draw.random()) for _ in range(41)]
    df = spark.createDataFrame(pairs, "normalised_rank double, normalised_rank_modified double")
    d = [a - b for a, b in pairs]
    margin = t_critical_value(40) * statistics.stdev(d) / len(d) ** 0.5
    row = sts.summarise_participants(df).first()
    assert row["num_participants"] == 41
    assert row["median_normalised_rank"] == pytest.approx(statistics.median(a for a, _ in pairs))
    assert row["median_modified_normalised_rank"] == pytest.approx(statistics.median(b for _, b in pairs))
    assert (row["ci_low"], row["ci_high"]) == pytest.approx((statistics.mean(d) - margin, statistics.mean(d) + margin))
    assert (row["ci_low"] + row["ci_high"]) / 2 == pytest.approx(
        row["avg_normalised_rank"] - row["avg_modified_normalised_rank"])


def test_interval_of_one_pair_is_null(spark):
    row = sts.paired_t_interval(spark.createDataFrame([(0.5, 0.25)], "normalised_rank double, normalised_rank_modified double")).first()
    assert (row["n"], row["mean_diff"], row["ci_low"], row["ci_high"]) == (1, 0.25, None, None)


def test_histogram_equals_numpy(spark):
    draw = random.Random(3)
    values = [draw.choice([0.0, 1.0, draw.random()]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = sts.density_histogram(df, "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=50)
    assert [r["count"] for r in rows] == list(counts)
    assert [r["bin_start"] for r in rows] == pytest.approx(list(edges[:-1]))
    assert sum(r["density"] for r in rows) * (edges[1] - edges[0]) == pytest.approx(1.0)


def test_histogram_of_a_constant_and_of_nothing(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "v double")
    rows = {r["bin"]: r["count"] for r in sts.density_histogram(df, "v").collect()}
    assert rows[25] == 4 and sum(rows.values()) == 4 and len(rows) == 50
    assert sts.density_histogram(df.where("v > 5").withColumn("g", F.lit(1)), "v", by=["g"]).count() == 0


def test_categorical_features(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("few"), (F.col("id") % 11).alias("many"))
    got = {r["feature"]: (r["n_unique"], r["categorical"]) for r in sts.is_categorical(df, ["few", "many"]).collect()}
    assert got == {"few": (10, True), "many": (11, False)}


def test_position_histogram(spark):
    placed = spark.createDataFrame([(0,), (3,), (399,), (200,)], "position long")
    total = spark.createDataFrame([(400,)], "n long")
    rows = {r["bin"]: r["count"] for r in sts.position_histogram(placed, total).collect()}
    assert len(rows) == 200 and {b: c for b, c in rows.items() if c} == {0: 1, 1: 1, 199: 1, 100: 1}
