import hashlib

import pytest
from pyspark.sql import functions as F

from swayrank.operators import sampling as smp


def by_hash(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize(("n", "frac"), [(1000, 0.1), (1000, 0.29), (5, 0.1), (40, 1.0)])
def test_exact_share_by_hash_order(spark, n, frac):
    got = {r["ID"] for r in smp.sample_exact(spark.range(n).withColumnRenamed("id", "ID"), "ID", frac, 7).collect()}
    assert got == set(by_hash(range(n), 7)[: int(n * frac)])


def test_fixed_size_and_more_than_there_is(spark):
    df = spark.range(30).withColumnRenamed("id", "ID")
    assert {r["ID"] for r in smp.sample_k(df, "ID", 4, 3).collect()} == set(by_hash(range(30), 3)[:4])
    assert smp.sample_k(df, "ID", 100, 3).count() == 30
    assert [r["ID"] for r in smp.head_by(df, "ID", 3).collect()] == [0, 1, 2]


def test_stratified_split_has_exact_quotas_and_keeps_null_strata(spark):
    arms = ["a"] * 50 + ["b"] * 31 + [None] * 20
    df = spark.createDataFrame(list(enumerate(arms)), "ID long, arm string")
    rows = smp.stratified_split(df, "arm").collect()
    assert len(rows) == 101
    test = [r["arm"] for r in rows if r["side"] == "test"]
    assert len(test) == 31  # ceil(101 * 0.3)
    assert {a: test.count(a) for a in ("a", "b", None)} == {"a": 15, "b": 10, None: 6}


def test_seed_table_equals_seed_list(spark):
    rows = smp.seed_grid(spark, 50).orderBy("run_id").collect()
    assert [r["seed"] for r in rows] == smp.seed_list(50)
    assert all(0 <= s < 10000 for s in smp.seed_list(50))


def test_skewed_groups_draw_their_own_quota(spark):
    df = spark.range(900).select(F.col("id").alias("ID"), F.when(F.col("id") < 600, "hot").otherwise("cold").alias("g"))
    marked = smp.mark_sample(df, "ID", 1, smp.truncated_share(0.5), by=["g"])
    counts = {r["g"]: r["n"] for r in marked.where("in_sample").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert counts == {"hot": 300, "cold": 150}
