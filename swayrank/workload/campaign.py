"""The `campaign` view: a treatment/control trial read off the orders of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swayrank.operators.action import CollectiveAction
from swayrank.plans.experiment import Trial

TRIAL = Trial(dataset="campaign", model="formula")

DROPPED_ARM = "3-MEDIUM"

# The numbers that stand for the spending bands of the view.
BAND_VALUES = {"1) low": 50, "2) mid": 175}
BAND_DEFAULT = 1000

ARM_VALUES = {"1-URGENT": 1, "2-HIGH": 1, "5-LOW": 0}

ALL_ARMS = {"1-URGENT": 1, "2-HIGH": 1, "4-NOT SPECIFIED": 0, "5-LOW": 0}

FEATURES = ["recency", "history", "newbie"]

NEWBIE_ACTION = CollectiveAction({"newbie": "=0"}, [{"newbie": "=1"}], 0.05)
RECENCY_ACTION = CollectiveAction({"recency": ">40"}, [{"recency": "-24"}, {"newbie": "=1"}], 0.1)
HISTORY_ACTION = CollectiveAction({"history": ">250000"}, [{"history": "-200000"}], 0.1)


def orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's segment and region; the two tiny tables are broadcast by size."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    homes = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    people = customer.join(homes, customer.c_nationkey == homes.n_nationkey)
    return orders.join(people, orders.o_custkey == people.c_custkey)


def trial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, all arms."""
    date, price = F.col("o_orderdate"), F.col("o_totalprice")
    months = (F.lit(2001) - F.year(date)) * 12 + 8 - F.month(date)
    band = F.when(price < 100000, "1) low").when(price < 250000, "2) mid").otherwise("3) high")
    return orders_with_customer(spark, sf_dir).select(
        F.col("o_orderkey").alias("ID"),
        F.col("o_orderpriority").alias("segment"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("treatment"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("visit"),
        months.cast("int").alias("recency"),
        price.alias("history"),
        band.alias("history_segment"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("newbie"),
        F.col("c_mktsegment").alias("channel"),
        F.col("r_name").alias("zip_code"),
    )


def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial without its dropped arm; the filter reaches the scan of the orders."""
    return trial_rows(spark, sf_dir).where(F.col("segment") != DROPPED_ARM)


def formula_score(df: DataFrame) -> DataFrame:
    """A whole-number score that stands in for a model where SQL has to reproduce it."""
    steps = F.floor(F.col("history").cast("double") / 5000) * 10
    return df.withColumn("uplift", (steps - F.col("recency") + F.col("newbie") * 50).cast("double"))


def scored_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ranking and action queries need of the campaign, with the formula score."""
    slim = campaign(spark, sf_dir).select("ID", "treatment", "visit", *FEATURES)
    return formula_score(slim)


# ---- the same in SQL, for the comparison with DuckDB ----

TRIAL_SQL = """
trial AS (
  SELECT o.o_orderkey AS ID, o.o_orderpriority AS segment,
    CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS treatment,
    CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS visit,
    CAST((2001 - year(o.o_orderdate)) * 12 + 8 - month(o.o_orderdate) AS INT) AS recency,
    o.o_totalprice AS history,
    CASE WHEN o.o_totalprice < 100000 THEN '1) low' WHEN o.o_totalprice < 250000 THEN '2) mid'
         ELSE '3) high' END AS history_segment,
    CASE WHEN c.c_acctbal < 0 THEN 1 ELSE 0 END AS newbie,
    c.c_mktsegment AS channel, r.r_name AS zip_code
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
),
campaign AS (SELECT * FROM trial WHERE segment <> '3-MEDIUM')"""


def score_sql(history: str = "history", recency: str = "recency", newbie: str = "newbie") -> str:
    return f"CAST(floor(CAST({history} AS DOUBLE) / 5000) * 10 - {recency} + {newbie} * 50 AS DOUBLE)"


SCORED_SQL = f"""{TRIAL_SQL},
scored AS (SELECT ID, treatment, visit, recency, history, newbie, {score_sql()} AS uplift FROM campaign)"""
