import pytest

from swayrank.operators import prepare as prep
from swayrank.plans.prepare import prepare_email, prepare_promotion


def values(df, col):
    return [r[col] for r in df.orderBy("ID").collect()]


@pytest.fixture(scope="module")
def arms(spark):
    return spark.createDataFrame(
        [(0, "Yes", 1), (1, "yes", 0), (2, None, 1), (3, "No", 0)], "ID long, arm string, visit int")


def test_treatment_flags(arms):
    assert values(prep.binarize_treatment(arms, "arm", "Yes"), "treatment") == [1, 0, 0, 0]
    assert values(prep.map_treatment(arms, "arm", {"Yes": 1, "No": 0}), "treatment") == [1, None, None, 0]
    assert values(prep.exclude_arm(arms, "arm", "No"), "arm") == ["Yes", "yes", None]


def test_label_is_one_for_treated_response_and_untreated_silence(arms):
    flagged = prep.map_treatment(arms, "arm", {"Yes": 1, "No": 0})
    assert values(prep.class_transform_label(flagged), "label") == [1, 0, 0, 1]


def test_ordinal_bands(spark):
    bands = ["1) $0 - $100", "5) $750 - $1000", "6) $750 - $1,000", None]
    df = spark.createDataFrame(list(enumerate(bands)), "ID long, band string")
    assert values(prep.map_ordinal(df, "band"), "band") == [50, 825, 1000, 1000]


def test_one_hot_sorted_columns_and_null_rows(spark):
    df = spark.createDataFrame([(0, "b", "x"), (1, "a", None), (2, None, "x")], "ID long, c string, d string")
    coded = prep.one_hot(df, ["c", "d"])
    assert coded.columns == ["ID", "c_a", "c_b", "d_x"]
    assert [tuple(r) for r in coded.orderBy("ID").collect()] == [(0, 0, 1, 1), (1, 1, 0, 0), (2, 0, 0, 1)]
    with pytest.raises(ValueError, match="too many categories"):
        prep.category_values(df, ["c"], limit=1)


def test_ids_and_uniqueness(spark):
    df = spark.createDataFrame([("c", 3), ("a", 1), ("b", 2)], "k string, v int")
    assert [(r["k"], r["ID"]) for r in prep.assign_id(df, ["k"]).orderBy("ID").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    prep.check_unique_id(df, "k")
    with pytest.raises(ValueError, match="not unique"):
        prep.check_unique_id(df.unionByName(df), "k")


def test_feature_selection_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2.0, 3.0, "x")], "ID long, V1 double, V2 double, w string").write.parquet(path)
    picked = prep.select_features(spark.read.parquet(path), prefix="V")
    assert picked.columns == ["ID", "V1", "V2"]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "w:string" not in plan[plan.index("ReadSchema"):]


def test_relative_drop(spark):
    df = spark.createDataFrame([(0, 0.5, 0.25), (1, 0.0, 1.0)], "ID long, baseline_qini_coeff double, qini_coeff double")
    assert values(prep.relative_drop(df), "delta_qini") == [0.5, None]


def test_email_trial(spark):
    names = ["recency", "history_segment", "history", "zip_code", "channel", "segment", "visit"]
    rows = [(i % 12, "1) $0 - $100", float(i), "Rural" if i % 2 else "Urban", "Web",
             ("Womens E-Mail", "No E-Mail", "Mens E-Mail")[i % 3], i % 2) for i in range(60)]
    ready = prepare_email(spark.createDataFrame(rows, names), order_cols=["history"])
    assert ready.features == ["recency", "history_segment", "history", "zip_code_Rural", "zip_code_Urban", "channel_Web"]
    assert (ready.train.count(), ready.test.count()) == (28, 12)
    both = ready.train.unionByName(ready.test)
    assert sorted(r["ID"] for r in both.collect()) == list(range(40))
    assert {r["treatment"] for r in both.collect()} == {0, 1}


def test_promotion_trial(spark):
    df = spark.createDataFrame([(1, "Yes", 1, 2.0, 1.0), (2, "No", 1, 3.0, 2.0)],
                               "ID long, Promotion string, purchase int, V1 double, V2 double")
    ready = prepare_promotion(df, df)
    assert ready.features == ["V1", "V2"]
    assert values(ready.train, "label") == [1, 0]
    with pytest.raises(ValueError, match="not unique"):
        prepare_promotion(df.unionByName(df), df)
