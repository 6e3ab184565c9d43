import numpy as np
import pytest
from helpers import planted_trial
from pyspark.sql import functions as F

from swayrank.models import store
from swayrank.models.attribution import background_kmeans, feature_orders, shapley_attributions
from swayrank.models.boosting import BoostedTreesConfig
from swayrank.models.class_transform import NeuralNetConfig
from swayrank.models.forest import ForestConfig, fit_uplift_forest, with_bins
from swayrank.models.histograms import bin_edges
from swayrank.operators.action import CollectiveAction, Run
from swayrank.operators.prepare import class_transform_label
from swayrank.operators.ranking import qini_auc
from swayrank.operators.report import feature_report
from swayrank.plans import experiment as exp
from swayrank.plans.refit import fixed_score, refitted
from swayrank.plans.train import ExplainConfig, train_and_explain

FEATURES = [f"x{k}" for k in range(1, 6)]
CONFIGS = {
    "lgbm": BoostedTreesConfig(n_estimators=5, learning_rate=0.3, max_depth=3),
    "mlp": NeuralNetConfig(hidden=(8,), max_iter=25),
    "uplift_rf": ForestConfig(n_estimators=4, max_depth=3, n_bins=16),
}


@pytest.fixture(scope="module")
def sides(spark):
    df = class_transform_label(planted_trial(spark)).cache()
    return df.where("ID % 3 > 0"), df.where("ID % 3 = 0")


@pytest.fixture(scope="module")
def forest(sides):
    return store.fit_model("uplift_rf", sides[0], FEATURES, CONFIGS["uplift_rf"])


def test_forest_finds_the_planted_feature(spark, sides, forest):
    shares = {r["feature"]: r["importance"] for r in forest.feature_importances(spark).collect()}
    assert max(shares, key=shares.get) == "x1" and sum(shares.values()) == pytest.approx(1.0)
    for tree in forest.trees[()]:
        assert tree.feature[0] == 0  # every root splits on x1
        assert forest.edges[0][tree.cut[0] - 1] == pytest.approx(0.5, abs=0.08)
    scored = forest.score(sides[1])
    assert qini_auc(scored).first()["qini_coeff"] > 0.2
    means = scored.groupBy((F.col("x1") > 0.5).alias("up")).agg(F.avg("uplift").alias("u")).collect()
    assert {r["up"]: round(r["u"], 1) for r in means} == {True: 0.5, False: 0.0}


def test_forest_counts_match_a_recount_of_the_root(sides):
    """Without bootstrap noise in play: the root's response rates are those of the weighted rows."""
    train = sides[0]
    config = ForestConfig(n_estimators=2, max_depth=1, n_bins=8)
    model = fit_uplift_forest(train, FEATURES, config)
    from swayrank.models.forest import bootstrap_weight

    for k, tree in enumerate(model.trees[()]):
        w = bootstrap_weight(F.lit(k), "ID", config.random_state)
        t, y = F.col("treatment"), F.col("visit")
        p, q = train.select(w.alias("w"), "treatment", "visit").agg(
            F.sum(F.col("w") * t * y) / F.sum(F.col("w") * t),
            F.sum(F.col("w") * (1 - t) * y) / F.sum(F.col("w") * (1 - t)),
        ).first()
        assert (tree.treated_rate[0], tree.control_rate[0]) == (pytest.approx(p), pytest.approx(q))


def test_bootstrap_weights_have_mean_and_variance_one(spark):
    from swayrank.models.forest import bootstrap_weight

    rows = spark.range(50000).withColumnRenamed("id", "ID").select(bootstrap_weight(F.lit(3), "ID", 42).alias("w"))
    mean, var = rows.agg(F.avg("w"), F.var_samp("w")).first()
    assert mean == pytest.approx(1.0, abs=0.02) and var == pytest.approx(1.0, abs=0.04)


def test_weights_drawn_in_tasks_are_those_of_the_columns(spark):
    from swayrank.models.forest import POISSON_ONE, bootstrap_draw, bootstrap_weight, drawn_weights

    rows = spark.range(20000).withColumnRenamed("id", "ID")
    found = rows.select(bootstrap_draw(F.lit(3), "ID", 42).alias("d"), bootstrap_weight(F.lit(3), "ID", 42).alias("w")).toPandas()
    assert drawn_weights(found["d"].to_numpy()).tolist() == found["w"].tolist()
    assert drawn_weights(np.array([0.0, *POISSON_ONE, 1.0])).tolist() == [0, 1, 2, 3, 4, 5, 6, 7, 8, 8]


def test_known_candidates_are_not_looked_for_again():
    from swayrank.plans.refit import candidate_edges

    known = [[1.0, 4.0], [2.0]]
    action = CollectiveAction({"a": ">1"}, [{"a": "=3"}, {"b": "+1"}], 0.1)
    assert candidate_edges(None, action, ["a", "b"], 8, known) == [[1.0, 3.0, 4.0], [2.0]]
    assert known == [[1.0, 4.0], [2.0]]


def test_bins_put_values_and_nulls_where_the_cuts_say(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (5.0, 7.0), (None, 7.0)], "a double, b double")
    edges = bin_edges(df, ["a", "b"], 4)
    assert edges == [[2.0, 5.0], []]
    assert sorted(r["_bins"] for r in with_bins(df, ["a", "b"], edges).collect()) == [[0, 0], [1, 0], [2, 0], [3, 0]]


def test_forests_of_several_runs_equal_single_fits(spark, sides):
    train, test = sides
    flipped = train.withColumn("visit", F.when(F.col("x2") > 0.5, F.col("treatment")).otherwise(F.col("visit")))
    both = train.withColumn("run_id", F.lit(0)).unionByName(flipped.withColumn("run_id", F.lit(1)))
    keyed = fit_uplift_forest(both, FEATURES, CONFIGS["uplift_rf"], by=["run_id"])
    single = fit_uplift_forest(train, FEATURES, CONFIGS["uplift_rf"])
    assert set(keyed.trees) == {(0,), (1,)}
    assert keyed.trees[(0,)][0].feature[0] == single.trees[()][0].feature[0] == 0
    assert keyed.trees[(1,)][0].feature[0] == 1
    scored = keyed.score(test.withColumn("run_id", F.lit(1)))
    assert scored.count() == test.count()


@pytest.mark.parametrize("name", ["lgbm", "mlp"])
def test_class_transformation_ranks_and_survives_storage(spark, sides, name, tmp_path):
    model = store.fit_model(name, sides[0], FEATURES, CONFIGS[name])
    scored = model.score(sides[1])
    assert scored.columns == [*sides[1].columns, "uplift"]
    assert scored.agg(F.max(F.abs("uplift"))).first()[0] <= 1
    assert qini_auc(scored).first()["qini_coeff"] > 0.15
    odds = model.margin(scored.drop("uplift")).select("ID", "margin").join(scored, "ID")
    gap = odds.agg(F.max(F.abs(2 / (1 + F.exp(-F.col("margin"))) - 1 - F.col("uplift")))).first()[0]
    assert gap < 1e-9
    report = spark.createDataFrame([], "feature string")
    paths = store.save_model(model, str(tmp_path / name), report)
    assert set(paths) == {"model_path", "features_path", "report_path"}
    again = store.load_model(spark, str(tmp_path / name)).score(sides[1])
    assert sorted(again.select("ID", "uplift").collect()) == sorted(scored.select("ID", "uplift").collect())


def test_stored_forest_and_missing_models(spark, sides, forest, tmp_path):
    store.save_model(forest, str(tmp_path / "f"), spark.createDataFrame([], "feature string"))
    folders = {"uplift_rf": str(tmp_path / "f"), "mlp": str(tmp_path / "absent")}
    scored = store.score_saved_models(spark, folders, sides[1])
    assert {r["model"] for r in scored.select("model").distinct().collect()} == {"uplift_rf"}
    want = forest.score(sides[1]).select("ID", "uplift")
    assert sorted(scored.select("ID", "uplift").collect()) == sorted(want.collect())
    curves, qini = exp.compare_models(scored, exp.Trial("planted", "all"))
    assert curves.count() == 201 and qini.count() == 1
    with pytest.raises(FileNotFoundError):
        store.score_saved_models(spark, {"mlp": str(tmp_path / "absent")}, sides[1])


def test_unknown_model(sides):
    with pytest.raises(ValueError, match="unknown model"):
        store.fit_model("svm", sides[0], FEATURES)
    with pytest.raises(ValueError, match="unknown model"):
        refitted("svm", sides[0], FEATURES)


def test_attributions_add_up_and_are_exact_for_linear_margins(spark, sides, forest):
    rows = sides[1].limit(40).cache()
    background = sides[0].limit(6).select(*FEATURES).cache()
    long = shapley_attributions(forest.margin, rows, background, FEATURES, n_permutations=2)
    base = forest.margin(background).agg(F.avg("margin")).first()[0]
    total = long.groupBy("ID").agg(F.sum("phi").alias("s")).join(forest.margin(rows), "ID")
    assert total.agg(F.max(F.abs(F.col("margin") - base - F.col("s")))).first()[0] < 1e-9

    def linear(df):
        return df.withColumn("margin", 3 * F.col("x1") - 2 * F.col("x2"))

    centre = background.agg(F.avg("x1"), F.avg("x2")).first()
    got = shapley_attributions(linear, rows, background, FEATURES, n_permutations=1)
    want = {"x1": 3 * (F.col("value") - centre[0]), "x2": -2 * (F.col("value") - centre[1])}
    for name in FEATURES:
        gap = got.where(F.col("feature") == name).agg(F.max(F.abs(F.col("phi") - want.get(name, F.lit(0.0))))).first()[0]
        assert gap < 1e-9
    assert got.count() == 40 * 5


def test_feature_orders_come_with_their_reverse():
    orders = feature_orders(4, 2, 1)
    assert len(orders) == 4 and orders[1] == orders[0][::-1] and sorted(orders[2]) == [0, 1, 2, 3]


def test_background_centres_lie_in_the_data_range(sides):
    centres = background_kmeans(sides[0], FEATURES, 5, 1)
    assert centres.count() == 5 and centres.columns == FEATURES
    low, high = centres.agg(F.min("x1"), F.max("x1")).first()
    assert 0 < low < high < 1


def test_train_and_explain_reports_the_planted_direction(spark, sides, tmp_path):
    trained = train_and_explain(
        "uplift_rf", *sides, FEATURES, exp.Trial("planted", "uplift_rf"), CONFIGS["uplift_rf"],
        ExplainConfig(forest_rows=60, background=5, n_permutations=1), folder=str(tmp_path / "m"))
    top = trained.report.orderBy(F.desc("importance")).first()
    assert (top["feature"], top["direction"]) == ("x1", "Positive")
    assert top["proposed_strategy"].startswith("Increase x1 by")
    assert trained.curve.count() == 201 and trained.qini.first()[0] > 0.2
    assert spark.read.parquet(str(tmp_path / "m" / "report")).count() == 5
    assert feature_report(trained.attributions).count() == 5


ACTION = CollectiveAction({"x1": "<0.4"}, [{"x1": "=0.9"}], 0.1)


@pytest.mark.parametrize("name", ["uplift_rf", "lgbm"])
def test_participants_move_up_after_a_refit(sides, name):
    train, test = sides
    trial = exp.Trial("planted", name)
    model = store.fit_model(name, train, FEATURES, CONFIGS[name])
    scored = model.score(test.select("ID", "treatment", "visit", *FEATURES))
    runs = [Run(0, 11, 0.1), Run(1, 12, 0.1)]
    rows = exp.run_grid(scored, ACTION, runs, refitted(name, train, FEATURES, CONFIGS[name]), trial).collect()
    eligible = test.where("x1 < 0.4").count()
    baseline = qini_auc(scored).first()["qini_coeff"]
    assert len(rows) == 2
    for r in rows:
        assert (r["model"], r["target_feature"], r["num_participants"]) == (name, "x1", int(eligible * 0.1))
        assert r["avg_normalised_rank"] > r["avg_modified_normalised_rank"] and r["ci_low"] > 0
        assert r["baseline_qini_coeff"] == pytest.approx(baseline)
        assert r["qini_coeff"] is not None  # may rise or fall: forests are known to gain a little


def test_run_without_participants_is_kept(sides, forest):
    test = sides[1].limit(60)
    scored = forest.score(test.select("ID", "treatment", "visit", *FEATURES))
    rows = exp.run_grid(scored, ACTION, [Run(0, 1, 0.001), Run(1, 1, 0.5)], fixed_score(forest.score),
                        exp.Trial("planted", "uplift_rf")).orderBy("run_id").collect()
    assert [r["num_participants"] > 0 for r in rows] == [False, True]
    assert rows[0]["ci_low"] is None and rows[0]["qini_coeff"] == pytest.approx(rows[0]["baseline_qini_coeff"])
