"""Preparation kept with the model, and the net's attributions."""

import numpy as np
import pytest
from helpers import planted_trial
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from swayrank.models import store
from swayrank.models.attribution import expected_gradients, margin_gradients, net_attributions
from swayrank.models.class_transform import NeuralNetConfig
from swayrank.models.transformers import CampaignEncoder, Standardise
from swayrank.operators.prepare import class_transform_label, map_ordinal, one_hot

FEATURES = [f"x{k}" for k in range(1, 6)]


def test_scaling_is_by_the_population_deviation(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0), (None, 5.0)], "a double, b double")
    stage = Standardise.fit(df, ["a", "b"], "v")
    assert stage.getOrDefault("means") == [3.0, 5.0]
    assert stage.getOrDefault("deviations") == pytest.approx([np.std([1, 2, 6]), 0.0])
    PipelineModel([stage]).write().overwrite().save(str(tmp_path / "s"))
    again = PipelineModel.load(str(tmp_path / "s"))
    found = [r["v"] for r in again.transform(df).orderBy("a").select(vector_to_array("v").alias("v")).collect()]
    assert np.isnan(found[0][0]) and found[0][1] == 0.0
    assert [v[0] for v in found[1:]] == pytest.approx((np.array([1, 2, 6]) - 3) / np.std([1, 2, 6]))


def test_a_table_with_unseen_values_scores_alike_after_reload(spark, tmp_path):
    base = class_transform_label(planted_trial(spark, 2000)).withColumn("zone", F.when(F.col("x1") > 0.5, "n").otherwise("s"))
    base = base.withColumn("band", F.when(F.col("x2") > 0.3, "hi").otherwise("lo"))
    encoder = CampaignEncoder.fit(base, ["zone"], "band", {"lo": 1, "hi": 2}, 9)
    train = encoder.transform(base)
    assert sorted(train.drop("ID").columns) == sorted(one_hot(map_ordinal(base, "band", {"lo": 1, "hi": 2}, 9), ["zone"]).drop("ID").columns)
    features = [*FEATURES, "band", "zone_n", "zone_s"]
    model = store.fit_model("mlp", train, features, NeuralNetConfig(hidden=(4,), max_iter=15))
    store.save_model(model, str(tmp_path / "m"), spark.createDataFrame([], "feature string"), preparation=PipelineModel([encoder]))
    new = base.limit(50).withColumn("zone", F.when(F.col("ID") % 2 == 0, "unheard of").otherwise(F.col("zone")))
    new = new.withColumn("band", F.when(F.col("ID") % 3 == 0, "other").otherwise(F.col("band")))
    before = {r.ID: r.uplift for r in model.score(encoder.transform(new)).collect()}
    prepared = store.load_preparation(str(tmp_path / "m")).transform(new)
    after = {r.ID: r.uplift for r in store.load_model(spark, str(tmp_path / "m")).score(prepared).collect()}
    assert after == before and len(after) == 50
    row = prepared.where("ID % 6 = 0").first()
    assert (row["zone_n"], row["zone_s"], row["band"]) == (0, 0, 9)


def test_gradients_are_those_of_small_steps():
    rng = np.random.default_rng(0)
    layers = [(rng.standard_normal((6, 4)), rng.standard_normal(6)), (rng.standard_normal((3, 6)), rng.standard_normal(3)), (rng.standard_normal((2, 3)), rng.standard_normal(2))]

    def margin(x):
        for weights, bias in layers[:-1]:
            x = 1 / (1 + np.exp(-(x @ weights.T + bias)))
        z = x @ layers[-1][0].T + layers[-1][1]
        return z[:, 1] - z[:, 0]

    x = rng.standard_normal((5, 4))
    step = 1e-6
    numeric = np.stack([(margin(x + step * e) - margin(x - step * e)) / (2 * step) for e in np.eye(4)], axis=1)
    assert margin_gradients(layers, x) == pytest.approx(numeric, abs=1e-7)
    background = rng.standard_normal((7, 4))
    phi = expected_gradients(layers, x, background)
    assert phi.sum(axis=1) == pytest.approx(margin(x) - margin(background).mean(), abs=1e-6)
    # The same by a plain sum over a fine grid.
    grid = (np.arange(2000) + 0.5) / 2000
    plain = np.mean([np.mean([margin_gradients(layers, (b + a * (x[:1] - b)))[0] for a in grid], axis=0) * (x[0] - b) for b in background], axis=0)
    assert phi[0] == pytest.approx(plain, abs=1e-4)


def test_a_nets_attributions_add_up_to_its_margin(spark):
    df = class_transform_label(planted_trial(spark, 2000)).cache()
    model = store.fit_model("mlp", df, FEATURES, NeuralNetConfig(hidden=(8, 4), max_iter=25))
    rows, background = df.limit(30), df.where("ID % 97 = 0").select(*FEATURES)
    long = net_attributions(model, rows, background).collect()
    assert len(long) == 30 * 5
    base = model.margin(background).agg(F.avg("margin")).first()[0]
    total = {}
    for r in long:
        total[r.ID] = total.get(r.ID, 0.0) + r.phi
    for r in model.margin(rows).collect():
        assert total[r.ID] == pytest.approx(r.margin - base, abs=1e-3)
    x1 = {r.ID: r.x1 for r in rows.collect()}
    assert all(r.original == x1[r.ID] for r in long if r.feature == "x1")
