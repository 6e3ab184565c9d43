"""Queries over the test tables, one per operator. Doubles are rounded to six places for comparison."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from swayrank.functions.joins import attach_one_row
from swayrank.models import store
from swayrank.models.attribution import background_kmeans as kmeans_centres
from swayrank.models.attribution import shapley_attributions as shapley
from swayrank.models.boosting import BoostedTreesConfig
from swayrank.models.class_transform import NeuralNetConfig
from swayrank.models.forest import ForestConfig
from swayrank.operators import action as act
from swayrank.operators import prepare as prep
from swayrank.operators import ranking as rank
from swayrank.operators import report as rep
from swayrank.operators import sampling as smp
from swayrank.operators import sketches as skt
from swayrank.operators import stats as sts
from swayrank.plans import experiment as exp
from swayrank.plans.prepare import Prepared, prepare_email
from swayrank.plans.refit import fixed_score, refitted
from swayrank.plans.resume import finished_results, run_grid_into
from swayrank.plans.train import ExplainConfig, explain, train_and_explain
from swayrank.session import freeze, shared_folder
from swayrank.sources import tables as src
from swayrank.sources.checked import read_checked
from swayrank.workload.campaign import (
    ALL_ARMS,
    ARM_VALUES,
    BAND_DEFAULT,
    BAND_VALUES,
    DROPPED_ARM,
    FEATURES,
    HISTORY_ACTION,
    NEWBIE_ACTION,
    RECENCY_ACTION,
    TRIAL,
    campaign,
    formula_score,
    scored_campaign,
    trial_rows,
)

Query = Callable[[SparkSession, str], DataFrame]

GRID_RUNS = act.run_grid_keys((0.02, 0.05, 0.1), smp.seed_list(10))
SMALL_RUNS = act.run_grid_keys((0.05, 0.1), smp.seed_list(4))
ATTRIBUTED = [*FEATURES, "treatment"]
CAMPAIGN_REST = ["recency", "history", "history_segment", "newbie", "channel", "zip_code"]

FORMULA = fixed_score(formula_score)

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame) -> DataFrame:
    """Six places for doubles; adding 0.0 turns -0.0 into 0.0."""
    def column(field) -> Column:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (DoubleType, FloatType)):
            return (F.round(col, 6) + F.lit(0.0)).alias(field.name)
        return col

    return df.select(*[column(f) for f in df.schema])


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"


# ---- sources and sinks ----

@query
def load_campaign(spark, sf_dir):
    """Features, target and treatment read from tables of their own and put side by side."""
    rows, parts = campaign(spark, sf_dir), {"features": ["segment", *CAMPAIGN_REST], "target": ["visit"], "arms": ["treatment"]}
    paths = [src.write_table(rows.select("ID", *columns), scratch(spark, name)) for name, columns in parts.items()]
    return rounded(src.load_campaign(spark, paths[0], None, *paths[1:]).select(rows.columns))


@query
def join_on_id(spark, sf_dir):
    rows = campaign(spark, sf_dir)
    features = rows.select("ID", *FEATURES)
    return rounded(src.join_on_id(features, rows.select("ID", "visit"), rows.select("ID", "segment")))


@query
def write_read_table(spark, sf_dir):
    path = src.write_table(campaign(spark, sf_dir).select("ID", "segment", *FEATURES), scratch(spark, "campaign.csv"))
    columns = [f for f in campaign(spark, sf_dir).schema if f.name in ("ID", "segment", *FEATURES)]
    return rounded(src.read_table(spark, path, src.StructType(columns)))


@query
def read_results(spark, sf_dir):
    path = src.write_results(small_grid(spark, sf_dir).drop("run_id"), scratch(spark, "results"))
    return rounded(src.read_results(spark, path).select(*[f.name for f in src.RESULT_SCHEMA]))


@query
def resume_grid(spark, sf_dir):
    """A grid that is finished in two goes, beside the results of another model: rows of all three come back."""
    folder, scored = scratch(spark, "kept"), scored_campaign(spark, sf_dir)
    other, baseline = exp.Trial(dataset="campaign", model="other"), exp.ranked_cells(scored, TRIAL)
    run_grid_into(folder, scored, HISTORY_ACTION, SMALL_RUNS[:1], FORMULA, other, baseline=baseline)
    run_grid_into(folder, scored, HISTORY_ACTION, SMALL_RUNS[:3], FORMULA, TRIAL, baseline=baseline)
    run_grid_into(folder, scored, HISTORY_ACTION, SMALL_RUNS, FORMULA, TRIAL, batch_runs=3, baseline=baseline)
    return rounded(finished_results(spark, folder))


# ---- preparation ----

@query
def binarize_treatment(spark, sf_dir):
    return prep.binarize_treatment(trial_rows(spark, sf_dir).select("ID", "segment"), "segment", "1-URGENT")


@query
def map_treatment(spark, sf_dir):
    return prep.map_treatment(trial_rows(spark, sf_dir).select("ID", "segment"), "segment", ARM_VALUES)


@query
def class_label(spark, sf_dir):
    return prep.class_transform_label(campaign(spark, sf_dir).select("ID", "treatment", "visit"))


@query
def exclude_arm(spark, sf_dir):
    return prep.exclude_arm(trial_rows(spark, sf_dir).select("ID", "segment"), "segment", DROPPED_ARM)


@query
def map_ordinal(spark, sf_dir):
    rows = campaign(spark, sf_dir).select("ID", "history_segment")
    return prep.map_ordinal(rows, "history_segment", BAND_VALUES, BAND_DEFAULT)


@query
def one_hot(spark, sf_dir):
    return prep.one_hot(campaign(spark, sf_dir).select("ID", "channel", "zip_code"), ["zip_code", "channel"])


@query
def assign_id(spark, sf_dir):
    rows = campaign(spark, sf_dir).select(F.col("ID").alias("order_id"), "recency")
    return prep.assign_id(rows, ["recency", "order_id"])


@query
def select_features(spark, sf_dir):
    return rounded(prep.select_features(campaign(spark, sf_dir), exclude=["segment", "visit", "treatment"]))


@query
def select_features_by_prefix(spark, sf_dir):
    return rounded(prep.select_features(campaign(spark, sf_dir), prefix="h"))


@query
def relative_drop(spark, sf_dir):
    rows = campaign(spark, sf_dir).select("ID", "history", F.col("recency").cast("double").alias("recency"))
    return rounded(prep.relative_drop(rows, "history", "recency"))


# ---- actions without sampling ----

def _changed_by(spark, sf_dir, action):
    rows = campaign(spark, sf_dir).where(act.eligible(action)).select("ID", *action.attack_features)
    return rounded(act.apply_attacks(rows.withColumn("aca_flag", F.lit(1)), action).drop("aca_flag"))


@query
def eligible(spark, sf_dir):
    rows = campaign(spark, sf_dir)
    rules = {"newbie_0": NEWBIE_ACTION, "recency_gt": RECENCY_ACTION, "recency_lt": act.CollectiveAction(
        {"recency": "<2"}, [{"recency": "+9"}], 0.1)}
    return rows.select("ID", *[act.eligible(rule).cast("int").alias(name) for name, rule in rules.items()])


@query
def attack_set(spark, sf_dir):
    return _changed_by(spark, sf_dir, NEWBIE_ACTION)


@query
def attack_add(spark, sf_dir):
    return _changed_by(spark, sf_dir, act.CollectiveAction({"recency": "<2"}, [{"recency": "+9"}], 0.1))


@query
def attack_sub_floor(spark, sf_dir):
    return _changed_by(spark, sf_dir, act.CollectiveAction({"recency": ">40"}, [{"recency": "-60"}], 0.1))


# ---- sampling ----

@query
def sample_exact(spark, sf_dir):
    return smp.sample_exact(campaign(spark, sf_dir).select("ID"), "ID", 0.1, 42)


@query
def sample_k(spark, sf_dir):
    return smp.sample_k(campaign(spark, sf_dir).select("ID"), "ID", 1000, 42)


@query
def head_by(spark, sf_dir):
    return smp.head_by(campaign(spark, sf_dir).select("ID", "recency"), "ID", 500)


@query
def stratified_split(spark, sf_dir):
    return smp.stratified_split(campaign(spark, sf_dir).select("ID", "segment"), "segment")


@query
def seed_grid(spark, sf_dir):
    """Size and ID sum of the sample that each seed of the grid draws from the whole campaign."""
    seeds = smp.seed_grid(spark, 20).collect()
    runs = [act.Run(row["run_id"], row["seed"], NEWBIE_ACTION.frac) for row in seeds]
    rows = act.apply_action_runs(campaign(spark, sf_dir).select("ID", "newbie"), NEWBIE_ACTION, runs)
    drawn = sts.participants(rows).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("ID").alias("id_sum"))
    return drawn.join(smp.seed_grid(spark, 20), "run_id")


@query
def apply_action(spark, sf_dir):
    rows = campaign(spark, sf_dir).select("ID", *FEATURES)
    return rounded(act.apply_action(rows, RECENCY_ACTION))


@query
def participants(spark, sf_dir):
    return rounded(sts.participants(act.apply_action(campaign(spark, sf_dir).select("ID", "history"), HISTORY_ACTION)))


# ---- ranking ----

@query
def dense_rank(spark, sf_dir):
    return rank.dense_rank_desc(scored_campaign(spark, sf_dir).select("ID", "uplift"))


@query
def normalised_rank(spark, sf_dir):
    return rounded(rank.normalised_rank(scored_campaign(spark, sf_dir).select("ID", "uplift")))


@query
def ranking_positions(spark, sf_dir):
    return rank.ranking_positions(scored_campaign(spark, sf_dir))


@query
def cumulative_responses(spark, sf_dir):
    return rank.cumulative_responses(scored_campaign(spark, sf_dir))


@query
def uplift_curve(spark, sf_dir):
    return rounded(rank.uplift_curve(scored_campaign(spark, sf_dir)))


@query
def qini_curve(spark, sf_dir):
    return rounded(rank.qini_curve(scored_campaign(spark, sf_dir)))


@query
def perfect_qini_curve(spark, sf_dir):
    return rounded(rank.perfect_qini_curve(scored_campaign(spark, sf_dir)))


@query
def qini_auc(spark, sf_dir):
    return rounded(rank.qini_auc(scored_campaign(spark, sf_dir)))


@query
def qini_auc_by_segment(spark, sf_dir):
    """Qini per home region: grouped ranking with groups of uneven size."""
    rows = formula_score(campaign(spark, sf_dir).select("zip_code", "treatment", "visit", *FEATURES))
    return rounded(rank.qini_auc(rows, by=["zip_code"]))


@query
def number_responses(spark, sf_dir):
    return rounded(rank.number_responses(scored_campaign(spark, sf_dir)))


@query
def random_baseline(spark, sf_dir):
    return rounded(rank.random_baseline(scored_campaign(spark, sf_dir)))


# ---- experiments with the formula score ----

def _compared(spark, sf_dir, action, seed=42):
    baseline, _ = exp.baseline_ranking(scored_campaign(spark, sf_dir), TRIAL)
    run = [act.Run(0, seed, action.frac)]
    return exp.rank_after_action(baseline, action, run, FORMULA, TRIAL).comparison.drop(*exp.RUN_KEYS)


@query
def rank_after_action_formula(spark, sf_dir):
    return rounded(_compared(spark, sf_dir, RECENCY_ACTION))


@query
def compare_ranking(spark, sf_dir):
    scored = scored_campaign(spark, sf_dir)
    before = rank.normalised_rank(scored)
    changed = formula_score(act.apply_action(scored.drop("uplift"), HISTORY_ACTION))
    return rounded(act.compare_ranking(before, rank.normalised_rank(changed), HISTORY_ACTION))


@query
def summarise_participants(spark, sf_dir):
    return rounded(sts.summarise_participants(sts.participants(_compared(spark, sf_dir, RECENCY_ACTION))))


@query
def paired_t_interval(spark, sf_dir):
    return rounded(sts.paired_t_interval(sts.participants(_compared(spark, sf_dir, RECENCY_ACTION))))


@query
def run_experiment(spark, sf_dir):
    return rounded(exp.run_experiment(scored_campaign(spark, sf_dir), RECENCY_ACTION, FORMULA, TRIAL))


@query
def run_grid(spark, sf_dir):
    return rounded(exp.run_grid(scored_campaign(spark, sf_dir), RECENCY_ACTION, GRID_RUNS, FORMULA, TRIAL))


def small_grid(spark, sf_dir):
    """Results of a small grid, written once like every result table before it is aggregated."""
    scored = scored_campaign(spark, sf_dir)
    return freeze(exp.run_grid(scored, HISTORY_ACTION, SMALL_RUNS, FORMULA, TRIAL))


@query
def aggregate_experiments(spark, sf_dir):
    return rounded(rep.aggregate_experiments(small_grid(spark, sf_dir)))


@query
def missing_cells(spark, sf_dir):
    return rounded(rep.missing_cells(small_grid(spark, sf_dir)))


@query
def with_origin(spark, sf_dir):
    return rounded(rep.with_origin(rep.aggregate_experiments(small_grid(spark, sf_dir))))


@query
def rank_decrease_series(spark, sf_dir):
    return rounded(rep.rank_decrease_series(rep.aggregate_experiments(small_grid(spark, sf_dir))))


@query
def band(spark, sf_dir):
    agg = rep.aggregate_experiments(small_grid(spark, sf_dir)).select("frac", "avg_delta_qini", "std_delta_qini")
    return rounded(rep.band(agg, "avg_delta_qini", "std_delta_qini"))


@query
def distinct_series(spark, sf_dir):
    return rep.distinct_series(small_grid(spark, sf_dir))


# ---- distributions ----

@query
def is_categorical(spark, sf_dir):
    return sts.is_categorical(campaign(spark, sf_dir), FEATURES)


@query
def feature_percentiles(spark, sf_dir):
    return rounded(sts.feature_percentiles(campaign(spark, sf_dir), FEATURES))


@query
def density_histogram(spark, sf_dir):
    return rounded(sts.density_histogram(scored_campaign(spark, sf_dir), "uplift"))


@query
def compare_distributions(spark, sf_dir):
    return rounded(sts.compare_distributions(_compared(spark, sf_dir, RECENCY_ACTION)))


@query
def position_histogram(spark, sf_dir):
    compared = _compared(spark, sf_dir, RECENCY_ACTION).select("ID", "uplift_modified", "aca_flag")
    placed = rank.ranking_positions(compared, "uplift_modified", keep=["aca_flag"])
    total = placed.agg(F.count("*").alias("n"))
    return rounded(sts.position_histogram(sts.participants(placed), total))


@query
def before_after_formula(spark, sf_dir):
    """Qini before, after and its change for one action."""
    scored = scored_campaign(spark, sf_dir)
    return rounded(exp.before_after(scored, HISTORY_ACTION, FORMULA, TRIAL)[1])


@query
def ranking_comparison(spark, sf_dir):
    scored = scored_campaign(spark, sf_dir)
    return rounded(exp.ranking_comparison(scored, RECENCY_ACTION, FORMULA, TRIAL))


@query
def compare_models_formula(spark, sf_dir):
    """Curves of two scores on one test table, keyed by model."""
    scored = scored_campaign(spark, sf_dir)
    models = F.inline(F.array(
        F.struct(F.lit("formula").alias("model"), F.col("uplift").alias("score")),
        F.struct(F.lit("recency").alias("model"), (-F.col("recency").cast("double")).alias("score")),
    ))
    both = scored.select("ID", "treatment", "visit", models).withColumnRenamed("score", "uplift")
    curves, qini = exp.compare_models(both, TRIAL)
    return rounded(curves.join(qini, "model"))


# ---- reports ----

def attributions(spark, sf_dir):
    """Contributions of the formula's terms; `treatment` has none."""
    rows = campaign(spark, sf_dir).select("ID", *ATTRIBUTED)
    terms = {
        "recency": -F.col("recency").cast("double"),
        "history": F.floor(F.col("history") / 5000).cast("double") * 10,
        "newbie": F.col("newbie").cast("double") * 50,
        "treatment": F.lit(0.0),
    }
    means = rows.agg(*[F.avg(term).alias(f"_mean_{c}") for c, term in terms.items()])
    centred = attach_one_row(rows, means)
    pairs = F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
            F.col(c).cast("double").alias("original"), (term - F.col(f"_mean_{c}")).alias("phi"),
        )
        for c, term in terms.items()
    ]))
    return centred.select("ID", pairs)


@query
def feature_report(spark, sf_dir):
    return rounded(rep.feature_report(attributions(spark, sf_dir)))


@query
def sketched_percentiles(spark, sf_dir):
    """Whether each percentile from merged sketches of the channels stands within the stated rank error of its place."""
    rows = campaign(spark, sf_dir)
    merged = skt.merge_sketches(skt.quantile_sketches(rows, FEATURES, by=["channel"]))
    wide = skt.sketch_quantiles(merged, sts.PROPOSAL_QUANTILES)
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("q"), F.col(n).alias("at")) for n, q in sts.PROPOSAL_QUANTILES.items()])
    found = wide.select("feature", F.inline(pairs))  # one row per feature and percentile
    ranks = sts.feature_values(rows, FEATURES).join(F.broadcast(found), "feature").groupBy("feature", "name", "q").agg(
        F.avg((F.col("value") < F.col("at")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("at")).cast("double")).alias("upto")
    )
    error = F.lit(skt.rank_error())
    return ranks.select("feature", "name", ((F.col("below") - error <= F.col("q")) & (F.col("q") <= F.col("upto") + error)).alias("within"))


@query
def scan_with_quarantine(spark, sf_dir):
    """Campaign rows written as text with every hundredth history spoilt: bad lines are set aside, the others are as they were."""
    rows = campaign(spark, sf_dir).select("ID", "segment", "recency", "history")
    spoilt = rows.withColumn("history", F.when(F.col("ID") % 100 == 0, F.concat(F.lit("x"), "history")).otherwise(F.col("history").cast("string")))
    path = src.write_table(spoilt, scratch(spark, "spoilt.csv"))
    checked = read_checked(spark, path, rows.schema)
    bad = checked.bad.select(F.substring_index("line", ",", 1).cast("long").alias("ID"), F.array_join("faults", ";").alias("faults"))
    good = checked.good.select("ID", "segment", "recency", "history", F.lit("").alias("faults"))
    return rounded(good.unionByName(bad, allowMissingColumns=True))


@query
def propose_action(spark, sf_dir):
    """Proposals for a rising, a falling and an absent relation of every feature."""
    stats = rep.value_statistics(sts.feature_values(campaign(spark, sf_dir), FEATURES))
    cases = F.explode(F.array(F.lit(0.5), F.lit(-0.5), F.lit(0.0))).alias("correlation")
    proposed = rep.propose_action(stats.select("*", cases))
    return rounded(proposed.select("feature", "correlation", "proposed_strategy", "from_value", "to_value"))


# ---- models: fitted on the whole training side, scored on the whole test side ----

MODEL_CONFIGS = {
    "lgbm": BoostedTreesConfig(),
    "mlp": NeuralNetConfig(),
    "uplift_rf": ForestConfig(),
}
#: The published grid has 10 shares and 100 seeds; here it has 10 seeds a share.
MODEL_RUNS = act.run_grid_keys([k / 100 for k in range(1, 11)], smp.seed_list(10))
#: The published settings have 200 trees for the e-mail trial and 50 for the promotion.
GRID_CONFIGS = {**MODEL_CONFIGS, "lgbm": BoostedTreesConfig(n_estimators=50)}


def prepared(spark, sf_dir) -> Prepared:
    """The campaign prepared like an e-mail trial: one arm dropped, bands and categories encoded, split."""
    rows = trial_rows(spark, sf_dir).drop("treatment")
    return prepare_email(
        rows, arms=ALL_ARMS, excluded=DROPPED_ARM, bands=BAND_VALUES, band_default=BAND_DEFAULT,
    )


def _frozen(spark, sf_dir) -> Prepared:
    sides = prepared(spark, sf_dir)
    return Prepared(freeze(sides.train, spread=True), freeze(sides.test, spread=True), sides.features)


def _fitted(spark, sf_dir, name):
    sides = _frozen(spark, sf_dir)
    return store.fit_model(name, sides.train, sides.features, MODEL_CONFIGS[name]), sides


@query
def prepare_campaign(spark, sf_dir):
    """Both sides of the prepared trial with all encoded columns."""
    sides = prepared(spark, sf_dir)
    both = sides.train.withColumn("side", F.lit("train")).unionByName(sides.test.withColumn("side", F.lit("test")))
    return rounded(both)


@query
def ct_gbt(spark, sf_dir):
    model, sides = _fitted(spark, sf_dir, "lgbm")
    return rounded(model.score(sides.test).select("ID", "uplift"))


@query
def ct_mlp(spark, sf_dir):
    model, sides = _fitted(spark, sf_dir, "mlp")
    return rounded(store.predict_uplift(model, sides.test).select("ID", "uplift"))


@query
def uplift_forest(spark, sf_dir):
    model, sides = _fitted(spark, sf_dir, "uplift_rf")
    return rounded(model.score(sides.test).select("ID", "uplift"))


@query
def feature_importances(spark, sf_dir):
    model, _ = _fitted(spark, sf_dir, "uplift_rf")
    return rounded(model.feature_importances(spark))


@query
def background_kmeans(spark, sf_dir):
    return rounded(kmeans_centres(campaign(spark, sf_dir), FEATURES, 100, 42))


@query
def shapley_attributions(spark, sf_dir):
    """Attributions of a forest on the first 500 training rows, against 100 background rows, as published."""
    model, sides = _fitted(spark, sf_dir, "uplift_rf")
    config = ExplainConfig()
    background = freeze(smp.sample_k(sides.train, "ID", config.background, config.seed).select(*sides.features))
    rows = smp.head_by(sides.train, "ID", config.forest_rows)
    return rounded(shapley(model.margin, rows, background, sides.features, n_permutations=config.n_permutations))


@query
def tree_attributions(spark, sf_dir):
    """Exact attributions of boosted trees on every training row."""
    sides = _frozen(spark, sf_dir)
    model = store.fit_model("lgbm", sides.train, sides.features, GRID_CONFIGS["lgbm"])
    return rounded(model.attributions(sides.train))


@query
def train_and_explain_model(spark, sf_dir):
    """Action report of boosted trees explained on every training row."""
    sides = _frozen(spark, sf_dir)
    trained = train_and_explain("lgbm", sides.train, sides.test, sides.features, TRIAL, MODEL_CONFIGS["lgbm"])
    return rounded(trained.report)


def _refit(spark, sf_dir, name):
    sides = _frozen(spark, sf_dir)
    model = store.fit_model(name, sides.train, sides.features, GRID_CONFIGS[name])
    rescore = refitted(name, sides.train, sides.features, GRID_CONFIGS[name], edges=model.edges)
    return model.score(sides.test), rescore, exp.Trial(dataset="campaign", model=name)


@query
def rank_after_action(spark, sf_dir):
    scored, rescore, trial = _refit(spark, sf_dir, "uplift_rf")
    baseline, _ = exp.baseline_ranking(scored, trial)
    runs = act.run_grid_keys((0.05, 0.1), smp.seed_list(5))  # every test row comes back once per run
    return rounded(exp.rank_after_action(baseline, RECENCY_ACTION, runs, rescore, trial).comparison)


@query
def run_grid_forest(spark, sf_dir):
    scored, rescore, trial = _refit(spark, sf_dir, "uplift_rf")
    return rounded(exp.run_grid(scored, RECENCY_ACTION, MODEL_RUNS, rescore, trial))


@query
def run_grid_boosted_trees(spark, sf_dir):
    scored, rescore, trial = _refit(spark, sf_dir, "lgbm")
    return rounded(exp.run_grid(scored, RECENCY_ACTION, MODEL_RUNS, rescore, trial))


@query
def before_after(spark, sf_dir):
    scored, rescore, trial = _refit(spark, sf_dir, "uplift_rf")
    return rounded(exp.before_after(scored, RECENCY_ACTION, rescore, trial)[2])


@query
def ranking_comparison_forest(spark, sf_dir):
    scored, rescore, trial = _refit(spark, sf_dir, "uplift_rf")
    return rounded(exp.ranking_comparison(scored, RECENCY_ACTION, rescore, trial))


@query
def net_attributions(spark, sf_dir):
    """Expected gradients of the net on 1,000 training rows against 100 centres, as published."""
    model, sides = _fitted(spark, sf_dir, "mlp")
    return rounded(explain(model, sides.train))


@query
def compare_models(spark, sf_dir):
    """Qini of every stored model on one test table."""
    sides = _frozen(spark, sf_dir)
    folders = {}
    for name, config in MODEL_CONFIGS.items():
        model = store.fit_model(name, sides.train, sides.features, config)
        folders[name] = scratch(spark, name)
        store.save_model(model, folders[name], spark.createDataFrame([], src.REPORT_SCHEMA))
    folders["not_stored"] = scratch(spark, "none")
    _, qini = exp.compare_models(freeze(store.score_saved_models(spark, folders, sides.test)), TRIAL)
    return rounded(qini)


@query
def save_load_model(spark, sf_dir):
    """Scores of a forest after writing and reading it back."""
    model, sides = _fitted(spark, sf_dir, "uplift_rf")
    folder = scratch(spark, "forest")
    store.save_model(model, folder, spark.createDataFrame([], src.REPORT_SCHEMA))
    return rounded(store.load_model(spark, folder).score(sides.test).select("ID", "uplift"))
