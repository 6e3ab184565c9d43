"""Train a model, measure its ranking, and explain which changes would raise a score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from swayrank.models.attribution import background_kmeans, net_attributions, shapley_attributions
from swayrank.models.store import UpliftModel, fit_model, save_model
from swayrank.operators.ranking import qini_auc, uplift_curve
from swayrank.operators.report import feature_report
from swayrank.operators.sampling import head_by, sample_k
from swayrank.plans.experiment import Trial
from swayrank.session import freeze


@dataclass(frozen=True)
class ExplainConfig:
    """Which rows of net and forest are explained and against how many background rows (centres for the net).

    A forest costs rows x 2 x permutations x (features + 1) x background scored variants, the net rows x background gradients.
    Boosted trees need neither.
    """

    mlp_rows: int = 1000
    forest_rows: int = 500
    background: int = 100
    n_permutations: int = 2
    seed: int = 42


@dataclass(frozen=True)
class Trained:
    model: UpliftModel
    scored: DataFrame
    qini: DataFrame
    curve: DataFrame
    attributions: DataFrame
    report: DataFrame


def explain(
    model: UpliftModel, rows: DataFrame, id_col: str = "ID", config: ExplainConfig = ExplainConfig()
) -> DataFrame:
    """Attributions per row and feature: exact ones of all rows for boosted trees, samples of fixed size for the others."""
    features = list(model.features)
    slim = rows.select(id_col, *features)
    if model.name == "lgbm":
        return model.attributions(slim, id_col)
    if model.name == "mlp":
        background = background_kmeans(slim, features, config.background, config.seed)
        return net_attributions(model, sample_k(slim, id_col, config.mlp_rows, config.seed), background, id_col)
    background = sample_k(slim, id_col, config.background, config.seed).select(*features)
    chosen = head_by(slim, id_col, config.forest_rows)
    return shapley_attributions(
        model.margin, chosen, freeze(background), features, id_col, config.n_permutations, config.seed
    )


def train_and_explain(
    name: str, train: DataFrame, test: DataFrame, features: Sequence[str], trial: Trial, config=None,
    explain_config: ExplainConfig = ExplainConfig(), label: str = "label", folder: str | None = None,
) -> Trained:
    """Fit, score the test rows (Qini, curve), explain training rows, report actions; optionally store all."""
    model = fit_model(
        name, train, features, config, trial.treatment, trial.target, label=label, id_col=trial.id_col
    )
    scored = model.score(test)
    attributions = freeze(explain(model, train, trial.id_col, explain_config))
    report = feature_report(attributions)
    if folder:
        save_model(model, folder, report)
    return Trained(
        model,
        scored,
        qini_auc(scored, "uplift", trial.treatment, trial.target),
        uplift_curve(scored, "uplift", trial.treatment, trial.target),
        attributions,
        report,
    )
