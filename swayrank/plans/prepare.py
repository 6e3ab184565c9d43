"""Preparation of the two trial layouts the engine knows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from swayrank.operators import prepare as prep
from swayrank.operators.sampling import stratified_split


# The arms of the public e-mail trial that are compared.
EMAIL_ARMS = {"Womens E-Mail": 1, "No E-Mail": 0}


@dataclass(frozen=True)
class Prepared:
    train: DataFrame
    test: DataFrame
    features: list[str]


def prepare_promotion(
    train: DataFrame, test: DataFrame, treatment_col: str = "Promotion", treated: str = "Yes",
    target: str = "purchase", feature_prefix: str = "V",
) -> Prepared:
    """Trial with separate train and test files and anonymous features; IDs are checked once."""
    def ready(df: DataFrame) -> DataFrame:
        prep.check_unique_id(df)
        return prep.class_transform_label(prep.binarize_treatment(df, treatment_col, treated), target=target)

    return Prepared(ready(train), ready(test), prep.feature_columns(train, prefix=feature_prefix))


def prepare_email(
    df: DataFrame, order_cols: list[str] | None = None, treatment_col: str = "segment", target: str = "visit",
    arms: Mapping[str, int] = EMAIL_ARMS, excluded: str = "Mens E-Mail",
    band_col: str = "history_segment", bands: Mapping[str, int] = prep.SPEND_BANDS, band_default: int = prep.DEFAULT_SPEND,
    encoded: tuple[str, ...] = ("zip_code", "channel"), test_share: float = 0.3, seed: int = 42,
) -> Prepared:
    """One trial table: drop an arm, number, encode, label, and split by treatment arm.

    Rows that have no ID are numbered in `order_cols` order; given IDs are checked once.
    """
    kept = prep.exclude_arm(df, treatment_col, excluded)
    if "ID" in kept.columns:
        prep.check_unique_id(kept)
    else:
        kept = prep.assign_id(kept, order_cols or sorted(kept.columns))
    coded = prep.one_hot(prep.map_ordinal(kept, band_col, bands, band_default), list(encoded))
    flagged = prep.map_treatment(coded, treatment_col, arms)
    labelled = prep.class_transform_label(flagged, target=target)
    features = prep.feature_columns(labelled, exclude=[treatment_col, target, "ID", "treatment", "label"])
    sided = stratified_split(labelled, treatment_col, "ID", test_share, seed)
    return Prepared(
        sided.where("side = 'train'").drop("side"), sided.where("side = 'test'").drop("side"), features
    )
