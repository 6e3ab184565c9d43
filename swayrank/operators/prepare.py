"""Campaign preparation: treatment flags, labels, encodings, IDs and feature selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swayrank.operators.order import ordered_index

# The spending bands of the public e-mail trial and the amount that stands for each.
# The last key is kept as first published; any other band counts as DEFAULT_SPEND.
SPEND_BANDS = {
    "1) $0 - $100": 50,
    "2) $100 - $200": 150,
    "3) $200 - $350": 275,
    "4) $350 - $500": 425,
    "5) $500 - $750": 575,
    "5) $750 - $1000": 825,
}
DEFAULT_SPEND = 1000

MAX_CATEGORIES = 1000


def binarize_treatment(df: DataFrame, col: str, treated: str, out: str = "treatment") -> DataFrame:
    """1 where `col` equals the treated label exactly, else 0, null included."""
    return df.withColumn(out, F.when(F.col(col) == treated, 1).otherwise(0))


def map_treatment(df: DataFrame, col: str, arms: Mapping[str, int], out: str = "treatment") -> DataFrame:
    """Look the label up in `arms`; a label not listed gives null."""
    return df.withColumn(out, _lookup(F.col(col), arms))


def _lookup(col: Column, values: Mapping[str, int]) -> Column:
    branches = F.lit(None).cast("int")
    for label, value in values.items():
        branches = F.when(col == label, value).otherwise(branches)
    return branches


def class_transform_label(
    df: DataFrame, treatment: str = "treatment", target: str = "visit", out: str = "label"
) -> DataFrame:
    """1 for treated responders and untreated non-responders, else 0."""
    t, y = F.col(treatment), F.col(target)
    return df.withColumn(out, F.when(((t == 1) & (y == 1)) | ((t == 0) & (y == 0)), 1).otherwise(0))


def exclude_arm(df: DataFrame, col: str, arm: str) -> DataFrame:
    """Drop one treatment arm; rows without a label stay."""
    return df.where(~F.col(col).eqNullSafe(arm))


def map_ordinal(
    df: DataFrame, col: str, values: Mapping[str, int] = SPEND_BANDS, default: int = DEFAULT_SPEND
) -> DataFrame:
    """Replace band labels by numbers; labels not listed, null included, give `default`."""
    return df.withColumn(col, F.coalesce(_lookup(F.col(col), values), F.lit(default)))


def category_values(df: DataFrame, cols: Sequence[str], limit: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted non-null values of each column; refuses columns with more than `limit` of them.

    One pass finds the values of all columns; the driver gets at most limit + 1 per column.
    """
    found: dict[str, list[str]] = {c: [] for c in cols}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols]))
    distinct = df.select(pairs.alias("_p")).select("_p.col", "_p.value").where("value is not null").distinct()
    rows = distinct.limit((limit + 1) * len(cols)).collect()
    for row in rows:
        found[row["col"]].append(row["value"])
    for c, values in found.items():
        if len(values) > limit or len(rows) == (limit + 1) * len(cols):
            raise ValueError(f"too many categories to encode (limit {limit}), seen on {c}")
    return {c: sorted(values) for c, values in found.items()}


def one_hot(df: DataFrame, cols: Sequence[str], values: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Replace each column by 0/1 columns `col_value` in sorted value order; null gives zeros.

    Named columns instead of a vector, because actions and reports address single categories.
    """
    values = values or category_values(df, cols)
    kept = [F.col(c) for c in df.columns if c not in cols]
    flags = [
        F.when(F.col(c).cast("string") == v, 1).otherwise(0).alias(f"{c}_{v}") for c in cols for v in values[c]
    ]
    return df.select(*kept, *flags)


def assign_id(df: DataFrame, order_cols: Sequence[str], out: str = "ID") -> DataFrame:
    """Number the rows 0..n-1 in a declared order; end it with a unique column."""
    return ordered_index(df, [F.col(c).asc() for c in order_cols], out=out)


def check_unique_id(df: DataFrame, id_col: str = "ID") -> DataFrame:
    """Fail if an ID repeats: samples and before/after joins rely on it."""
    repeated = df.groupBy(id_col).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"{id_col} is not unique, e.g. {repeated[0][id_col]}")
    return df


def feature_columns(df: DataFrame, prefix: str | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """Feature names: those with `prefix`, or all but the excluded ones."""
    return [c for c in df.columns if (prefix is None or c.startswith(prefix)) and c not in exclude]


def select_features(
    df: DataFrame, prefix: str | None = None, exclude: Sequence[str] = (), keep: Sequence[str] = ("ID",)
) -> DataFrame:
    """Project to `keep` and the features, so that scans read only these columns."""
    return df.select(*keep, *[c for c in feature_columns(df, prefix, exclude) if c not in keep])


def class_transform_score(probability: str = "probability", out: str = "uplift") -> Column:
    """Uplift of a class-transformation model: 2 * p(label = 1) - 1."""
    from pyspark.ml.functions import vector_to_array

    return (2 * vector_to_array(F.col(probability))[1] - 1).alias(out)


def relative_drop(
    df: DataFrame, baseline: str = "baseline_qini_coeff", value: str = "qini_coeff", out: str = "delta_qini"
) -> DataFrame:
    """(baseline - value) / baseline; null where the baseline is 0."""
    return df.withColumn(out, F.try_divide(F.col(baseline) - F.col(value), F.col(baseline)))
