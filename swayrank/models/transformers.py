"""Preparation as stored pipeline stages: what was learnt from the training table is kept with the model.

A table scored later is encoded and scaled as the training table was, whatever values it has.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swayrank.operators.prepare import category_values, map_ordinal, one_hot


class Standardise(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A vector of (column - mean) / deviation; constant columns are only centred. Nulls become NaN."""

    means = Param(Params._dummy(), "means", "mean of each column", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "population deviation of each column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, means=None, deviations=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], out: str) -> Standardise:
        """Means and population deviations of `columns`, in one pass."""
        numbers = [F.col(c).cast("double") for c in columns]
        row = df.agg(*[F.avg(c) for c in numbers], *[F.stddev_pop(c) for c in numbers]).first()
        known = [float(x) if x is not None else 0.0 for x in row]
        return cls(inputCols=list(columns), outputCol=out, means=known[: len(columns)], deviations=known[len(columns) :])

    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = [
            (F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) - F.lit(m)) / F.lit(d if d > 0 else 1.0)
            for c, m, d in zip(self.getInputCols(), self.getOrDefault(self.means), self.getOrDefault(self.deviations))
        ]
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(*scaled)))


class CampaignEncoder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Bands to numbers and categories to 0/1 columns, with the values seen when it was fitted.

    A category that was not seen gives zeros, an unknown band the default; the columns are always the same.
    """

    settings = Param(Params._dummy(), "settings", "categories, band column, band values and default as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, settings=None):
        super().__init__()
        if settings is not None:
            self._set(settings=settings)

    @classmethod
    def fit(
        cls, df: DataFrame, encoded: Sequence[str], band_col: str | None = None, bands: Mapping[str, int] | None = None, default: int = 0,
    ) -> CampaignEncoder:
        found = {"categories": category_values(df, list(encoded)), "band_col": band_col, "bands": dict(bands or {}), "default": default}
        return cls(settings=json.dumps(found))

    def _transform(self, df: DataFrame) -> DataFrame:
        known = json.loads(self.getOrDefault(self.settings))
        if known["band_col"]:
            df = map_ordinal(df, known["band_col"], known["bands"], known["default"])
        return one_hot(df, list(known["categories"]), known["categories"])
