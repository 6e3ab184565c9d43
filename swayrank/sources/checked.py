"""Scans that set bad lines aside instead of failing or passing them on as nulls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from swayrank.session import freeze

LINE = "_line"
ORIGIN = ["origin_file", "origin_modified"]


class TooManyBadRows(ValueError):
    """More rows were set aside than the caller allows."""


@dataclass(frozen=True)
class Checked:
    """Rows that fit the schema, and the others as they stood in their file, with what is wrong with them."""

    good: DataFrame
    bad: DataFrame

    def counts(self) -> DataFrame:
        """(origin_file, fault, n): how many rows were set aside, by file and fault."""
        return self.bad.select("origin_file", F.explode("faults").alias("fault")).groupBy("origin_file", "fault").agg(F.count("*").alias("n"))


def read_checked(
    spark: SparkSession, path: str, schema: StructType, required: tuple[str, ...] = (), max_bad_share: float = 1.0, origin: bool = False,
) -> Checked:
    """CSV files with a header line, by `schema`, whose column names the header must have, in any order.

    A line is set aside if it has too few or too many fields, a value that its column's type does not take, or none in a
    `required` column. Good rows have the schema's columns, and with `origin` the file and its time. What is set aside has the
    line, its file and time, and the list of faults. If more than `max_bad_share` of all lines are bad, it is an error.
    """
    header = spark.read.option("header", True).csv(path).columns
    absent = [f.name for f in schema if f.name not in header]
    if absent:
        raise ValueError(f"{path} has no column {', '.join(absent)}")
    texts = StructType([*[StructField(c, StringType()) for c in header], StructField(LINE, StringType())])
    raw = spark.read.schema(texts).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=LINE, enforceSchema=False).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias(ORIGIN[0]), F.col("_metadata.file_modification_time").alias(ORIGIN[1]))
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema}
    faults = [F.when(F.col(LINE).isNotNull(), F.lit("fields"))]
    faults += [F.when(F.col(LINE).isNull() & F.col(f"`{c}`").isNotNull() & value.isNull(), F.lit(f"type of {c}")) for c, value in typed.items()]
    faults += [F.when(F.col(LINE).isNull() & F.col(f"`{c}`").isNull(), F.lit(f"no {c}")) for c in required]
    as_read = F.concat_ws(",", *[F.coalesce(f"`{c}`", F.lit("")) for c in header])
    # Written once: Spark does not read lines for a corrupt-record column alone, and both sides read the rows.
    judged = freeze(raw.select(
        *[value.alias(c) for c, value in typed.items()], F.coalesce(LINE, as_read).alias(LINE), *ORIGIN, F.array_compact(F.array(*faults)).alias("_faults"),
    ))
    good = judged.where(F.size("_faults") == 0).select(*[f"`{f.name}`" for f in schema], *(ORIGIN if origin else []))
    bad = judged.where(F.size("_faults") > 0).select(F.col(LINE).alias("line"), *ORIGIN, F.col("_faults").alias("faults"))
    if max_bad_share < 1:
        sums = judged.agg(F.count("*").alias("n"), F.count_if(F.size("_faults") > 0).alias("bad")).first()
        if sums["bad"] > max_bad_share * sums["n"]:
            raise TooManyBadRows(f"{sums['bad']} of {sums['n']} lines of {path} are bad, more than a share of {max_bad_share}")
    return Checked(good, bad)
