"""Documents in and out: Parquet rows, JSON text and VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def read_json(spark: SparkSession, path: str, column: str = "doc") -> DataFrame:
    """One VARIANT document for each line; lines that are not JSON are NULL."""
    return configure(spark).read.text(path).select(F.try_parse_json("value").alias(column))


def write_json(df: DataFrame, column: str, path: str) -> None:
    df.select(F.to_json(column)).write.text(path)


def document(*columns: Column) -> Column:
    """A VARIANT document of named columns."""
    return F.to_variant_object(F.struct(*columns))
