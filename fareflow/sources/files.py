"""File sources and sinks of the pipeline: raw CSV, clean, split, silver, fit and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.schemas import RAW_BOOKINGS


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header and doubled quotes; fixed schema, so no inference pass over the files."""
    return spark.read.schema(RAW_BOOKINGS).csv(path, header=True, quote='"', escape='"')


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_clean(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One table partitioned by split, so that a filter on split prunes folders.

    The rows stay in their tasks: each task writes at most one file per split and nothing is shuffled.
    """
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_silver(features: DataFrame, path: str) -> None:
    write_by_split(features, path)


def write_reports(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_reports(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL in every layer; NaN would sort above all numbers."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in numeric}) if numeric else df
