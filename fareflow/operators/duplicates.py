"""Duplicate audits on key columns and id format checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareflow.scale import split_hot_keys


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def duplicated_rows(df: DataFrame, keys: Sequence[str], times: int | None = None) -> DataFrame:
    """All rows whose key occurs more than once, or exactly ``times`` times."""
    wanted = F.col("n_rows") > 1 if times is None else F.col("n_rows") == times
    return split_hot_keys(df, keys, wanted, "left_semi")


def with_key_multiplicity(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with ``n_rows`` of their key and the 0/1 flag ``is_duplicated``."""
    counted = split_hot_keys(df, keys, F.lit(True), "inner")
    return counted.withColumn("is_duplicated", (F.col("n_rows") > 1).cast("int"))


def multiplicity_histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys, and rows, occur 1, 2, 3, ... times."""
    per = df.groupBy(*keys).agg(F.count("*").alias("times"))
    return per.groupBy("times").agg(F.count("*").alias("n_keys"), F.sum("times").alias("n_rows"))


def id_parts(df: DataFrame, column: str) -> DataFrame:
    """Length, letter prefix and digits of an id; parts that do not match are NULL."""
    pattern = r"([A-Za-z]+)([0-9]+)"
    return df.withColumns({
        "id_length": F.length(column),
        "letters": F.nullif(F.regexp_extract(F.col(column), pattern, 1), F.lit("")),
        "digits": F.nullif(F.regexp_extract(F.col(column), pattern, 2), F.lit("")),
    })


def id_profile(df: DataFrame, column: str) -> DataFrame:
    """Per letter prefix and length: rows and the numeric range of the digits."""
    number = F.col("digits").try_cast("bigint")  # more digits than a bigint holds: no number
    return id_parts(df, column).groupBy("letters", "id_length").agg(
        F.count("*").alias("n"), F.min(number).alias("min_number"), F.max(number).alias("max_number"))
