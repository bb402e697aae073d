"""Raw to clean bookings. Every step is a projection; together they collapse to one."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.functions.columns import ratio
from fareflow.schemas import CLEAN_BOOKINGS, LATE_LEAKAGE_COLUMNS, LEAKAGE_COLUMNS, STATUS_TARGET, check_contract
from fareflow.sources.files import nan_to_null


def snake_case_names(df: DataFrame) -> DataFrame:
    """Trim, join words with underscores, keep word characters only, lower case. Metadata only."""
    def snake(name: str) -> str:
        return re.sub(r"[^\w]", "", re.sub(r"[\s\-]+", "_", name.strip())).lower()
    return df.toDF(*[snake(c) for c in df.columns])


def status_target(status: str | Column, mapping: Mapping[str, int] = STATUS_TARGET) -> Column:
    """0/1 target of a status label; labels outside the mapping give NULL."""
    c = F.col(status) if isinstance(status, str) else status
    out = None
    for label, value in mapping.items():
        out = F.when(c == label, value) if out is None else out.when(c == label, value)
    return out.cast("int")


def map_target(df: DataFrame, status: str = "booking_status", target: str = "is_cancelled",
               mapping: Mapping[str, int] = STATUS_TARGET) -> DataFrame:
    return df.withColumn(target, status_target(status, mapping)).drop(status)


def drop_columns(df: DataFrame, columns: Sequence[str] = LEAKAGE_COLUMNS) -> DataFrame:
    """Names that are absent are ignored."""
    return df.drop(*columns)


def strip_quotes(df: DataFrame, columns: Sequence[str] = ("booking_id", "customer_id")) -> DataFrame:
    return df.withColumns({c: F.btrim(F.col(c), F.lit('"')) for c in columns})


def recast(df: DataFrame, one_decimal: Sequence[str] = ("avg_vtat",),
           numeric: Sequence[str] = ("avg_ctat", "booking_value", "ride_distance")) -> DataFrame:
    """Numbers become doubles; waiting time is kept at its one decimal so that bin edges are exact."""
    df = df.withColumns(
        {c: F.round(F.col(c).cast("double"), 1) for c in one_decimal}
        | {c: F.col(c).cast("double") for c in numeric}
        | {"date": F.try_to_date(F.col("date").cast("string"), "yyyy-MM-dd")}
    )
    return nan_to_null(df)


def clean(raw: DataFrame, mapping: Mapping[str, int] = STATUS_TARGET) -> DataFrame:
    df = snake_case_names(raw)
    df = map_target(df, mapping=mapping)
    df = strip_quotes(drop_columns(df))
    return check_contract(recast(df), CLEAN_BOOKINGS)


def handoff(clean_rows: DataFrame, ids: Sequence[str] = ("booking_id", "customer_id")) -> DataFrame:
    """Clean rows without ids and late leakage columns, as the association steps take them."""
    return drop_columns(clean_rows, [*ids, *LATE_LEAKAGE_COLUMNS])


def status_share(df: DataFrame, status: str, counted: Sequence[str]) -> DataFrame:
    """Rows whose status is in ``counted``: number and rounded percentage."""
    hits = F.count_if(F.col(status).isin(*counted))
    return df.agg(F.count("*").alias("n_rows"), hits.alias("n_hits"),
                  F.round(ratio(hits, F.count("*")) * 100).cast("bigint").alias("pct"))
