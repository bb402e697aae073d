"""Checks of documented assumptions as a table: check, observed, expected, pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareflow.operators.series import missing_days
from fareflow.scale import totals_of
from fareflow.schemas import LEAKAGE_COLUMNS


def assumption_report(df: DataFrame, n_rows: int, n_columns: int, start: str, end: str, class_share_pct: int,
                      customer: str = "customer_id", target: str = "is_cancelled",
                      leakage: Sequence[str] = LEAKAGE_COLUMNS) -> DataFrame:
    """Size, whole-period coverage, class share, binary target, distinct customers, absent leakage."""
    gaps = totals_of(missing_days(df, start, end), n=F.count("*"))["n"]
    wide = df.agg(
        F.count("*").alias("rows"), F.count_distinct(customer).alias("customers"),
        F.round(F.avg(target) * 100).cast("bigint").alias("share"),
        F.count_if(~F.col(target).isin(0, 1) | F.col(target).isNull()).alias("bad_target"),
    ).withColumn("gaps", gaps)
    leaked = len([c for c in leakage if c in df.columns])
    checks = [
        ("row_count", F.col("rows"), F.lit(n_rows)),
        ("column_count", F.lit(len(df.columns)), F.lit(n_columns)),
        ("distinct_customers_equal_rows", F.col("customers"), F.col("rows")),
        ("days_without_data", F.col("gaps"), F.lit(0)),
        ("cancellation_share_pct", F.col("share"), F.lit(class_share_pct)),
        ("target_not_binary", F.col("bad_target"), F.lit(0)),
        ("leakage_columns_present", F.lit(leaked), F.lit(0)),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check"), o.cast("bigint").alias("observed"),
                              e.cast("bigint").alias("expected")) for n, o, e in checks])
    return wide.select(F.inline(rows)).withColumn("pass", (F.col("observed") == F.col("expected")).cast("int"))
