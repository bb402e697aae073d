"""Value counts, top-k lists, group rates, class balance and split summaries.

All are hash aggregates with map-side combine, so a key that holds a third of the rows costs one
partial row per task. Sorting happens on aggregated rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.functions.columns import as_col, ratio
from fareflow.scale import totals_of


def value_counts(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    counted = df if keep_null else df.where(F.col(column).isNotNull())
    return counted.groupBy(column).agg(F.count("*").alias("n"))


def value_shares(df: DataFrame, column: str, keep_null: bool = False) -> DataFrame:
    counts = value_counts(df, column, keep_null)
    total = totals_of(counts, n=F.sum("n"))["n"]
    return counts.withColumn("share", ratio("n", total))


def top_values(df: DataFrame, column: str, k: int = 20, least: bool = False, keep_null: bool = False) -> DataFrame:
    """Most (or least) frequent values; ties are broken by the value so the list is repeatable."""
    n = F.col("n").asc() if least else F.col("n").desc()
    return value_counts(df, column, keep_null).orderBy(n, F.col(column).asc()).limit(k)


def distinct_labels(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def group_rate(df: DataFrame, keys: Sequence[str], target: str = "is_cancelled") -> DataFrame:
    """cancelled, total and cancel_rate per key; null keys are dropped, null targets do not count.

    Null keys are dropped by a count taken with the group: a filter on a computed key is pushed below every step that
    builds it, and there each mention of a step is written out (and evaluated) anew for every row.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(target), F.lit(0)).cast("bigint").alias("cancelled"),
        F.count(target).alias("total"), F.count_if(known).alias("__known"),
    ).where(F.col("__known") > 0).drop("__known").withColumn("cancel_rate", ratio("cancelled", "total"))


def class_balance(df: DataFrame, target: str = "is_cancelled", n_features: int = 18) -> DataFrame:
    """Counts, shares, majority/minority ratio, negative weight and events-per-variable check."""
    n1, n0 = F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)
    counts = df.agg(n0.alias("n_negative"), n1.alias("n_positive"), F.count("*").alias("n_rows"))
    epv = ratio("n_positive", F.lit(n_features))
    return counts.select(
        "n_negative", "n_positive", "n_rows",
        ratio("n_positive", "n_rows").alias("positive_share"),
        ratio(F.greatest("n_negative", "n_positive"), F.least("n_negative", "n_positive")).alias("imbalance_ratio"),
        ratio("n_negative", "n_positive").alias("scale_pos_weight"),
        F.round(epv, 1).alias("events_per_variable"),
        F.when(epv >= 10, "PASS").otherwise("FAIL").alias("epv_check"),
    )


def majority_class(df: DataFrame, target: str = "is_cancelled") -> DataFrame:
    """Most frequent class; the smaller label wins a tie."""
    counts = value_counts(df, target)
    return counts.agg(F.max_by(F.col(target), F.struct(F.col("n"), -F.col(target))).alias("majority"))


def flag_summary(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Sum and share of each 0/1 flag, one row per flag, one pass."""
    sums = df.agg(F.count("*").alias("n"), *[F.sum(f).cast("bigint").alias(f) for f in flags])
    rows = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n_set"),
                              ratio(F.col(f), "n").alias("share")) for f in flags])
    return sums.select(F.inline(rows))


def split_summary(df: DataFrame, split: str = "split", target: str = "is_cancelled", n_features: int = 18) -> DataFrame:
    per = df.groupBy(split).agg(F.count("*").alias("n_rows"), F.avg(target).alias("cancel_rate"))
    total = totals_of(per, n=F.sum("n_rows"))["n"]
    return per.select(split, "n_rows", F.round(ratio("n_rows", total), 2).alias("share"),
                      F.lit(n_features).alias("n_features"), "cancel_rate")


def temporal_split(date: str | Column, train_end: str = "2024-09-30", val_end: str = "2024-11-30") -> Column:
    """Split label by date; a row without a date belongs to no split."""
    d = as_col(date)
    return (F.when(d <= F.lit(train_end).cast("date"), "train")
            .when(d <= F.lit(val_end).cast("date"), "val")
            .when(d.isNotNull(), "test"))
