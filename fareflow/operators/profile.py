"""Column profiles: one scan for the moments, one for distinct counts, one for exact quartiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.functions.columns import ratio
from fareflow.scale import exact_quantiles, value_counts_long

CARDINALITY_LIMIT = 0.5


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _moments(c: str) -> Column:
    """Bias-corrected skewness and excess kurtosis come from the power sums of centred moments."""
    x = F.col(c).cast("double")
    return F.struct(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        F.when(F.count(x) > 1, F.var_pop(x) * ratio(F.count(x), F.nullif(F.count(x) - 1, F.lit(0)))).alias("variance"),
        F.when(F.min(x) < F.max(x), F.skewness(x)).alias("skew_pop"),
        F.when(F.min(x) < F.max(x), F.kurtosis(x)).alias("kurt_pop"),
    )


def corrected_skew(skew: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 2, skew * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def corrected_kurtosis(kurt: Column, n: Column) -> Column:
    n = n.cast("double")
    scale = ratio(n - 1, (n - 2) * (n - 3))
    return F.when(n > 3, scale * ((n + 1) * kurt + 6))


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric summary, one row per column: count, min, max, mean, std, variance, skew, kurtosis."""
    columns = list(columns or _numeric(df))
    wide = df.agg(*[_moments(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("m")) for c in columns])
    m = wide.select(F.explode(rows).alias("r")).select("r.column", "r.m.*")
    return m.select(
        "column", "n", "min", "max", "mean", F.sqrt("variance").alias("std"), "variance",
        corrected_skew(F.col("skew_pop"), F.col("n")).alias("skew"),
        corrected_kurtosis(F.col("kurt_pop"), F.col("n")).alias("kurtosis"),
    )


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact interpolated quartiles, one row per column."""
    q = exact_quantiles(value_counts_long(df, columns), [0.25, 0.5, 0.75])
    pick = lambda p: F.max(F.when(F.col("q") == p, F.col("value")))
    return q.groupBy(F.col("feature").alias("column")).agg(
        pick(0.25).alias("q25"), pick(0.5).alias("median"), pick(0.75).alias("q75"))


def distinct_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values, their ratio (null counts as a value) and the high/low cardinality rule."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    wide = df.agg(F.count("*").alias("__rows"), *[count(F.col(c)).alias(f"{c}__d") for c in columns],
                  *[F.count_if(F.col(c).isNull()).alias(f"{c}__nulls") for c in columns])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__d").alias("n_distinct"),
                 F.col(f"{c}__nulls").alias("n_null"), F.col("__rows").alias("n_rows"))
        for c in columns
    ])
    r = ratio(F.col("n_distinct") + F.least(F.col("n_null"), F.lit(1)), "n_rows")
    return wide.select(F.inline(rows)).withColumns({
        "distinct_ratio": r,
        "cardinality": F.when(r <= CARDINALITY_LIMIT, "category").otherwise("text"),
    })


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None, only_missing: bool = True) -> DataFrame:
    """Null count and percentage per column, one pass."""
    columns = list(columns or df.columns)
    wide = df.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"),
                              F.round(ratio(F.col(c), "__rows") * 100, 2).alias("pct_missing")) for c in columns])
    out = wide.select(F.inline(rows))
    return out.where(F.col("n_missing") > 0) if only_missing else out


def nulls_by_target(df: DataFrame, column: str, target: str = "is_cancelled") -> DataFrame:
    return df.groupBy(target).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_null"),
    ).withColumn("pct_null", ratio("n_null", "n_rows") * 100)


def full_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type, nulls, distinct values and, for numbers, moments and quartiles."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numeric = _numeric(df)
    kinds = F.create_map(*[F.lit(v) for kv in types.items() for v in kv])
    out = distinct_profile(df, list(types), approximate).withColumn("type", F.element_at(kinds, F.col("column")))
    # the joined tables have one row per column
    out = out.join(F.broadcast(column_stats(df, numeric)), "column", "left")
    return out.join(F.broadcast(quartiles(df.select(*numeric), numeric)), "column", "left")


def outlier_bounds(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Interquartile-range fences and the rows outside them, all derived from distinct-value counts."""
    counts = value_counts_long(df, [column])
    q = quartiles(df, [column]).withColumns({
        "low": F.col("q25") - k * (F.col("q75") - F.col("q25")),
        "high": F.col("q75") + k * (F.col("q75") - F.col("q25")),
    })
    joined = counts.join(F.broadcast(q), counts["feature"] == q["column"])
    return joined.groupBy("column", "q25", "q75", "low", "high").agg(
        F.sum(F.when(F.col("value") < F.col("low"), F.col("n")).otherwise(0)).alias("n_below"),
        F.sum(F.when(F.col("value") > F.col("high"), F.col("n")).otherwise(0)).alias("n_above"),
        F.sum("n").alias("n"),
    ).withColumn("pct_outliers", ratio(F.col("n_below") + F.col("n_above"), "n") * 100)


def low_variance(df: DataFrame, columns: Sequence[str], limit: float = 0.01) -> DataFrame:
    stats = column_stats(df, columns).select("column", "variance")
    return stats.withColumn("is_low", (F.col("variance") < limit).cast("int"))
