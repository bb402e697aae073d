"""Money: cost matrix, savings, break-even figures and key figures of the data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.functions.columns import ratio
from fareflow.schemas import FEATURES

# Benefits and costs per outcome, in dollars.
GAIN_TP, COST_FP, COST_FN, GAIN_TN = 15, 5, 20, 0
RIDE_VALUE, SUCCESS_RATE, PROFIT_TP = 20, 0.5, 10


def outcome_value(y: Column, pred: Column) -> Column:
    """Value of one decision under the cost matrix."""
    return (F.when((y == 1) & (pred == 1), GAIN_TP).when((y == 0) & (pred == 1), -COST_FP)
            .when((y == 1) & (pred == 0), -COST_FN).otherwise(GAIN_TN))


def net_value(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Rows and net value per confusion cell."""
    v = outcome_value(F.col(y), F.col(pred))
    return df.groupBy(y, pred).agg(F.count("*").alias("n"), F.sum(v).cast("bigint").alias("net_value"))


def impact(cells: DataFrame, n_days: Column | int) -> DataFrame:
    """All documented savings formulas next to each other, from tp, fp, fn, tn."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    days = F.lit(n_days) if isinstance(n_days, int) else n_days
    return cells.withColumns({
        "gross_savings": tp * RIDE_VALUE,
        "false_alarm_cost": fp * COST_FP,
        "missed_cancellation_cost": fn * COST_FN,
        "net_cost_matrix": tp * GAIN_TP - fp * COST_FP - fn * COST_FN,
        "net_gross": tp * RIDE_VALUE - fp * COST_FP - fn * COST_FN,
        "expected_savings": tp * F.lit(RIDE_VALUE * SUCCESS_RATE) - fp * COST_FP,
        "expected_savings_annual": ratio((tp * F.lit(RIDE_VALUE * SUCCESS_RATE) - fp * COST_FP) * 365, days),
        "profit": tp * PROFIT_TP - fp * COST_FP,
        "interventions_daily": ratio(tp + fp, days),
        "roi_pct": ratio(tp * PROFIT_TP - fp * COST_FP, fp * COST_FP) * 100,
    })


def break_even(cells: DataFrame, savings_target: float = 100_000, precision: float = 0.60,
               success: float = SUCCESS_RATE) -> DataFrame:
    """Break-even precision, false alarms implied by a precision, hits and recall needed for a goal."""
    positives = F.col("tp") + F.col("fn")
    per_hit = RIDE_VALUE * success - COST_FP * (1 - precision) / precision
    return cells.select(
        F.lit(COST_FP / (COST_FP + RIDE_VALUE)).alias("break_even_precision"),
        (F.col("tp") * F.lit((1 - precision) / precision)).alias("fp_at_precision"),
        F.lit(per_hit).alias("savings_per_hit"),
        F.lit(savings_target / per_hit).alias("required_tp"),
        ratio(F.lit(savings_target / per_hit), positives).alias("required_recall"),
    )


def dataset_overview(df: DataFrame, split: str = "split", target: str = "is_cancelled",
                     location: str = "pickup_location", vehicle: str = "vehicle_type") -> DataFrame:
    """Key figures as rows (metric, value), from one aggregation."""
    cancelled = F.sum(target)
    part = lambda s: F.count_if(F.col(split) == s)
    wide = df.agg(
        F.count("*").alias("total_bookings"),
        (ratio(cancelled, F.count(target)) * 100).alias("cancellation_rate"),
        cancelled.alias("cancelled_rides"),
        (cancelled * RIDE_VALUE).alias("lost_revenue"),
        F.count_distinct(location).alias("unique_locations"),
        F.count_distinct(vehicle).alias("vehicle_types"),
        part("train").alias("train_size"), part("val").alias("val_size"), part("test").alias("test_size"),
    ).withColumns({"features_engineered": F.lit(len(FEATURES)), "cost_asymmetry": F.lit(COST_FN / COST_FP)})
    names = wide.columns
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return wide.select(F.inline(rows)).withColumn("label", kpi_label("metric", "value"))


def kpi_label(metric: str, value: str) -> Column:
    whole = F.format_number(F.col(value), 0)
    return (F.when(F.col(metric) == "cancellation_rate", F.concat(F.col(value).cast("bigint").cast("string"), F.lit("%")))
            .when(F.col(metric) == "lost_revenue", F.concat(F.lit("$"), whole))
            .when(F.col(metric) == "cost_asymmetry", F.concat(F.col(value).cast("bigint").cast("string"), F.lit(":1")))
            .otherwise(whole))
