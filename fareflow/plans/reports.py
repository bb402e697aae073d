"""The 17 report tables, filled by aggregation over transformed bookings and model results.

``features`` below is the output of the feature chain (all columns). Rates are percentages with one
decimal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareflow.functions.columns import binned, ratio
from fareflow.operators.association import cramers_matrix, target_correlations
from fareflow.operators.business import dataset_overview, impact
from fareflow.operators.counts import group_rate, value_shares
from fareflow.operators.evaluation import REPORT_GRID, compare_models, threshold_sweep
from fareflow.operators.rank_stats import binned_mutual_information

# Report bins, names and feature lists.
WAIT_EDGES = [2, 5, 8, 10, 12, 15, 18, 20]
WAIT_LABELS = ["2-5 min", "5-8 min", "8-10 min", "10-12 min", "12-15 min", "15-18 min", "18-20 min"]
BUCKET_EDGES = [0, 5, 10, 15, 20]
BUCKET_LABELS = ["0-5 min", "5-10 min", "10-15 min", "15-20 min"]
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
MI_FEATURES = ["avg_vtat_imputed", "is_high_vtat", "is_peak_hour", "pickup_encoded", "drop_encoded",
               "vehicle_type_encoded", "hour", "dayofweek", "month", "is_weekend", "is_late_night"]
CORRELATION_FEATURES = ["avg_vtat_imputed", "is_high_vtat", "vtat_bucket", "pickup_encoded", "drop_encoded",
                        "hour", "is_peak_hour", "dayofweek", "is_weekend", "month"]
CRAMERS_PAIRS = [("vtat_bucket", "is_high_vtat"), ("vtat_bucket", "is_cancelled"), ("is_high_vtat", "is_cancelled"),
                 ("vehicle_type", "is_cancelled"), ("is_weekend", "is_cancelled"), ("is_peak_hour", "is_cancelled")]


def _pct(c: str | Column) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 100, 1)


def _named(c: str, names: Sequence[str], first: int = 0) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) - first + 1)


def target_distribution(df: DataFrame) -> DataFrame:
    shares = value_shares(df, "is_cancelled")
    return shares.select(F.when(F.col("is_cancelled") == 1, "Cancelled").otherwise("Completed").alias("outcome"),
                         F.col("n").alias("count"), _pct("share").alias("percentage"))


def vehicle_type(df: DataFrame) -> DataFrame:
    return group_rate(df, ["vehicle_type"]).select(
        "vehicle_type", F.col("total").alias("total_rides"), _pct("cancel_rate").alias("cancellation_rate"))


def _ranges(df: DataFrame, edges: Sequence, labels: Sequence[str], column: str, lowest: bool) -> DataFrame:
    order = binned("avg_vtat", edges, list(range(1, len(labels) + 1)), include_lowest=lowest)
    g = group_rate(df.withColumn("bucket_order", order), ["bucket_order"])
    return g.select(_named("bucket_order", labels, 1).alias(column), F.col("total").alias("count"),
                    _pct("cancel_rate").alias("cancellation_rate"), "bucket_order")


def vtat_distribution(df: DataFrame) -> DataFrame:
    return _ranges(df, WAIT_EDGES, WAIT_LABELS, "vtat_range", True)


def vtat_buckets(df: DataFrame) -> DataFrame:
    return _ranges(df, BUCKET_EDGES, BUCKET_LABELS, "vtat_bucket", False).withColumnRenamed("count", "sample_count")


def temporal(df: DataFrame, key: str) -> DataFrame:
    return group_rate(df, [key]).select(
        key, F.col("total").alias("booking_volume"), _pct("cancel_rate").alias("cancellation_rate"))


def hourly(df: DataFrame) -> DataFrame:
    return temporal(df, "hour")


def daily(df: DataFrame) -> DataFrame:
    return temporal(df, "dayofweek").withColumnRenamed("dayofweek", "day_order").withColumn(
        "day_name", _named("day_order", DAY_NAMES))


def monthly(df: DataFrame) -> DataFrame:
    return temporal(df, "month").withColumnRenamed("month", "month_order").withColumn(
        "month_name", _named("month_order", MONTH_NAMES, 1))


def top_locations(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k locations with the highest rate; the exact rate decides, then the name."""
    top = group_rate(df, [column]).orderBy(F.col("cancel_rate").desc(), F.col(column).asc()).limit(k)
    rank = F.row_number().over(Window.orderBy(F.col("cancel_rate").desc(), F.col(column).asc()))  # k rows
    return top.select(F.col(column).alias("location"), _pct("cancel_rate").alias("cancellation_rate"),
                      F.col("total").alias("volume"), rank.alias("rank_order"))


def feature_mi(df: DataFrame, features: Sequence[str] = MI_FEATURES) -> DataFrame:
    mi = binned_mutual_information(df, features, few_values=True)  # hours, codes, flags, waits of one decimal
    value = F.round("mutual_information", 4)
    return mi.select("feature", value.alias("mutual_information"), F.row_number().over(  # one row per feature
        Window.orderBy(value.desc(), "feature")).alias("rank_order"))


def cramers(df: DataFrame, pairs: Sequence[tuple[str, str]] = CRAMERS_PAIRS) -> DataFrame:
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    m = cramers_matrix(df, columns)
    name = F.concat_ws(" vs ", "feature_a", "feature_b")
    return m.select(name.alias("feature_pair"), F.round("cramers_v", 3).alias("cramers_v")).where(
        F.col("feature_pair").isin([f"{a} vs {b}" for a, b in pairs]))


def correlation_target(df: DataFrame, features: Sequence[str] = CORRELATION_FEATURES) -> DataFrame:
    c = target_correlations(df, features)
    return c.select("feature", (F.round("correlation", 3) + F.lit(0.0)).alias("correlation"),
                    F.round("abs_correlation", 3).alias("abs_correlation"))


def model_comparison(metrics: DataFrame, selected: str) -> DataFrame:
    """``metrics``: one row per model with test metrics and optimal_threshold."""
    out = compare_models(metrics, selected)
    return out.withColumns({c: F.round(c, 4) for c in ("f2_score", "recall", "precision_score", "pr_auc", "roc_auc")}
                           | {"optimal_threshold": F.round("optimal_threshold", 2)})


def business_impact(cells: DataFrame, n_days: Column | int) -> DataFrame:
    """``cells``: tp, fp, fn, tn of the selected model, one row."""
    m = impact(cells, n_days)
    money = lambda c, rule: F.concat(F.lit("$"), F.format_number(F.col(c), 0), F.lit(rule))
    count = lambda c, what: F.concat(F.format_number(F.col(c), 0), F.lit(what))
    rows = [
        ("true_positives", "tp", count("tp", " rides correctly flagged")),
        ("false_positives", "fp", count("fp", " false alarms")),
        ("false_negatives", "fn", count("fn", " missed cancellations")),
        ("true_negatives", "tn", count("tn", " correct non-flags")),
        ("gross_savings", "gross_savings", money("gross_savings", " (TP x $20)")),
        ("false_alarm_cost", "false_alarm_cost", money("false_alarm_cost", " (FP x $5)")),
        ("missed_cancellation_cost", "missed_cancellation_cost", money("missed_cancellation_cost", " (FN x $20)")),
        ("net_annual_savings", "expected_savings_annual", money("expected_savings_annual", "")),
        ("roi_percentage", "roi_pct", F.concat(F.format_number(F.col("roi_pct"), 0), F.lit("%"))),
        ("intervention_volume_daily", "interventions_daily",
         F.concat(F.lit("~"), F.format_number(F.col("interventions_daily"), 0), F.lit(" rides/day flagged"))),
    ]
    made = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value"), lab.alias("label"))
                     for n, c, lab in rows])
    return m.select(F.inline(made))


def model_thresholds(scored: DataFrame, y: str, score: str, by: str = "model_name") -> DataFrame:
    """Real metric curves on the 19-point grid, per model."""
    s = threshold_sweep(scored, y, score, [by], REPORT_GRID)
    return s.select(by, F.round("threshold", 2).alias("threshold"), F.round("f_beta", 4).alias("f2_score"),
                    F.round("recall", 4).alias("recall"), F.round("precision", 4).alias("precision_score"))


def data_reports(features: DataFrame) -> dict[str, DataFrame]:
    """The tables that need no model."""
    return {
        "dataset_overview": dataset_overview(features),
        "univar_target_distribution": target_distribution(features),
        "univar_vehicle_type": vehicle_type(features),
        "univar_vtat_distribution": vtat_distribution(features),
        "univar_temporal_hourly": hourly(features),
        "univar_temporal_daily": daily(features),
        "univar_temporal_monthly": monthly(features),
        "bivar_vtat_buckets": vtat_buckets(features),
        "bivar_location_pickup": top_locations(features, "pickup_location"),
        "bivar_location_drop": top_locations(features, "drop_location"),
        "bivar_feature_importance_mi": feature_mi(features),
        "bivar_cramers_v": cramers(features),
        "bivar_correlation_target": correlation_target(features),
    }


def model_reports(metrics: DataFrame, scored: DataFrame, importances: DataFrame, cells: DataFrame, n_days: Column | int,
                  selected: str, y: str = "is_cancelled", score: str = "probability_1") -> dict[str, DataFrame]:
    """``scored`` holds (model_name, y, score) rows of all models."""
    return {
        "model_comparison": model_comparison(metrics, selected),
        "model_feature_importance": importances.where(F.col("rank_order") <= 10),
        "model_business_impact": business_impact(cells, n_days),
        "model_thresholds": model_thresholds(scored, y, score),
    }
