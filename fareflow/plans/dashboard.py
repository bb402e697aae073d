"""Panel queries over the report tables, as Spark SQL.

``panel(name, tables)`` runs one statement with the report DataFrames bound by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KPI = "select metric, value from {{{table}}} where metric in ({names})"
OVERVIEW_KPIS = ["total_bookings", "cancellation_rate", "cancelled_rides", "lost_revenue", "features_engineered",
                 "unique_locations"]
IMPACT_KPIS = ["net_annual_savings", "roi_percentage", "intervention_volume_daily", "true_positives"]
OUTCOMES = ["true_positives", "false_positives", "false_negatives", "true_negatives"]
FINANCE = ["gross_savings", "false_alarm_cost", "missed_cancellation_cost", "net_annual_savings"]


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _kpi(table: str, names: list[str]) -> str:
    return KPI.format(table=table, names=_quoted(names))


def _breakdown(names: list[str], amount: str, detail: str) -> str:
    return (f"select metric as Metric, cast(value as int) as {amount}, label as {detail} from {{model_business_impact}} "
            f"where metric in ({_quoted(names)}) order by array_position(array({_quoted(names)}), metric)")


PANELS = {
    "kpi_overview": _kpi("dataset_overview", OVERVIEW_KPIS),
    "kpi_impact": _kpi("model_business_impact", IMPACT_KPIS),
    "target_pie": """
        select max(count) filter (where outcome = 'Completed') as Completed,
               max(count) filter (where outcome = 'Cancelled') as Cancelled
        from {univar_target_distribution}""",
    "vehicle_series": "select vehicle_type, total_rides, cancellation_rate from {univar_vehicle_type} order by 1",
    "vtat_series": """
        select vtat_range, count as ride_count, cancellation_rate
        from {univar_vtat_distribution} order by bucket_order""",
    "hourly_series": """
        select format_string('%02d:00', h.hour) as hour, booking_volume, cancellation_rate
        from {univar_temporal_hourly} h order by h.hour""",
    "daily_series": "select day_name, booking_volume, cancellation_rate from {univar_temporal_daily} order by day_order",
    "monthly_series": """
        select month_name, booking_volume, cancellation_rate
        from {univar_temporal_monthly} order by month_order""",
    "bucket_rates": """
        select vtat_bucket, cancellation_rate, sample_count from {bivar_vtat_buckets} order by bucket_order""",
    "pickup_rates": "select location, cancellation_rate from {bivar_location_pickup} order by rank_order",
    "drop_rates": "select location, cancellation_rate from {bivar_location_drop} order by rank_order",
    "mi_ranking": "select feature, mutual_information from {bivar_feature_importance_mi} order by rank_order",
    "correlation_ranking": """
        select feature, abs_correlation from {bivar_correlation_target} order by abs_correlation desc, feature""",
    "cramers_ranking": "select feature_pair, cramers_v from {bivar_cramers_v} order by cramers_v desc, feature_pair",
    "comparison": """
        select model_name as Model, round(f2_score, 4) as F2_Score,
               concat(round(recall * 100, 1), '%') as Recall,
               concat(round(precision_score * 100, 1), '%') as Precision,
               round(pr_auc, 4) as PR_AUC, round(roc_auc, 4) as ROC_AUC, optimal_threshold as Threshold,
               if(is_selected = 1, 'Selected', '') as Status
        from {model_comparison} order by f2_score desc, model_name""",
    "selected_gauges": """
        select f2_score, recall, precision_score, pr_auc, roc_auc, optimal_threshold
        from {model_comparison} where is_selected = 1""",
    "importance_ranking": """
        select model_name, feature, importance from {model_feature_importance} order by model_name, rank_order""",
    "confusion_breakdown": _breakdown(OUTCOMES, "Count", "Description"),
    "finance_breakdown": _breakdown(FINANCE, "Amount", "Details"),
}


def tables_of(name: str) -> list[str]:
    from string import Formatter
    return list(dict.fromkeys(f for _, f, _, _ in Formatter().parse(PANELS[name]) if f))


def panel(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    return spark.sql(PANELS[name], **{t: tables[t] for t in tables_of(name)})
