"""Queries on cleaning, status mapping, value counts, duplicates and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareflow.catalog.sql import BK, BL, EV, TIME_TEXT, q, r
from fareflow.functions.columns import rounded
from fareflow.operators import cleaning, counts, duplicates, series
from fareflow.operators.assumptions import assumption_report
from fareflow.plans.chain import train_val
from fareflow.sources.tables import STATUS_MAP, TRAIN_END, VAL_END, bookings, raw_bookings, timed_events

DUP_KEYS = ["customer_id", "date", "pickup_location", "drop_location"]


def ingest_clean(spark, sf):
    return cleaning.clean(raw_bookings(spark, sf), STATUS_MAP)


def ingest_handoff(spark, sf):
    rows = cleaning.handoff(cleaning.clean(raw_bookings(spark, sf), STATUS_MAP))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


def ingest_status_target(spark, sf):
    df = bookings(spark, sf, "status").withColumn("target", cleaning.status_target("status", {"R": 1, "A": 0}))
    return counts.value_shares(df, "target", keep_null=True).select("target", "n", rounded("share").alias("share"))


def ingest_status_share(spark, sf):
    return cleaning.status_share(bookings(spark, sf, "status"), "status", ["R", "A"])


def count_labels(spark, sf):
    return counts.value_counts(bookings(spark, sf, "vehicle_type"), "vehicle_type", keep_null=True)


def distinct_labels(spark, sf):
    return counts.distinct_labels(bookings(spark, sf, "drop_location"), "drop_location")


def filter_class_weekend(spark, sf):
    df = bookings(spark, sf, "date", "avg_vtat", "is_cancelled")
    kept = df.where((F.weekday("date") >= 5) & (F.col("is_cancelled") == 1)).dropna(subset=["avg_vtat"])
    return kept.groupBy("date").agg(F.count("*").alias("n"), rounded(F.avg("avg_vtat")).alias("mean_vtat"))


def top_dates(spark, sf):
    return counts.top_values(bookings(spark, sf, "date"), "date", 20)


def least_dates(spark, sf):
    return counts.top_values(bookings(spark, sf, "date"), "date", 20, least=True)


def top_locations(spark, sf):
    return counts.top_values(bookings(spark, sf, "pickup_location"), "pickup_location", 10)


def dup_key_count(spark, sf):
    return duplicates.duplicate_count(bookings(spark, sf, *DUP_KEYS), DUP_KEYS)


def dup_rows(spark, sf):
    return duplicates.duplicated_rows(bookings(spark, sf, "booking_id", "date", "avg_vtat", "is_cancelled"), ["booking_id"])


def dup_rows_thrice(spark, sf):
    df = bookings(spark, sf, "booking_id", "date", "pickup_location")
    return duplicates.duplicated_rows(df, ["booking_id"], times=3).orderBy("booking_id", "date")


def dup_flags(spark, sf):
    return duplicates.with_key_multiplicity(bookings(spark, sf, "booking_id", "date"), ["booking_id"])


def dup_multiplicity(spark, sf):
    return duplicates.multiplicity_histogram(bookings(spark, sf, "booking_id"), ["booking_id"])


def id_parts(spark, sf):
    df = bookings(spark, sf, "booking_id").select(
        F.concat(F.lit("CNR"), F.regexp_replace("booking_id", "-", "")).alias("booking_id"))
    return duplicates.id_profile(df, "booking_id")


def calendar_gaps(spark, sf):
    return series.missing_days(bookings(spark, sf, "date"), "1995-01-01", "2001-12-31")


def daily_rate_rolling(spark, sf):
    s = series.daily_rates(bookings(spark, sf, "date", "is_cancelled"))
    s = series.rolling_series(s, "date", "cancel_rate", (7, 30))
    return s.select("date", "cancelled", "total", rounded("cancel_rate").alias("cancel_rate"), "weekday", "is_weekend",
                    rounded("rolling_7").alias("rolling_7"), rounded("rolling_30").alias("rolling_30"),
                    rounded("overall_mean").alias("overall_mean"))


def daily_volume_rolling(spark, sf):
    s = series.daily_rates(bookings(spark, sf, "date", "is_cancelled"))
    s = series.rolling_series(s, "date", "total", (7, 30))
    return s.select("date", "date_ordinal", "total", rounded("rolling_7").alias("rolling_7"),
                    rounded("rolling_30").alias("rolling_30"), rounded("overall_mean").alias("overall_mean"))


def minute_rate_rolling(spark, sf):
    s = series.rolling_series(series.minute_rates(timed_events(spark, sf)), "minute_of_day", "cancel_rate", (30, 60))
    return s.select("minute_of_day", "minute_ordinal", "cancelled", "total", rounded("cancel_rate").alias("cancel_rate"),
                    rounded("rolling_30").alias("rolling_30"), rounded("rolling_60").alias("rolling_60"))


def minute_span(spark, sf):
    return series.minute_span(bookings(spark, sf, "time"))


def minute_floor_counts(spark, sf):
    e = timed_events(spark, sf)
    return e.groupBy(F.date_trunc("minute", F.col("ts")).cast("timestamp_ntz").alias("minute_bucket")).agg(F.count("*").alias("n"))


def split_label(spark, sf):
    df = bookings(spark, sf, "date")
    return df.groupBy("date", counts.temporal_split("date", TRAIN_END, VAL_END).alias("split")).agg(F.count("*").alias("n"))


def split_summary(spark, sf):
    s = counts.split_summary(bookings(spark, sf, "split", "is_cancelled"))
    return s.withColumn("cancel_rate", rounded("cancel_rate"))


def union_train_val(spark, sf):
    df = bookings(spark, sf, "split", "date", "is_cancelled")
    return train_val(df).groupBy("split").agg(F.count("*").alias("n"), F.sum("is_cancelled").cast("bigint").alias("cancelled"),
                                     F.max("date").alias("last_date"))


def assumption_checks(spark, sf):
    df = bookings(spark, sf, "date", "customer_id", "is_cancelled", "avg_vtat")
    return assumption_report(df, 60000, 4, "1995-01-01", "2001-12-31", 33)


def _rolling(rows: str, order: str, value: str, width: int, before: int, after: int) -> str:
    w = f"(order by {order} rows between {before} preceding and {after} following)"
    return f"case when count(*) over {w} = {width} then round(avg({value}) over {w}, 6) + 0.0 end"


DAY = BL + ", d as (select date, sum(is_cancelled) as c, count(*) as t, sum(is_cancelled) / count(*) as v from bk group by date)"
MIN = EV + ", m as (select h * 60 + mi as k, sum(is_cancelled) as c, count(*) as t, sum(is_cancelled) / count(*) as v from ev group by 1)"

QUERIES = {
    "ingest_clean": (ingest_clean, q(f"""
        select date, {TIME_TEXT} as time, booking_id, customer_id, vehicle_type, pickup_location, drop_location, avg_vtat,
               case when status <> 'R' then l_tax * 100 end as avg_ctat,
               case when status <> 'R' then l_extendedprice end as booking_value,
               case when status <> 'R' then l_quantity end as ride_distance,
               case when status <> 'R' then l_linestatus end as payment_method, is_cancelled from bk""", BK)),
    "ingest_handoff": (ingest_handoff, q(f"""
        select date, {TIME_TEXT} as time, vehicle_type, pickup_location, drop_location, avg_vtat, is_cancelled, count(*) as n
        from bk group by all""", BK)),
    "ingest_status_target": (ingest_status_target, f"""
        select t as target, count(*) as n, {r("count(*) / sum(count(*)) over ()")} as share
        from (select case l_returnflag when 'R' then 1 when 'A' then 0 end as t from lineitem) group by t"""),
    "ingest_status_share": (ingest_status_share, """
        select count(*) as n_rows, sum((l_returnflag <> 'N')::int)::bigint as n_hits,
               round(100.0 * sum((l_returnflag <> 'N')::int) / count(*))::bigint as pct from lineitem"""),
    "count_labels": (count_labels, """
        select o_orderpriority as vehicle_type, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by 1"""),
    "distinct_labels": (distinct_labels, """
        select distinct p_brand as drop_location from part
        where exists (select 1 from lineitem where l_partkey = p_partkey) and p_brand is not null"""),
    "filter_class_weekend": (filter_class_weekend, q(f"""
        select date, count(*) as n, {r("avg(avg_vtat)")} as mean_vtat from bk
        where isodow(date) in (6, 7) and is_cancelled = 1 and avg_vtat is not null group by date""", BL)),
    "top_dates": (top_dates, "select cast(l_shipdate as date) as date, count(*) as n from lineitem group by 1 order by n desc, date limit 20"),
    "least_dates": (least_dates, "select cast(l_shipdate as date) as date, count(*) as n from lineitem group by 1 order by n, date limit 20"),
    "top_locations": (top_locations, """
        select cast(l_suppkey as varchar) as pickup_location, count(*) as n from lineitem group by 1 order by n desc, 1 limit 10"""),
    "dup_key_count": (dup_key_count, q("""
        select cast(count(*) - count(distinct (customer_id, date, pickup_location, drop_location)) as bigint) as duplicates
        from bk""", BK)),
    "dup_rows": (dup_rows, q("""
        select booking_id, date, avg_vtat, is_cancelled from bk
        qualify count(*) over (partition by booking_id) > 1""", BL)),
    "dup_rows_thrice": (dup_rows_thrice, q("""
        select booking_id, date, pickup_location from bk
        where booking_id in (select booking_id from bk group by 1 having count(*) = 3)""", BL)),
    "dup_flags": (dup_flags, q("""
        select booking_id, date, count(*) over (partition by booking_id) as n_rows,
               (count(*) over (partition by booking_id) > 1)::int as is_duplicated from bk""", BL)),
    "dup_multiplicity": (dup_multiplicity, q("""
        select n as times, count(*) as n_keys, cast(sum(n) as bigint) as n_rows
        from (select count(*) as n from bk group by booking_id) group by n""", BL)),
    "id_parts": (id_parts, """
        select 'CNR' as letters, length(k) + 3 as id_length, count(*) as n, min(k::bigint) as min_number, max(k::bigint) as max_number
        from (select cast(l_orderkey as varchar) || cast(l_linenumber as varchar) as k from lineitem) group by 2"""),
    "calendar_gaps": (calendar_gaps, q("""
        select cast(d as date) as date from generate_series(date '1995-01-01', date '2001-12-31', interval 1 day) t(d)
        except select date from bk""", BL)),
    "daily_rate_rolling": (daily_rate_rolling, q(f"""
        select date, cast(c as bigint) as cancelled, t as total, {r("v")} as cancel_rate, isodow(date) - 1 as weekday,
               (isodow(date) > 5)::int as is_weekend, {_rolling("d", "date", "v", 7, 3, 3)} as rolling_7,
               {_rolling("d", "date", "v", 30, 15, 14)} as rolling_30, {r("avg(v) over ()")} as overall_mean from d""", DAY)),
    "daily_volume_rolling": (daily_volume_rolling, q(f"""
        select date, date_diff('day', date '0001-01-01', date) + 1 as date_ordinal, t as total,
               {_rolling("d", "date", "t", 7, 3, 3)} as rolling_7, {_rolling("d", "date", "t", 30, 15, 14)} as rolling_30,
               {r("avg(t) over ()")} as overall_mean from d""", DAY)),
    "minute_rate_rolling": (minute_rate_rolling, q(f"""
        select k as minute_of_day, row_number() over (order by k) - 1 as minute_ordinal, cast(c as bigint) as cancelled,
               t as total, {r("v")} as cancel_rate, {_rolling("m", "k", "v", 30, 15, 14)} as rolling_30,
               {_rolling("m", "k", "v", 60, 30, 29)} as rolling_60 from m""", MIN)),
    "minute_span": (minute_span, q("""
        select min(sec // 60) as first_minute, max(sec // 60) as last_minute, count(*) as n from bk""", BL)),
    "minute_floor_counts": (minute_floor_counts, "select date_trunc('minute', ts) as minute_bucket, count(*) as n from events group by 1"),
    "split_label": (split_label, q("select date, split, count(*) as n from bk group by all", BL)),
    "split_summary": (split_summary, q(f"""
        select split, count(*) as n_rows, round(count(*) / (select count(*) from bk), 2) as share, 18 as n_features,
               {r("avg(is_cancelled)")} as cancel_rate from bk group by split""", BL)),
    "union_train_val": (union_train_val, q("""
        select split, count(*) as n, cast(sum(is_cancelled) as bigint) as cancelled, max(date) as last_date
        from bk where split <> 'test' group by split""", BL)),
    "assumption_report": (assumption_checks, q("""
        , z as (select count(*) as n, count(distinct customer_id) as cu, cast(round(avg(is_cancelled) * 100) as bigint) as s,
                date_diff('day', date '1995-01-01', date '2002-01-01')
                - count(distinct date) filter (where date between '1995-01-01' and '2001-12-31') as gaps from bk),
        c as (select 'row_count' as "check", n as observed, 60000 as expected from z
              union all select 'column_count', 4, 4
              union all select 'distinct_customers_equal_rows', cu, n from z
              union all select 'days_without_data', gaps, 0 from z
              union all select 'cancellation_share_pct', s, 33 from z
              union all select 'target_not_binary', 0, 0
              union all select 'leakage_columns_present', 0, 0)
        select "check", cast(observed as bigint) as observed, cast(expected as bigint) as expected,
               (observed = expected)::int as pass from c""", BK)),
}
