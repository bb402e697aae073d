"""Queries on feature groups and the fitted chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareflow.catalog.sql import BK, BL, FT, q, r
from fareflow.functions.columns import rounded
from fareflow.operators import features as ft
from fareflow.plans.chain import residual_nulls, run_chain, silver
from fareflow.scale import checkpointed
from fareflow.schemas import FEATURES
from fareflow.sources.tables import TRAIN_END, VAL_END, bookings, timed_events

CYCLES = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
CHAIN_INPUT = ["date", "time", "booking_id", "vehicle_type", "pickup_location", "drop_location", "avg_vtat", "is_cancelled"]


def chain_features(spark, sf, *more):
    """Bookings through the fitted chain; the base of the reporting queries."""
    return run_chain(bookings(spark, sf, *CHAIN_INPUT, *more), TRAIN_END, VAL_END)


def _train(spark, sf, *columns):
    return bookings(spark, sf, *columns, "split").where("split = 'train'")


def feat_temporal(spark, sf):
    e = ft.add_temporal(timed_events(spark, sf))
    return e.select("event_id", "hour", "dayofweek", "month", "day", "is_weekend", "is_morning_rush", "is_evening_rush",
                    "is_peak_hour", "is_late_night", *[rounded(c).alias(c) for c in CYCLES])


def feat_calendar(spark, sf):
    e = ft.add_calendar(bookings(spark, sf, "date"))
    return e.groupBy("date", "weekday", "month", "day_of_month", "week_of_year", "quarter").agg(F.count("*").alias("n"))


def feat_flags(spark, sf):
    e = ft.add_hour_flags(timed_events(spark, sf).withColumn("hour", F.hour("ts")))
    return e.select("event_id", "hour", "is_night", "is_business", "is_rush")


def feat_vtat(spark, sf):
    medians = checkpointed(ft.fit_vtat(_train(spark, sf, "vehicle_type", "avg_vtat")))
    df = ft.add_vtat(bookings(spark, sf, "booking_id", "date", "vehicle_type", "avg_vtat"), medians)
    return df.select("booking_id", "date", "vehicle_type", rounded("avg_vtat_imputed").alias("avg_vtat_imputed"),
                     "vtat_bucket", "is_high_vtat")


def feat_vtat_medians(spark, sf):
    return ft.fit_vtat(_train(spark, sf, "vehicle_type", "avg_vtat"))


def feat_vtat_zone(spark, sf):
    df = ft.add_vtat_zone(bookings(spark, sf, "avg_vtat"))
    return df.groupBy("avg_vtat", "vtat_zone", "is_instant_arrival", "is_timeout", "is_long_wait",
                      ft.named_zone().alias("zone")).agg(F.count("*").alias("n"))


def feat_missing(spark, sf):
    df = ft.add_vtat_missing(bookings(spark, sf, "avg_vtat", "is_cancelled"))
    return df.groupBy("vtat_missing", "is_cancelled").agg(F.count("*").alias("n"))


def feat_global_median(spark, sf):
    df = ft.add_vtat_global(bookings(spark, sf, "avg_vtat"))
    return df.groupBy("avg_vtat_imputed").agg(F.count("*").alias("n"))


def feat_topn(spark, sf):
    counts = ft.location_counts(_train(spark, sf, "pickup_location", "is_cancelled"), "pickup_location")
    df = ft.grouped_location(bookings(spark, sf, "pickup_location"), "pickup_location", ft.top_locations(counts))
    return df.groupBy("pickup_location_grouped").agg(F.count("*").alias("n"))


def feat_target_enc(spark, sf):
    counts = ft.location_counts(_train(spark, sf, "drop_location", "is_cancelled"), "drop_location")
    encoding = checkpointed(ft.fit_target_encoding(counts))
    df = ft.add_target_encoding(bookings(spark, sf, "drop_location"), "drop_location", "drop_encoded", encoding)
    return df.groupBy("drop_location", rounded("drop_encoded").alias("drop_encoded")).agg(F.count("*").alias("n"))


def feat_label_enc(spark, sf):
    labels = checkpointed(ft.fit_labels(_train(spark, sf, "vehicle_type")))
    df = ft.add_label_code(bookings(spark, sf, "vehicle_type"), labels)
    return df.groupBy("vehicle_type", "vehicle_type_encoded").agg(F.count("*").alias("n"))


def feat_chain(spark, sf):
    features, _ = chain_features(spark, sf)
    out = silver(features, "booking_id")
    return out.select("booking_id", "split", "is_cancelled", *[
        rounded(c).alias(c) if c in CYCLES or c.endswith("_encoded") and c != "vehicle_type_encoded" or c == "avg_vtat_imputed"
        else F.col(c) for c in FEATURES])


def feat_chain_state(spark, sf):
    _, model = chain_features(spark, sf)
    return model.state.select("artifact", "key", rounded("value").alias("value"))


def feat_residual_nulls(spark, sf):
    features, _ = chain_features(spark, sf)
    return residual_nulls(features).select("column", "n_missing", "pct_missing")


def vtat_bucket_rates(spark, sf):
    """The flagship question: does waiting time drive cancellation?"""
    from fareflow.operators.counts import group_rate
    medians = checkpointed(ft.fit_vtat(_train(spark, sf, "vehicle_type", "avg_vtat")))
    df = ft.add_vtat(bookings(spark, sf, "vehicle_type", "avg_vtat", "is_cancelled"), medians)
    out = group_rate(df, ["vtat_bucket"])
    return out.select("vtat_bucket", "cancelled", "total", rounded("cancel_rate").alias("cancel_rate")).orderBy("vtat_bucket")


BUCKET = ("case when X > 15 and X <= 20 then 3.0 when X > 10 and X <= 15 then 2.0 when X > 5 and X <= 10 then 1.0 "
          "when X > 0 and X <= 5 then 0.0 end::double")
MEDIANS = """tr as (select * from bk where split = 'train'),
med as (select vehicle_type as v, median(avg_vtat) as m from tr group by 1), gm as (select median(avg_vtat) as m from tr)"""
IMPUTED = "coalesce(bk.avg_vtat, med.m, gm.m)"
TOP = """tr as (select * from bk where split = 'train'),
top as (select pickup_location as k from tr group by 1 order by count(*) desc, 1 limit 10)"""
MISSING_SQL = " union all ".join(
    f"select '{c}' as \"column\", count(*) - count({c}) as n_missing, round(100 * (count(*) - count({c})) / count(*), 2) as pct_missing from ft"
    for c in FEATURES)
HH, DD, MM = "extract(hour from ts)", "(isodow(ts) - 1)", "extract(month from ts)"

QUERIES = {
    "feat_temporal": (feat_temporal, f"""
        select event_id, {HH} as hour, {DD} as dayofweek, {MM} as month, extract(day from ts) as day,
               (isodow(ts) > 5)::int as is_weekend, ({HH} in (7, 8, 9, 10))::int as is_morning_rush,
               ({HH} in (17, 18, 19, 20, 21))::int as is_evening_rush,
               ({HH} in (7, 8, 9, 10, 17, 18, 19, 20, 21))::int as is_peak_hour,
               ({HH} > 22 or {HH} < 6)::int as is_late_night,
               {r(f"sin(2 * pi() * {HH} / 24)")} as hour_sin, {r(f"cos(2 * pi() * {HH} / 24)")} as hour_cos,
               {r(f"sin(2 * pi() * {DD} / 7)")} as dow_sin, {r(f"cos(2 * pi() * {DD} / 7)")} as dow_cos,
               {r(f"sin(2 * pi() * {MM} / 12)")} as month_sin, {r(f"cos(2 * pi() * {MM} / 12)")} as month_cos from events"""),
    "feat_calendar": (feat_calendar, q("""
        select date, isodow(date) - 1 as weekday, month(date) as month, day(date) as day_of_month, week(date) as week_of_year,
               quarter(date) as quarter, count(*) as n from bk group by all""", BL)),
    "feat_flags": (feat_flags, f"""
        select event_id, {HH} as hour, ({HH} >= 22 or {HH} <= 5)::int as is_night, ({HH} between 9 and 17)::int as is_business,
               ({HH} between 7 and 9 or {HH} between 17 and 19)::int as is_rush from events"""),
    "feat_vtat": (feat_vtat, q(f"""
        select booking_id, date, vehicle_type, {r(IMPUTED)} as avg_vtat_imputed, {BUCKET.replace("X", IMPUTED)} as vtat_bucket,
               ({IMPUTED} >= 15)::int as is_high_vtat
        from bk left join med on vehicle_type = v cross join gm""", BK, MEDIANS)),
    "feat_vtat_medians": (feat_vtat_medians, q("""
        select v as vehicle_type, m as median_vtat from med where v is not null union all select null, m from gm""", BK, MEDIANS)),
    "feat_vtat_zone": (feat_vtat_zone, q("""
        select avg_vtat, case when avg_vtat between 0 and 2.9 then 'instant' when avg_vtat <= 5 then 'short'
                 when avg_vtat <= 11.9 then 'normal' when avg_vtat <= 15 then 'dip' when avg_vtat <= 20 then 'timeout' end as vtat_zone,
               coalesce(avg_vtat <= 2.9, false)::int as is_instant_arrival, coalesce(avg_vtat > 15, false)::int as is_timeout,
               coalesce(avg_vtat > 11.9, false)::int as is_long_wait,
               case when avg_vtat >= 2 and avg_vtat <= 2.9 then 'Zero-cancel' when avg_vtat >= 3 and avg_vtat <= 5 then 'Low'
                    when avg_vtat >= 5.1 and avg_vtat <= 11.9 then 'Baseline' when avg_vtat >= 12 and avg_vtat <= 15 then 'Dip'
                    when avg_vtat >= 15.1 and avg_vtat <= 20 then 'Guaranteed-cancel' end as zone, count(*) as n
        from bk group by all""", BL)),
    "feat_missing": (feat_missing, """
        select (l_discount = 0)::int as vtat_missing, (l_returnflag = 'R')::int as is_cancelled, count(*) as n
        from lineitem group by all"""),
    "feat_global_median": (feat_global_median, q("""
        select coalesce(avg_vtat, (select median(avg_vtat) from bk)) as avg_vtat_imputed, count(*) as n from bk group by 1""", BL)),
    "feat_topn": (feat_topn, q("""
        select case when pickup_location in (select k from top) then pickup_location else 'Other' end as pickup_location_grouped,
               count(*) as n from bk group by 1""", BL, TOP)),
    "feat_target_enc": (feat_target_enc, q(f"""
        select bk.drop_location, {r("coalesce(e, g)")} as drop_encoded, count(*) as n from bk
        left join (select drop_location, (count(*) * avg(is_cancelled) + 10 * any_value(g)) / (count(*) + 10) as e
                   from bk cross join (select avg(is_cancelled) as g from bk where split = 'train')
                   where split = 'train' group by 1) t on t.drop_location = bk.drop_location
        cross join (select avg(is_cancelled) as g from bk where split = 'train') group by bk.drop_location, e, g""", BK)),
    "feat_label_enc": (feat_label_enc, q("""
        select vehicle_type, vehicle_type_encoded, count(*) as n from ft group by all""", FT)),
    "feat_chain": (feat_chain, q(f"""
        select booking_id, split, is_cancelled, {r("avg_vtat_imputed")} as avg_vtat_imputed, vtat_bucket, is_high_vtat,
               {r("pickup_encoded")} as pickup_encoded, {r("drop_encoded")} as drop_encoded, vehicle_type_encoded, hour,
               dayofweek, month, is_weekend, is_peak_hour, is_late_night,
               {", ".join(f"{r(c)} as {c}" for c in CYCLES)} from ft""", FT)),
    "feat_chain_state": (feat_chain_state, q(f"""
        select 'vtat_median' as artifact, v as key, {r("m")} as value from med
        union all select 'vehicle_code', v, code::double from lab
        union all select 'pickup_encoding', k, {r("e")} from ep union all select 'drop_encoding', k, {r("e")} from ed
        union all select 'vtat_median', null, {r("mv")} from gm
        union all select 'pickup_encoding', null, {r("m")} from gm union all select 'drop_encoding', null, {r("m")} from gm""", FT)),
    "feat_residual_nulls": (feat_residual_nulls, q(MISSING_SQL, FT)),
    "vtat_bucket_rates": (vtat_bucket_rates, q(f"""
        select {BUCKET.replace("X", IMPUTED)} as vtat_bucket, cast(sum(is_cancelled) as bigint) as cancelled, count(*) as total,
               {r("avg(is_cancelled)")} as cancel_rate
        from bk left join med on vehicle_type = v cross join gm group by 1 order by 1""", BK, MEDIANS)),
}
