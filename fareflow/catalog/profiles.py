"""Queries on column profiles, outliers, missing values, class balance and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareflow.catalog.associations import NF, NUMERIC, numeric_frame
from fareflow.catalog.sql import BK, BL, q, r
from fareflow.functions.columns import rounded
from fareflow.operators import counts, profile, series
from fareflow.operators.features import add_hour_flags, add_vtat_global
from fareflow.sources.tables import bookings, table, timed_events

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXTS = ["booking_id", "customer_id", "vehicle_type", "pickup_location", "avg_vtat"]


def profile_columns(spark, sf):
    li = table(spark, sf, "lineitem").select(*NUMBERS)
    s = profile.column_stats(li, NUMBERS)
    # at 100 TB the kurtosis of a uniform column is stable to four digits
    return s.select("column", "n", rounded("min").alias("min"), rounded("max").alias("max"), rounded("mean", 4).alias("mean"),
                    rounded("std", 4).alias("std"), rounded("skew", 4).alias("skew"), rounded("kurtosis", 4).alias("kurtosis"))


def profile_full(spark, sf):
    df = bookings(spark, sf, "vehicle_type", "avg_vtat", "ride_distance", "is_cancelled")
    out = profile.full_profile(df)
    exact = ["n_distinct", "n_null", "n_rows", "n"]
    near = ["distinct_ratio", "min", "max", "q25", "median", "q75"]
    return out.select("column", "cardinality", *exact, *[rounded(c).alias(c) for c in near],
                      *[rounded(c, 4).alias(c) for c in ("mean", "std", "skew", "kurtosis")])


def profile_quartiles(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    out = profile.quartiles(table(spark, sf, "lineitem").select(*cols), cols)
    return out.select("column", rounded("q25").alias("q25"), rounded("median").alias("median"), rounded("q75").alias("q75"))


def profile_distinct(spark, sf):
    d = profile.distinct_profile(bookings(spark, sf, *TEXTS), TEXTS)
    return d.withColumn("distinct_ratio", rounded("distinct_ratio"))


def profile_missing(spark, sf):
    return profile.missing_summary(bookings(spark, sf, "avg_vtat", "avg_ctat", "booking_value", "date", "payment_method"))


def profile_nulls_by_target(spark, sf):
    n = profile.nulls_by_target(bookings(spark, sf, "avg_vtat", "is_cancelled"), "avg_vtat")
    return n.withColumn("pct_null", rounded("pct_null"))


def profile_outliers(spark, sf):
    o = profile.outlier_bounds(table(spark, sf, "events").select("value"), "value")
    return o.select("column", rounded("q25").alias("q25"), rounded("q75").alias("q75"), rounded("low").alias("low"),
                    rounded("high").alias("high"), "n_below", "n_above", "n", rounded("pct_outliers").alias("pct_outliers"))


def low_variance(spark, sf):
    """The numeric features of the multivariate checks."""
    v = profile.low_variance(numeric_frame(spark, sf), NUMERIC)
    return v.select("column", rounded("variance", 4).alias("variance"), "is_low")


def class_balance(spark, sf):
    c = counts.class_balance(bookings(spark, sf, "is_cancelled"))
    return c.withColumns({n: rounded(n) for n in ("positive_share", "imbalance_ratio", "scale_pos_weight")})


def majority_class(spark, sf):
    return counts.majority_class(bookings(spark, sf, "is_cancelled"))


def flag_summary(spark, sf):
    e = timed_events(spark, sf).withColumn("hour", F.hour("ts"))
    f = counts.flag_summary(add_hour_flags(e), ["is_night", "is_business", "is_rush"])
    return f.withColumn("share", rounded("share"))


def hist_fixed(spark, sf):
    h = series.histogram(bookings(spark, sf, "avg_vtat"), "avg_vtat", 0, 20, 100)
    return h.select("bin", rounded("bin_low").alias("bin_low"), "n", rounded("density").alias("density"))


def hist_range(spark, sf):
    h = series.histogram(timed_events(spark, sf), "value", None, None, 50)
    return h.select("bin", rounded("bin_low").alias("bin_low"), "n", rounded("density").alias("density"))


def hist_by_class(spark, sf):
    df = add_vtat_global(bookings(spark, sf, "date", "avg_vtat", "is_cancelled"))
    df = df.withColumn("is_weekend", (F.weekday("date") >= 5).cast("int"))
    h = series.histogram(df, "avg_vtat_imputed", 0, 20, 30, ("is_weekend", "is_cancelled"))
    return h.select("is_weekend", "is_cancelled", "bin", "n", rounded("density").alias("density"))


def hourly_counts(spark, sf):
    df = bookings(spark, sf, "time").withColumn("hour", F.floor(series.minute_of_day("time") / 60).cast("int"))
    return counts.value_counts(df, "hour")


def _stat_sql(c: str) -> str:
    return f"""select '{c}' as "column", count({c}) as n, {r(f"min({c})")} as min, {r(f"max({c})")} as max,
        {r(f"avg({c})", 4)} as mean, {r(f"stddev_samp({c})", 4)} as std, {r(f"skewness({c})", 4)} as skew,
        {r(f"kurtosis({c})", 4)} as kurtosis from lineitem"""


def _distinct_sql(c: str) -> str:
    return f"""select '{c}' as "column", count(distinct {c}) as n_distinct, count(*) - count({c}) as n_null, count(*) as n_rows
        from bk"""


def _full_sql(c: str, number: bool) -> str:
    num = lambda f, d=6: r(f, d) if number else "null::double"
    return f"""select '{c}' as "column", case when (count(distinct {c}) + (count(*) > count({c}))::int) / count(*) <= 0.5 then 'category' else 'text' end as cardinality,
      count(distinct {c}) as n_distinct, count(*) - count({c}) as n_null, count(*) as n_rows, {f"count({c})" if number else "null::bigint"} as n,
      {r(f"(count(distinct {c}) + (count(*) > count({c}))::int) / count(*)")} as distinct_ratio, {num(f"min({c})")} as min, {num(f"max({c})")} as max,
      {num(f"quantile_cont({c}, 0.25)")} as q25, {num(f"median({c})")} as median, {num(f"quantile_cont({c}, 0.75)")} as q75,
      {num(f"avg({c})", 4)} as mean, {num(f"stddev_samp({c})", 4)} as std, {num(f"skewness({c})", 4)} as skew, {num(f"kurtosis({c})", 4)} as kurtosis from fl"""


MISSING = "select 'COL' as \"column\", count(*) filter (where EXPR) as n_missing, count(*) as n from lineitem"
GLOBAL_MEDIAN = "gv as (select median(avg_vtat) as m from bk)"

QUERIES = {
    "profile_columns": (profile_columns, " union all ".join(_stat_sql(c) for c in NUMBERS)),
    "profile_full": (profile_full, q(
        " union all ".join(_full_sql(c, c != "vehicle_type") for c in ("vehicle_type", "avg_vtat", "ride_distance", "is_cancelled")),
        BK, "fl as (select vehicle_type, avg_vtat, case when status <> 'R' then l_quantity end as ride_distance, is_cancelled from bk)")),
    "profile_quartiles": (profile_quartiles, " union all ".join(
        f"""select '{c}' as "column", {r(f"quantile_cont({c}, 0.25)")} as q25, {r(f"median({c})")} as median,
        {r(f"quantile_cont({c}, 0.75)")} as q75 from lineitem""" for c in ("l_quantity", "l_extendedprice", "l_tax"))),
    "profile_distinct": (profile_distinct, q(
        "select *, " + r("(n_distinct + (n_null > 0)::int) / n_rows")
        + " as distinct_ratio, case when (n_distinct + (n_null > 0)::int) / n_rows <= 0.5 then 'category' else 'text' end as cardinality from ("
        + " union all ".join(_distinct_sql(c) for c in TEXTS) + ")", BK)),
    "profile_missing": (profile_missing, "select \"column\", n_missing, round(n_missing / n * 100, 2) as pct_missing from ("
        + " union all ".join(MISSING.replace("COL", c).replace("EXPR", e) for c, e in (
            ("avg_vtat", "l_discount = 0"), ("avg_ctat", "l_returnflag = 'R'"), ("booking_value", "l_returnflag = 'R'"),
            ("payment_method", "l_returnflag = 'R'"))) + ") where n_missing > 0"),
    "profile_nulls_by_target": (profile_nulls_by_target, f"""
        select (l_returnflag = 'R')::int as is_cancelled, count(*) as n_rows, count(*) filter (where l_discount = 0) as n_null,
               {r("100.0 * count(*) filter (where l_discount = 0) / count(*)")} as pct_null from lineitem group by 1"""),
    "profile_outliers": (profile_outliers, f"""
        with b as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as z from events),
        f as (select a, z, a - 1.5 * (z - a) as lo, z + 1.5 * (z - a) as hi from b)
        select 'value' as "column", {r("any_value(a)")} as q25, {r("any_value(z)")} as q75, {r("any_value(lo)")} as low,
               {r("any_value(hi)")} as high, count(*) filter (where value < lo) as n_below,
               count(*) filter (where value > hi) as n_above, count(value) as n,
               {r("100.0 * count(*) filter (where value < lo or value > hi) / count(value)")} as pct_outliers
        from events cross join f"""),
    "low_variance": (low_variance, q(" union all ".join(
        f"""select '{c}' as "column", {r(f"var_samp({c})", 4)} as variance, (var_samp({c}) < 0.01)::int as is_low from nf"""
        for c in NUMERIC), BL, NF)),
    "class_balance": (class_balance, f"""
        with z as (select count(*) filter (where l_returnflag <> 'R') as a, count(*) filter (where l_returnflag = 'R') as b from lineitem)
        select a as n_negative, b as n_positive, a + b as n_rows, {r("b / (a + b)")} as positive_share,
               {r("greatest(a, b) / least(a, b)")} as imbalance_ratio, {r("a / b")} as scale_pos_weight,
               round(b / 18, 1) as events_per_variable, case when b >= 180 then 'PASS' else 'FAIL' end as epv_check from z"""),
    "majority_class": (majority_class, "select mode(case when l_returnflag = 'R' then 1 else 0 end) as majority from lineitem"),
    "flag_summary": (flag_summary, " union all ".join(
        f"""select '{name}' as flag, count(*) filter (where hour(ts) in ({hours})) as n_set,
        {r(f"count(*) filter (where hour(ts) in ({hours})) / count(*)")} as share from events""" for name, hours in (
            ("is_night", "0,1,2,3,4,5,22,23"), ("is_business", "9,10,11,12,13,14,15,16,17"), ("is_rush", "7,8,9,17,18,19")))),
    "hist_fixed": (hist_fixed, q(f"""
        select b as bin, {r("b * 0.2")} as bin_low, count(*) as n, {r("count(*) / sum(count(*)) over () / 0.2")} as density
        from (select least(floor(avg_vtat * 100 / 20), 99)::int as b from bk where avg_vtat is not null) group by b""", BL)),
    "hist_range": (hist_range, f"""
        with s as (select min(value) as lo, max(value) as hi from events)
        select b as bin, {r("any_value(lo) + b * (any_value(hi) - any_value(lo)) / 50")} as bin_low, count(*) as n,
               {r("count(*) / (sum(count(*)) over ()) / ((any_value(hi) - any_value(lo)) / 50)")} as density
        from (select lo, hi, least(floor((value - lo) * 50 / (hi - lo)), 49)::int as b from events cross join s) group by b"""),
    "hist_by_class": (hist_by_class, q(f"""
        select is_weekend, is_cancelled, bin, n, {r("n / sum(n) over (partition by is_weekend, is_cancelled) / (20 / 30)")} as density
        from (select (isodow(date) > 5)::int as is_weekend, is_cancelled, count(*) as n,
                     least(floor(coalesce(avg_vtat, m) * 30 / 20), 29)::int as bin from bk cross join gv group by 1, 2, 4)""",
        BL, GLOBAL_MEDIAN)),
    "hourly_counts": (hourly_counts, q("select sec // 3600 as hour, count(*) as n from bk group by 1", BL)),
}
