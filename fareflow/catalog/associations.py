"""Queries on association tests, correlations, mutual information and interactions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from fareflow.catalog.features import chain_features
from fareflow.catalog.sql import BK, BL, EV, FT, q, r
from fareflow.functions.columns import rounded
from fareflow.operators import association as a
from fareflow.operators import features as ft
from fareflow.operators import rank_stats, series
from fareflow.schemas import FEATURES, TARGET
from fareflow.sources.tables import bookings, timed_events

NUMERIC = ["avg_vtat_imputed", "is_high_vtat", "hour", "dayofweek", "month", "is_weekend", "is_peak_hour", "is_late_night",
           "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
CATEGORIES = ["vehicle_type", "vtat_bucket", "is_weekend", "is_peak_hour", "is_late_night", "is_high_vtat", "is_cancelled"]
FLAGS = ["is_instant_arrival", "is_timeout", "is_long_wait"]
SPREAD = ["vehicle_type", "pickup_location", "drop_location", "hour", "weekday", "month", "day_of_month", "week_of_year", "quarter",
          "is_night", "is_business", "is_rush"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def numeric_frame(spark, sf, *more):
    """The numeric matrix of the multivariate checks: globally imputed waiting time plus time features."""
    df = ft.add_temporal(bookings(spark, sf, "date", "time", "avg_vtat", "is_cancelled", *more))
    df = ft.add_vtat_global(df)
    return df.withColumns(ft.vtat_buckets(F.col("avg_vtat_imputed")))


def _r(df, *names, digits=6):
    return df.withColumns({n: rounded(n, digits) for n in names})


def assoc_nominal(spark, sf):
    n = a.nominal_vs_binary(bookings(spark, sf, "pickup_location", "is_cancelled"), "pickup_location")
    return _r(n, "cancel_rate", "ci_low", "ci_high", "expected", "residual")


def assoc_nominal_stats(spark, sf):
    df = ft.add_calendar(bookings(spark, sf, "date", "is_cancelled"))
    out = a.nominal_stats(df, "weekday").unionByName(a.nominal_stats(df, "month"))
    return _r(out, "chi2", "cramers_v")


def assoc_nominal_pvalues(spark, sf):
    df = ft.add_calendar(bookings(spark, sf, "date", "is_cancelled"))
    return _r(a.nominal_stats(df, "weekday", p_value=True), "chi2", "cramers_v", "p_value")


def assoc_binary(spark, sf):
    df = ft.add_vtat_zone(bookings(spark, sf, "avg_vtat", "is_cancelled")).dropna(subset=["avg_vtat"])
    return _r(a.binary_vs_binary(df, FLAGS), "odds_ratio", "ci_low", "ci_high", "phi")


def assoc_missing_target(spark, sf):
    df = ft.add_vtat_missing(bookings(spark, sf, "avg_vtat", "is_cancelled"))
    return _r(a.binary_vs_binary(df, ["vtat_missing"]), "odds_ratio", "ci_low", "ci_high", "phi")


def assoc_binary_fisher(spark, sf):
    df = ft.add_hour_flags(timed_events(spark, sf).withColumn("hour", F.hour("ts")))
    out = a.binary_vs_binary(df, ["is_night", "is_business", "is_rush"], p_value=True)
    return _r(out, "odds_ratio", "ci_low", "ci_high", "phi", "p_value")


def assoc_continuous(spark, sf):
    c = a.continuous_vs_binary(bookings(spark, sf, "avg_vtat", "is_cancelled"), "avg_vtat")
    return _r(c, "mean0", "mean1", "cohens_d", "welch_t", "overlap").withColumn("welch_dof", F.round("welch_dof", 3))


def assoc_trend(spark, sf):
    return _r(a.binned_trend(timed_events(spark, sf), "value", 5.0), "cancel_rate")


def assoc_zones(spark, sf):
    z = a.zone_breakdown(bookings(spark, sf, "avg_vtat", "is_cancelled"), "avg_vtat", ft.VTAT_ZONES)
    return _r(z, "cancel_rate")


def assoc_cross_tab(spark, sf):
    df = ft.add_vtat_zone(bookings(spark, sf, "avg_vtat", "vehicle_type"))
    return a.contingency(df, "vtat_zone", "vehicle_type")


def assoc_cramers_matrix(spark, sf):
    return _r(a.cramers_matrix(numeric_frame(spark, sf, "vehicle_type"), CATEGORIES), "cramers_v")


def assoc_cramers_notable(spark, sf):
    m = a.cramers_matrix(numeric_frame(spark, sf, "vehicle_type"), CATEGORIES, mirror=False)
    return _r(a.notable_pairs(m).select("feature_a", "feature_b", "cramers_v", "strength"), "cramers_v")


def assoc_cramers_pair(spark, sf):
    v = a.cramers_v(bookings(spark, sf, "pickup_location", "status"), "pickup_location", "status")
    return _r(v, "chi2", "cramers_v")


def assoc_corr_matrix(spark, sf):
    df = numeric_frame(spark, sf).select(*NUMERIC, "is_cancelled")
    return _r(a.correlation_pairs(df, [*NUMERIC, "is_cancelled"], complete=True), "r")


def assoc_corr_strong(spark, sf):
    df = numeric_frame(spark, sf).select(*NUMERIC, "is_cancelled")
    return _r(a.strong_pairs(a.correlation_pairs(df, [*NUMERIC, "is_cancelled"], complete=True)), "r")


def assoc_corr_target(spark, sf):
    return _r(a.target_correlations(numeric_frame(spark, sf), NUMERIC), "correlation", "abs_correlation")


def assoc_pointbiserial(spark, sf):
    p = a.point_biserial(numeric_frame(spark, sf), "avg_vtat_imputed", "is_weekend")
    return _r(p, "r", digits=6).withColumn("t_stat", rounded("t_stat", 4))


def assoc_spearman(spark, sf):
    return _r(rank_stats.spearman(bookings(spark, sf, "avg_vtat", "is_cancelled"), "avg_vtat", "is_cancelled"), "rho")


def assoc_spearman_daily(spark, sf):
    d = series.daily_rates(bookings(spark, sf, "date", "is_cancelled"))
    rate = rank_stats.spearman_trend(d, "date_ordinal", "cancel_rate").withColumn("series", F.lit("rate"))
    volume = rank_stats.spearman_trend(d, "date_ordinal", "total").withColumn("series", F.lit("volume"))
    return _r(rate.unionByName(volume), "rho")


def assoc_spearman_minutes(spark, sf):
    m = series.minute_rates(timed_events(spark, sf))
    return _r(rank_stats.spearman_trend(m, "minute_ordinal", "cancel_rate"), "rho")


def assoc_vif(spark, sf):
    return _r(a.variance_inflation(numeric_frame(spark, sf), NUMERIC), "vif", digits=4)


def assoc_vif_pair(spark, sf):
    v = a.variance_inflation(bookings(spark, sf, "avg_vtat", "is_cancelled"), ["avg_vtat", "is_cancelled"])
    return _r(v, "vif")


def assoc_mi_binned(spark, sf):
    mi = rank_stats.binned_mutual_information(numeric_frame(spark, sf), NUMERIC)
    return _r(mi, "mutual_information", digits=7)


def assoc_mi_knn(spark, sf):
    return _r(rank_stats.knn_mutual_information(numeric_frame(spark, sf), NUMERIC), "mutual_information")


def assoc_mi_knn_value(spark, sf):
    mi = rank_stats.knn_mutual_information(timed_events(spark, sf), ["value"])
    return _r(mi, "mutual_information")


def assoc_missing_spread(spark, sf):
    df = ft.add_vtat_missing(bookings(spark, sf, "date", "time", "avg_vtat", "vehicle_type", "pickup_location", "drop_location"))
    df = ft.add_hour_flags(ft.add_calendar(df).withColumn("hour", F.floor(series.minute_of_day("time") / 60).cast("int")))
    return _r(a.missing_spread(df, "vtat_missing", SPREAD), "min_rate", "max_rate", "spread_pp")


def assoc_logodds(spark, sf):
    """Every model feature on the training rows."""
    df = chain_features(spark, sf)[0].where("split = 'train'").select(*FEATURES, TARGET)
    return _r(rank_stats.decile_log_odds(df, FEATURES), "rate", "log_odds")


def pivot_rates(spark, sf):
    df = ft.add_vtat_zone(bookings(spark, sf, "avg_vtat", "vehicle_type", "is_cancelled"))
    names = ["p1", "p2", "p3", "p4", "p5"]
    return _r(a.pivot_rates(df, "vtat_zone", "vehicle_type", PRIORITIES, names=names), *names)


def pivot_hour_category(spark, sf):
    e = timed_events(spark, sf).withColumn("hour", F.hour("ts"))
    names = [f"c{i}" for i in range(7)]
    return _r(a.pivot_rates(e, "hour", "category", [str(i) for i in range(7)], names=names), *names)


def pivot_bucket_peak(spark, sf):
    out = a.pivot_rates(numeric_frame(spark, sf), "vtat_bucket", "is_peak_hour", [0, 1], names=["off_peak", "peak_hour"])
    return _r(out, "off_peak", "peak_hour")


def pivot_spread(spark, sf):
    df = ft.add_vtat_zone(bookings(spark, sf, "avg_vtat", "vehicle_type", "is_cancelled"))
    return _r(a.pivot_spread(df, "vtat_zone", "vehicle_type"), "spread", "max_rate", "min_rate")


NF = """nf as (
  select *, sec // 3600 as hour, isodow(date) - 1 as dayofweek, month(date) as month,
         (isodow(date) > 5)::int as is_weekend, (sec // 3600 in (7,8,9,10,17,18,19,20,21))::int as is_peak_hour,
         (sec // 3600 in (23,0,1,2,3,4,5))::int as is_late_night, (v >= 15)::int as is_high_vtat,
         v as avg_vtat_imputed,
         case when v > 0 and v <= 5 then '0.0' when v <= 10 then '1.0' when v <= 15 then '2.0' when v <= 20 then '3.0' else 'nan' end as vtat_bucket,
         sin(2 * pi() * (sec // 3600) / 24) as hour_sin, cos(2 * pi() * (sec // 3600) / 24) as hour_cos,
         sin(2 * pi() * (isodow(date) - 1) / 7) as dow_sin, cos(2 * pi() * (isodow(date) - 1) / 7) as dow_cos,
         sin(2 * pi() * month(date) / 12) as month_sin, cos(2 * pi() * month(date) / 12) as month_cos
  from (select *, coalesce(avg_vtat, (select median(avg_vtat) from bk)) as v from bk))"""
RATE = "sum(is_cancelled) / count(*)"


def _cramers(x: str, y: str, src: str) -> str:
    """Chi-square from a full grid of cells, absent cells included."""
    return f"""select '{x}' as fa, '{y}' as fb, sum(greatest(abs(o - e) - yc, 0) ** 2 / e) as chi2, any_value(n) as n, any_value(na) as na, any_value(nb) as nb from (
      select coalesce(c.o, 0) as o, ra.r * rb.r / n::double as e, n, na, nb, case when na = 2 and nb = 2 then 0.5 else 0 end as yc
      from (select {x}::varchar as a, count(*) as r, count(*) over () as na from {src} group by 1) ra
      cross join (select {y}::varchar as b, count(*) as r, count(*) over () as nb from {src} group by 1) rb
      cross join (select count(*) as n from {src}) left join
      (select {x}::varchar as a, {y}::varchar as b, count(*) as o from {src} group by 1, 2) c on c.a = ra.a and c.b = rb.b)"""


CRAMERS = ("cv as (select fa, fb, sqrt(chi2 / (n * (least(na, nb) - 1))) as v from ("
           + " union all ".join(_cramers(x, y, "nf") for x, y in combinations(CATEGORIES, 2)) + "))")


def _plain_chi2(f: str) -> str:
    return f"""select '{f}' as feature, sum(o2) as n, sum((o - e) ** 2 / e) as chi2, count(distinct k) - 1 as dof from (
       select k, y, o, o as o2, (sum(o) over (partition by k)) * (sum(o) over (partition by y)) / (sum(o) over ())::double as e
       from (select {f}(date) as k, is_cancelled as y, count(*) as o from bk group by 1, 2))"""


def _binary(name: str, cond: str) -> str:
    return f"""select '{name}' as feature, count(*) filter (where {cond} and is_cancelled = 1) as a,
      count(*) filter (where {cond} and is_cancelled = 0) as b, count(*) filter (where not ({cond}) and is_cancelled = 1) as c,
      count(*) filter (where not ({cond}) and is_cancelled = 0) as d from bk where avg_vtat is not null"""


def _hour_flag(name: str, hours: str) -> str:
    cell = lambda inside, y: f"count(*) filter (where h {inside} ({hours}) and is_cancelled = {y})"
    return f"""select '{name}' as feature, {cell("in", 1)} as a, {cell("in", 0)} as b, {cell("not in", 1)} as c,
      {cell("not in", 0)} as d from ev"""


def _log_pmf(k: str) -> str:
    """Hypergeometric log probability of k in a table with the margins of (a, b, c, d)."""
    lf = lambda x: f"lgamma(({x})::double + 1)"
    choose = lambda n, x: f"({lf(n)} - {lf(x)} - {lf(f'({n}) - ({x})')})"
    return f"({choose('a + b', k)} + {choose('c + d', f'a + c - {k}')} - {choose('a + b + c + d', 'a + c')})"


def _corr(x: str, y: str) -> str:
    return f"select '{x}' as feature_a, '{y}' as feature_b, {r(f'corr({x}, {y})')} as r from nf"


def _spread(name: str, expr: str) -> str:
    return f"""select '{name}' as feature, count(*) as n_categories, {r("min(m)")} as min_rate, {r("max(m)")} as max_rate,
      {r("(max(m) - min(m)) * 100")} as spread_pp from (select {expr} as k, avg((avg_vtat is null)::int) as m from bk group by 1)"""


def _mi(f: str) -> str:
    return f"""select '{f}' as feature, greatest(sum(p * ln(p / (px * py))), 0) as m from (
      select p, sum(p) over (partition by b) as px, sum(p) over (partition by y) as py from (
        select least(floor(({f} - lo) * 20 / (hi - lo)), 19) as b, is_cancelled as y, count(*) / any_value(n)::double as p
        from nf cross join (select min({f}) as lo, max({f}) as hi, count(*) as n from nf) group by 1, 2))"""


def _inverse(columns: list[str]) -> str:
    """Gauss-Jordan elimination of [G | I], one column per step of a recursive table."""
    k = len(columns)
    rows = ", ".join("[" + ", ".join([f"sum({x}::double * {y})" for y in columns]
                                     + [f"{int(i == j)}::double" for j in range(k)]) + "]" for i, x in enumerate(columns))
    return f"""g as (select [{rows}] as m from nf),
      steps as (select 1 as k, m from g union all
        select k + 1, list_transform(m, lambda w, i: case when i = k then list_transform(w, lambda x: x / w[k])
                      else list_transform(w, lambda x, j: x - w[k] * (m[k][j] / m[k][k])) end) from steps where k <= {k}),
      inv as (select unnest(range(1, {k + 1})) as i, m from steps where k = {k + 1}),
      v as (select i, (select m from g)[i][i] * m[i][i + {k}] as vif from inv)"""


def _psi(x: str) -> str:
    """Digamma by recurrence to x + 6 and the asymptotic series."""
    z = f"({x} + 6)::double"
    back = " + ".join(f"1 / ({x} + {i})::double" for i in range(6))
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ^ 2) + 1 / (120 * {z} ^ 4) - 1 / (252 * {z} ^ 6) - ({back}))"


def _knn(src: str, features: list[str]) -> str:
    """Nearest-neighbour information by comparing all pairs of distinct values."""
    cnt = " union all ".join(
        f"select '{f}' as feature, is_cancelled as y, {f}::double as v, count(*) as n from {src} group by 2, 3" for f in features)
    return f""", cnt as ({cnt}), nc as (select feature, y, sum(n) as c from cnt group by 1, 2), nn as (select feature, sum(n) as t from cnt group by 1),
      near as (select a.feature, a.y, a.v, a.n, abs(b.v - a.v) as dist, sum(case when b.v = a.v then b.n - 1 else b.n end)
               over (partition by a.feature, a.y, a.v order by abs(b.v - a.v)) as cum from cnt a join cnt b on a.feature = b.feature and a.y = b.y),
      rad as (select feature, y, v, any_value(n) as n, min(dist) filter (where cum >= 5) as rd from near group by 1, 2, 3),
      al as (select rad.feature, rad.y, rad.v, any_value(rad.n) as n, any_value(rd) as rd, sum(p.n) as m from rad join cnt p
             on p.feature = rad.feature and (p.v = rad.v or abs(p.v - rad.v) < rd - greatest(1e-9 * rd, 4.5e-16 * abs(rad.v)))
             group by 1, 2, 3)
      select feature, {r(f"greatest(0, {_psi('any_value(t)')} + sum(n * ({_psi('(case when rd = 0 then n else 5 end)')} - {_psi('c')} - {_psi('m')})) / any_value(t))")}
             as mutual_information from al join nc using (feature, y) join nn using (feature) group by feature"""


def _logodds(f: str) -> str:
    cuts = f"(select quantile_cont({f}::double, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) as q from ftr)"
    return f"""select '{f}' as feature, b as bin, count(*) as n, avg(is_cancelled) as p from (
      select is_cancelled, greatest(len(list_filter(list_distinct(q), lambda e: e < {f})), 1)::int - 1 as b from ftr cross join {cuts} where {f} is not null) group by b"""


def _mean_rank(c: str) -> str:
    return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2"


HOUR = "(sec // 3600)"
SPREAD_SQL = {"vehicle_type": "vehicle_type", "pickup_location": "pickup_location", "drop_location": "drop_location",
              "weekday": "isodow(date)", "month": "month(date)", "day_of_month": "day(date)",
              "week_of_year": "week(date)", "quarter": "quarter(date)", "is_night": f"{HOUR} in (22,23,0,1,2,3,4,5)",
              "is_business": f"{HOUR} between 9 and 17", "is_rush": f"{HOUR} in (7,8,9,17,18,19)", "hour": HOUR}
ZN = ("zn as (select vehicle_type, is_cancelled, case when avg_vtat <= 2.9 then 'instant' when avg_vtat <= 5 then 'short' "
      "when avg_vtat <= 11.9 then 'normal' when avg_vtat <= 15 then 'dip' when avg_vtat <= 20 then 'timeout' end as vtat_zone from bk)")
HOUR_FLAGS = {"is_night": "22,23,0,1,2,3,4,5", "is_business": "9,10,11,12,13,14,15,16,17", "is_rush": "7,8,9,17,18,19"}
DAYS = "d as (select date, sum(is_cancelled) / count(*) as v, count(*) as t from bk group by date)"

QUERIES = {
    "assoc_nominal": (assoc_nominal, q(f"""
        , g as (select pickup_location, count(*) as t, sum(is_cancelled)::bigint as c, avg(is_cancelled) as p from bk group by 1),
        o as (select avg(is_cancelled) as m from bk),
        w as (select *, (p + 1.96 ^ 2 / (2 * t)) / (1 + 1.96 ^ 2 / t) as mid,
              1.96 * sqrt(p * (1 - p) / t + 1.96 ^ 2 / (4 * t * t)) / (1 + 1.96 ^ 2 / t) as h, (c - t * m) / sqrt(t * m) as z from g cross join o)
        select pickup_location, t as total, c as cancelled, t - c as not_cancelled, {r("p")} as cancel_rate, {r("mid - h")} as ci_low,
               {r("mid + h")} as ci_high, (m not between mid - h and mid + h)::int as differs, {r("t * m")} as expected,
               {r("z")} as residual, (abs(z) > 2)::int as is_notable from w""", BL)),
    "assoc_nominal_stats": (assoc_nominal_stats, q(f"""
        select feature, n::bigint as n, {r("chi2")} as chi2, dof, {r("sqrt(chi2 / n)")} as cramers_v
        from ({_plain_chi2("weekday")} union all {_plain_chi2("month")})""", BL)),
    # six degrees of freedom have a closed tail
    "assoc_nominal_pvalues": (assoc_nominal_pvalues, q(f"""
        select feature, n::bigint as n, {r("chi2")} as chi2, dof, {r("sqrt(chi2 / n)")} as cramers_v,
               {r("exp(-chi2 / 2) * (1 + chi2 / 2 + chi2 * chi2 / 8)")} as p_value from ({_plain_chi2("weekday")})""", BL)),
    "assoc_binary": (assoc_binary, q(f"""
        select feature, a, b, c, d, {r("a * d / (b * c)")} as odds_ratio,
               {r("a * d / (b * c) * exp(-1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d))")} as ci_low,
               {r("a * d / (b * c) * exp(1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d))")} as ci_high,
               {r("(a * d - b * c) / sqrt((a + b)::double * (c + d) * (a + c) * (b + d))")} as phi
        from ({_binary("is_instant_arrival", "avg_vtat <= 2.9")} union all {_binary("is_timeout", "avg_vtat > 15")}
              union all {_binary("is_long_wait", "avg_vtat > 11.9")})""", BL)),
    "assoc_missing_target": (assoc_missing_target, f"""
        with c as (select sum((m and y)::int)::bigint as a, sum((m and not y)::int)::bigint as b, sum((y and not m)::int)::bigint as c,
                   sum((not m and not y)::int)::bigint as d from (select l_discount = 0 as m, l_returnflag = 'R' as y from lineitem))
        select 'vtat_missing' as feature, a, b, c, d, {r("(a / b) / (c / d)")} as odds_ratio,
               {r("exp(ln((a / b) / (c / d)) - 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d))")} as ci_low,
               {r("exp(ln((a / b) / (c / d)) + 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d))")} as ci_high,
               {r("(a::double * d - b::double * c) / sqrt((a + b)::double * (c + d) * (a + c) * (b + d))")} as phi from c"""),
    "assoc_binary_fisher": (assoc_binary_fisher, q(f"""
        , t as ({" union all ".join(_hour_flag(n, h) for n, h in HOUR_FLAGS.items())}),
        pr as (select feature, a, k, {_log_pmf("k")} as lp, {_log_pmf("a")} as lo from (
          select *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) as k from t)),
        f as (select feature, sum(exp(lp)) filter (where lp <= lo + 1e-7) as p from pr group by 1)
        select feature, a, b, c, d, {r("a * d / (b * c)")} as odds_ratio,
               {r("a * d / (b * c) * exp(-1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d))")} as ci_low,
               {r("a * d / (b * c) * exp(1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d))")} as ci_high,
               {r("(a * d - b * c) / sqrt((a + b)::double * (c + d) * (a + c) * (b + d))")} as phi,
               {r("p")} as p_value from t join f using (feature)""", EV)),
    "assoc_continuous": (assoc_continuous, q(f"""
        , z as (select count(*) filter (where is_cancelled = 0) as n0, count(*) filter (where is_cancelled = 1) as n1,
          avg(avg_vtat) filter (where is_cancelled = 0) as m0, avg(avg_vtat) filter (where is_cancelled = 1) as m1,
          var_samp(avg_vtat) filter (where is_cancelled = 0) as v0, var_samp(avg_vtat) filter (where is_cancelled = 1) as v1,
          min(avg_vtat) as lo, max(avg_vtat) as hi from bk where avg_vtat is not null),
        h as (select least(floor((avg_vtat - lo) * 50 / (hi - lo)), 49) as b, count(*) filter (where is_cancelled = 0) / any_value(n0) as d0,
              count(*) filter (where is_cancelled = 1) / any_value(n1) as d1 from bk cross join z where avg_vtat is not null group by 1)
        select n0, n1, {r("m0")} as mean0, {r("m1")} as mean1,
               {r("(m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))")} as cohens_d,
               {r("(m1 - m0) / sqrt(v0 / n0 + v1 / n1)")} as welch_t,
               round((v0 / n0 + v1 / n1) ^ 2 / ((v0 / n0) ^ 2 / (n0 - 1) + (v1 / n1) ^ 2 / (n1 - 1)), 3) as welch_dof,
               {r("(select sum(least(d0, d1)) from h)")} as overlap from z""", BL)),
    "assoc_trend": (assoc_trend, q(f"""
        select floor(value / 5) * 5 as bucket_low, sum(is_cancelled)::bigint as cancelled, count(*) as total, {r(RATE)} as cancel_rate
        from ev group by 1""", EV)),
    "assoc_zones": (assoc_zones, q(f"""
        select kind, label, count(*) as total, sum(is_cancelled)::bigint as cancelled, {r(RATE)} as cancel_rate from (
          select 'bucket' as kind, printf('%.1f', floor(avg_vtat / 0.5) * 0.5) as label, is_cancelled from bk where avg_vtat is not null
          union all select 'zone', case when avg_vtat between 2 and 2.9 then 'Zero-cancel' when avg_vtat between 3 and 5 then 'Low'
            when avg_vtat between 5.1 and 11.9 then 'Baseline' when avg_vtat between 12 and 15 then 'Dip'
            when avg_vtat between 15.1 and 20 then 'Guaranteed-cancel' end, is_cancelled from bk)
        where label is not null group by 1, 2""", BL)),
    "assoc_cross_tab": (assoc_cross_tab, q("""
        select vtat_zone, vehicle_type, count(*) as n from zn where vtat_zone is not null group by 1, 2""", BK, ZN)),
    "assoc_cramers_matrix": (assoc_cramers_matrix, q(f"""
        select fa as feature_a, fb as feature_b, {r("v")} as cramers_v from cv union all select fb, fa, {r("v")} from cv
        union all select unnest({CATEGORIES}), unnest({CATEGORIES}), 1.0""", BK, NF, CRAMERS)),
    "assoc_cramers_notable": (assoc_cramers_notable, q(f"""
        select fa as feature_a, fb as feature_b, {r("v")} as cramers_v,
               case when v > 0.5 then 'STRONG' when v > 0.3 then 'MODERATE' else 'WEAK' end as strength from cv where v > 0.1""",
        BK, NF, CRAMERS)),
    "assoc_cramers_pair": (assoc_cramers_pair, q(f"""
        select fa as feature_a, fb as feature_b, n, {r("chi2")} as chi2, (na - 1) * (nb - 1) as dof,
               {r("sqrt(chi2 / (n * (least(na, nb) - 1)))")} as cramers_v from ({_cramers("pickup_location", "status", "bk")})""", BL)),
    "assoc_corr_matrix": (assoc_corr_matrix, q(
        " union all ".join(_corr(x, y) for x, y in combinations([*NUMERIC, "is_cancelled"], 2)), BL, NF)),
    "assoc_corr_strong": (assoc_corr_strong, q(
        "select * from (" + " union all ".join(_corr(x, y) for x, y in combinations([*NUMERIC, "is_cancelled"], 2)) + ") where abs(r) > 0.5", BL, NF)),
    "assoc_corr_target": (assoc_corr_target, q(" union all ".join(
        f"select '{c}' as feature, {r(f'corr({c}, is_cancelled)')} as correlation, {r(f'abs(corr({c}, is_cancelled))')} as abs_correlation from nf"
        for c in NUMERIC), BL, NF)),
    "assoc_pointbiserial": (assoc_pointbiserial, q(f"""
        select is_weekend, n, {r("c")} as r, {r("c * sqrt((n - 2) / (1 - c * c))", 4)} as t_stat
        from (select is_weekend, count(*) as n, corr(is_cancelled, v) as c from nf group by 1)""", BL, NF)),
    "assoc_spearman": (assoc_spearman, q(f"""
        select count(*) as n, {r("corr(x, y)")} as rho from (
          select {_mean_rank("avg_vtat")} as x, {_mean_rank("is_cancelled")} as y from bk where avg_vtat is not null)""", BL)),
    "assoc_spearman_daily": (assoc_spearman_daily, q(f"""
        select 'rate' as series, count(*) as n, {r("corr(x, y)")} as rho from (select rank() over (order by date) as x, {_mean_rank("v")} as y from d)
        union all
        select 'volume', count(*), {r("corr(x, y)")} from (select rank() over (order by date) as x, {_mean_rank("t")} as y from d)""", BL, DAYS)),
    "assoc_spearman_minutes": (assoc_spearman_minutes, q(f"""
        , m as (select h * 60 + mi as k, sum(is_cancelled) / count(*) as v from ev group by 1)
        select count(*) as n, {r("corr(x, y)")} as rho from (select rank() over (order by k) as x, {_mean_rank("v")} as y from m)""",
        EV)),
    "assoc_vif": (assoc_vif, q(f"""
        select ({NUMERIC})[i] as feature, {r("vif", 4)} as vif,
               case when vif > 5 then 'HIGH' when vif > 2 then 'MODERATE' else 'OK' end as level from v""",
        BL, NF, _inverse(NUMERIC)).replace("with ", "with recursive ", 1)),
    "assoc_vif_pair": (assoc_vif_pair, q(f"""
        , g as (select sum(avg_vtat * avg_vtat) as a, sum(avg_vtat * is_cancelled) as b, sum(is_cancelled)::double as c
                from bk where avg_vtat is not null)
        select f as feature, {r("1 / (1 - b * b / (a * c))")} as vif,
               case when 1 / (1 - b * b / (a * c)) > 5 then 'HIGH' when 1 / (1 - b * b / (a * c)) > 2 then 'MODERATE' else 'OK' end as level
        from g cross join (select unnest(['avg_vtat', 'is_cancelled']) as f)""", BL)),
    "assoc_mi_binned": (assoc_mi_binned, q(
        f"select feature, {r('m', 7)} as mutual_information from ("
        + " union all ".join(_mi(f) for f in NUMERIC) + ")", BL, NF)),
    "assoc_mi_knn": (assoc_mi_knn, q(_knn("nf", NUMERIC), BL, NF)),
    "assoc_mi_knn_value": (assoc_mi_knn_value, q(_knn("ev", ["value"]), EV)),
    "assoc_missing_spread": (assoc_missing_spread, q(
        " union all ".join(_spread(n, SPREAD_SQL[n]) for n in SPREAD), BK)),
    "assoc_logodds": (assoc_logodds, q(
        f"select feature, bin, n, {r('p')} as rate, case when p > 0 then {r('ln(p / (1 - p + 1e-10))')} end as log_odds from ("
        + " union all ".join(_logodds(f) for f in FEATURES) + ")", FT, "ftr as (select * from ft where split = 'train')")),
    "pivot_rates": (pivot_rates, q("select vtat_zone, " + ", ".join(
        r(f"avg(is_cancelled) filter (where vehicle_type = '{p}')") + f" as p{i}" for i, p in enumerate(PRIORITIES, 1))
        + f", count(*) filter (where coalesce(vehicle_type not in ({', '.join(repr(p) for p in PRIORITIES)}), true)) as n_unlisted"
        + " from zn where vtat_zone is not null group by 1", BK, ZN)),
    "pivot_hour_category": (pivot_hour_category, q("select h as hour, " + ", ".join(
        r(f"avg(is_cancelled) filter (where category = '{i}')") + f" as c{i}" for i in range(7))
        + ", count(*) filter (where coalesce(category::int not between 0 and 6, true)) as n_unlisted from ev group by 1", EV)),
    "pivot_bucket_peak": (pivot_bucket_peak, q(f"""
        select vtat_bucket::double as vtat_bucket, {r("avg(is_cancelled) filter (where is_peak_hour = 0)")} as off_peak,
               {r("avg(is_cancelled) filter (where is_peak_hour = 1)")} as peak_hour,
               count(*) filter (where coalesce(is_peak_hour not in (0, 1), true)) as n_unlisted
        from nf where vtat_bucket <> 'nan' group by 1""", BL, NF)),
    "pivot_spread": (pivot_spread, q(f"""
        , z as (select vtat_zone, vehicle_type, avg(is_cancelled) as m from zn where vtat_zone is not null group by 1, 2)
        select vtat_zone, {r("max(m) - min(m)")} as spread, {r("max(m)")} as max_rate, {r("min(m)")} as min_rate,
               first(vehicle_type order by m desc, vehicle_type) as max_category, first(vehicle_type order by m, vehicle_type) as min_category
        from z group by 1""", BK, ZN)),
}
