"""Shared pieces of the reference SQL (DuckDB dialect), written independently of the DataFrame code."""

from __future__ import annotations


def r(expr: str, digits: int = 6) -> str:
    return f"(round(cast({expr} as double), {digits}) + 0.0)"


BK = """bk as (
  select l_orderkey || '-' || l_linenumber as booking_id, cast(o_custkey as varchar) as customer_id,
         cast(l_shipdate as date) as date, o_orderpriority as vehicle_type,
         cast(l_suppkey as varchar) as pickup_location, p_brand as drop_location,
         case when l_discount = 0.0 then null else round(l_quantity * 2 / 5, 1) end as avg_vtat,
         case when l_returnflag = 'R' then 1 else 0 end as is_cancelled,
         l_returnflag as status, l_tax, l_extendedprice, l_quantity, l_linestatus,
         (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 86400 as sec,
         case when l_shipdate < timestamp '2000-03-01' then 'train'
              when l_shipdate < timestamp '2001-01-01' then 'val' else 'test' end as split
  from lineitem, orders, part where l_orderkey = o_orderkey and l_partkey = p_partkey)"""

# light form: no joins needed
BL = """bk as (
  select l_orderkey || '-' || l_linenumber as booking_id, cast(l_shipdate as date) as date,
         cast(l_suppkey as varchar) as pickup_location,
         case when l_discount = 0.0 then null else round(l_quantity * 2 / 5, 1) end as avg_vtat,
         case when l_returnflag = 'R' then 1 else 0 end as is_cancelled, l_returnflag as status,
         (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 86400 as sec,
         case when l_shipdate < timestamp '2000-03-01' then 'train'
              when l_shipdate < timestamp '2001-01-01' then 'val' else 'test' end as split
  from lineitem)"""

TIME_TEXT = ("lpad(cast(sec // 3600 as varchar), 2, '0') || ':' || lpad(cast((sec // 60) % 60 as varchar), 2, '0')"
             " || ':' || lpad(cast(sec % 60 as varchar), 2, '0')")

EV = """ev as (
  select event_id, ts, cast(ts as date) as date, extract(hour from ts) as h, extract(minute from ts) as mi,
         cast(user_id % 7 as varchar) as category, value,
         case event_type when 'error' then 1 else 0 end as is_cancelled from events)"""

SC = """sc as (
  select case when l_returnflag = 'R' then 1 else 0 end as y,
         case when l_shipdate < timestamp '2000-03-01' then 'train'
              when l_shipdate < timestamp '2001-01-01' then 'val' else 'test' end as split,
         round(((l_orderkey * 7 + l_linenumber * 13) % 100 + case when l_returnflag = 'R' then 30 else 0 end) / cast(130 as double), 2) as p_a,
         round(((l_orderkey * 11 + l_linenumber * 17) % 100 + case when l_returnflag = 'R' then 15 else 0 end) / cast(115 as double), 2) as p_b,
         round(((l_orderkey * 3 + l_linenumber * 29) % 100 + case when l_returnflag = 'R' then 10 else 0 end) / cast(110 as double), 2) as p_c,
         cast(l_shipdate as date) as date
  from lineitem)"""

# long form: one row per model and booking
SCM = SC + """, scm as (
  select 'alpha' as model_name, y, split, p_a as p, date from sc union all
  select 'beta', y, split, p_b, date from sc union all
  select 'gamma', y, split, p_c, date from sc)"""

# the fitted feature chain
FT = BK + """, tr as (select * from bk where split = 'train'),
med as (select vehicle_type as v, median(avg_vtat) as m from tr where vehicle_type is not null group by 1),
lab as (select v, row_number() over (order by v) - 1 as code from (select distinct coalesce(vehicle_type, 'nan') as v from tr)),
gm as (select avg(is_cancelled) as m, median(avg_vtat) as mv from tr),
tp as (select pickup_location as k from tr where pickup_location is not null group by 1 order by count(*) desc, 1 limit 10),
td as (select drop_location as k from tr where drop_location is not null group by 1 order by count(*) desc, 1 limit 10),
ep as (select coalesce(k, 'Other') as k, (sum(is_cancelled) + 10 * (select m from gm)) / (count(*) + 10) as e
       from tr left join tp on pickup_location = k group by 1),
ed as (select coalesce(k, 'Other') as k, (sum(is_cancelled) + 10 * (select m from gm)) / (count(*) + 10) as e
       from tr left join td on drop_location = k group by 1),
f0 as (
  select bk.*, coalesce(bk.avg_vtat, med.m, gm.mv) as avg_vtat_imputed, sec // 3600 as hour,
         isodow(bk.date) - 1 as dayofweek, month(bk.date) as month, coalesce(lab.code, -1) as vehicle_type_encoded,
         coalesce(tp.k, 'Other') as pg, coalesce(td.k, 'Other') as dg
  from bk cross join gm left join med on bk.vehicle_type = med.v
  left join lab on coalesce(bk.vehicle_type, 'nan') = lab.v
  left join tp on bk.pickup_location = tp.k left join td on bk.drop_location = td.k),
ft as (
  select f0.*, ep.e as pickup_encoded, ed.e as drop_encoded,
         case when avg_vtat_imputed <= 0 then null when avg_vtat_imputed <= 5 then 0.0 when avg_vtat_imputed <= 10 then 1.0
              when avg_vtat_imputed <= 15 then 2.0 when avg_vtat_imputed <= 20 then 3.0 end::double as vtat_bucket,
         case when avg_vtat_imputed >= 15 then 1 else 0 end as is_high_vtat,
         case when dayofweek in (5, 6) then 1 else 0 end as is_weekend,
         case when hour in (7, 8, 9, 10, 17, 18, 19, 20, 21) then 1 else 0 end as is_peak_hour,
         case when hour in (23, 0, 1, 2, 3, 4, 5) then 1 else 0 end as is_late_night,
         sin(2 * pi() * hour / 24) as hour_sin, cos(2 * pi() * hour / 24) as hour_cos,
         sin(2 * pi() * dayofweek / 7) as dow_sin, cos(2 * pi() * dayofweek / 7) as dow_cos,
         sin(2 * pi() * month / 12) as month_sin, cos(2 * pi() * month / 12) as month_cos
  from f0 left join ep on f0.pg = ep.k left join ed on f0.dg = ed.k)"""


def q(body: str, *ctes: str) -> str:
    """Statement with its common tables; a body may start with further ones after a comma."""
    return "with " + ",\n".join(ctes) + "\n" + body.strip()
