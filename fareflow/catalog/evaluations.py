"""Queries on metrics, curves, threshold sweeps and business value, over deterministic scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from fareflow.catalog.sql import SC, SCM, q, r
from fareflow.functions.columns import rounded
from fareflow.operators import business as b
from fareflow.operators import evaluation as ev
from fareflow.scale import totals_of
from fareflow.sources.tables import bookings, table

MODELS = {"alpha": "score", "beta": "score_b", "gamma": "score_c"}
SELECTED = "alpha"
METRICS = ["f2", "f1", "precision", "recall", "pr_auc", "roc_auc"]


def model_scores(spark, sf):
    """(model_name, y, split, p): three score columns unpivoted in one scan."""
    df = bookings(spark, sf, "y", "split", *MODELS.values())
    rows = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(c).alias("p")) for m, c in MODELS.items()])
    return df.select("y", "split", F.inline(rows))


def _r(df, *names, digits=6):
    return df.withColumns({n: rounded(n, digits) for n in names})


def eval_metrics(spark, sf):
    m = ev.evaluate(bookings(spark, sf, "y", "score"), "y", "score", 0.5)
    return _r(m, *METRICS)


def eval_metrics_exact(spark, sf):
    """Unrounded scores: every distinct score is a step, ordered by range slices."""
    li = table(spark, sf, "lineitem")
    df = li.select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
                   (F.col("l_extendedprice") / 200000).alias("p"))
    return _r(ev.evaluate(df, "y", "p", 0.25), *METRICS)


def eval_confusion(spark, sf):
    df = bookings(spark, sf, "y", "score").withColumn("pred", ev.predicted("score", 0.45))
    return ev.confusion_cells(df, "y", "pred")


def eval_threshold_sweep(spark, sf):
    s = ev.threshold_sweep(bookings(spark, sf, "y", "score"), "y", "score")
    return _r(s, "threshold", "f_beta", "precision", "recall")


def eval_best_threshold(spark, sf):
    s = ev.threshold_sweep(model_scores(spark, sf), "y", "p", ["model_name"])
    return _r(ev.best_threshold(s, ["model_name"]), "best_threshold", "best_f_beta")


def eval_pr(spark, sf):
    s = ev.score_table(bookings(spark, sf, "y", "score"), "y", "score")
    return _r(ev.pr_curve(s), "precision", "recall")


def eval_roc(spark, sf):
    s = ev.score_table(bookings(spark, sf, "y", "score"), "y", "score")
    return _r(ev.roc_curve(s), "fpr", "tpr")


def eval_areas(spark, sf):
    s = ev.score_table(model_scores(spark, sf), "y", "p", ["model_name"])
    return _r(ev.curve_areas(s, ["model_name"]), "pr_auc", "roc_auc")


def eval_dummy(spark, sf):
    return _r(ev.dummy_metrics(bookings(spark, sf, "y"), "y"), "f2")


def eval_gap(spark, sf):
    m = ev.evaluate(bookings(spark, sf, "y", "score", "split"), "y", "score", 0.45, ["split"])
    return _r(ev.split_gap(m, METRICS), "val", "test", "gap")


def test_metrics(spark, sf):
    """Per model: threshold tuned on val rows, metrics on test rows."""
    scored = model_scores(spark, sf)
    best = ev.best_threshold(ev.threshold_sweep(scored.where("split = 'val'"), "y", "p", ["model_name"]), ["model_name"])
    # one row per model
    test = scored.where("split = 'test'").join(F.broadcast(best), "model_name")
    m = ev.evaluate(test, "y", "p", F.col("best_threshold"), ["model_name", "best_threshold"])
    return m.withColumnRenamed("best_threshold", "optimal_threshold")


def eval_compare(spark, sf):
    c = ev.compare_models(test_metrics(spark, sf), SELECTED)
    return _r(c, "f2_score", "recall", "precision_score", "pr_auc", "roc_auc", "optimal_threshold").orderBy(
        F.col("f2_score").desc())


def eval_rank(spark, sf):
    m = test_metrics(spark, sf).select("model_name", F.col("f1").alias("mean_score"))
    return _r(ev.rank_results(m), "mean_score")


def confusion_days(spark, sf):
    """Confusion counts of the selected score at 0.45 with the number of observed days."""
    df = bookings(spark, sf, "y", "score", "date").withColumn("pred", ev.predicted("score", 0.45))
    return ev.confusion(df, "y", "pred"), totals_of(df, n=F.count_distinct("date"))["n"]


def biz_net_value(spark, sf):
    df = bookings(spark, sf, "y", "score").withColumn("pred", ev.predicted("score", 0.45))
    return b.net_value(df, "y", "pred")


def biz_costs(spark, sf):
    cells, days = confusion_days(spark, sf)
    return _r(b.impact(cells, days), "interventions_daily", "roi_pct", "expected_savings", "expected_savings_annual")


def biz_break_even(spark, sf):
    cells, _ = confusion_days(spark, sf)
    out = b.break_even(cells)
    return _r(out, *out.columns)


def _pr(tp, fp, fn):
    p, rc = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
    return p, rc


def _fb(p, rc, b2):
    return f"coalesce((1 + {b2}) * {p} * {rc} / nullif({b2} * {p} + {rc}, 0), 0)"


def curve(src: str, by: str = "1") -> str:
    """Cumulative counts per distinct score, highest first."""
    return f"""(select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by g) as np, sum(neg) over (partition by g) as nn
      from (select {by} as g, p, sum(y) as pos, sum(1 - y) as neg from {src} group by 1, 2)
      window w as (partition by g order by p desc rows unbounded preceding))"""


def areas(src: str, by: str = "1") -> str:
    """Average precision, and the ROC area by the trapezoid rule."""
    return f"""(select g, sum(pos / np * tp / (tp + fp)) as ap, sum((fp - pf) / nn * (tp + pt) / np / 2) as auc
      from (select *, coalesce(lag(fp) over (partition by g order by p desc), 0) as pf,
                   coalesce(lag(tp) over (partition by g order by p desc), 0) as pt from {curve(src, by)}) group by g)"""


def metrics_at(src: str, cond: str, by: str = "1") -> str:
    tp, fp, fn = "tp", "fp", "fn"
    p, rc = _pr(tp, fp, fn)
    return f"""(select *, {p} as pr, {rc} as rc, {_fb(p, rc, 4)} as f2, {_fb(p, rc, 1)} as f1 from (
      select {by} as g, count(*) filter (where {cond} and y = 1) as tp, count(*) filter (where {cond} and y = 0) as fp,
             count(*) filter (where not ({cond}) and y = 1) as fn, count(*) filter (where not ({cond}) and y = 0) as tn
      from {src} group by 1))"""


def full(src: str, cond: str, by: str = "1") -> str:
    return f"(select m.*, ap, auc from {metrics_at(src, cond, by)} m join {areas(src, by)} a on m.g = a.g)"


METRIC_COLUMNS = f"""tp, fp, fn, tn, {r("pr")} as precision, {r("rc")} as recall, {r("f2")} as f2, {r("f1")} as f1, {r("ap")} as pr_auc,
  {r("auc")} as roc_auc, (f2 >= 0.68)::int as f2_met, (rc >= 0.7)::int as recall_met, (pr >= 0.6)::int as precision_met"""
# the 80 tuning thresholds as doubles: start + i * step with the step of an arange
GRID = "(select i, cast(0.1 as double) + i * ((cast(0.1 as double) + cast(0.01 as double)) - cast(0.1 as double)) as t from range(80) x(i))"


def sweep(src: str, by: str, grid: str = GRID) -> str:
    """Brute force: every threshold against every distinct score."""
    p, rc = _pr("tp", "fp", "(np - tp)")
    return f"""(select *, {p} as pr, {rc} as rc, {_fb(p, rc, 4)} as fb from (
      select g, i, t, coalesce(sum(pos) filter (where p >= t), 0) as tp, coalesce(sum(neg) filter (where p >= t), 0) as fp, sum(pos) as np
      from (select {by} as g, p, sum(y) as pos, sum(1 - y) as neg from {src} group by 1, 2) cross join {grid} group by g, i, t))"""


BEST = f"""sw as (select * from {sweep("(select * from scm where split = 'val')", "model_name")}),
best as (select sw.g, min(t) as t from sw join (select g, max(fb) as m from sw group by g) x on x.g = sw.g and x.m = sw.fb group by sw.g),
tm as (select s.*, t from scm s join best on best.g = s.model_name where split = 'test'),
cmp as (select m.*, t from {full("tm", "p >= t", "model_name")} m join best on best.g = m.g)"""
CM = f"cm as (select * from {metrics_at('(select y, p_a as p from sc)', 'p >= 0.45')})"
ONE = "(select y, p_a as p from sc)"

QUERIES = {
    "eval_metrics": (eval_metrics, q(f"select {METRIC_COLUMNS} from {full(ONE, 'p >= 0.5')}", SC)),
    "eval_metrics_exact": (eval_metrics_exact, f"""
        with e as (select (l_returnflag = 'R')::int as y, l_extendedprice / 200000 as p from lineitem)
        select {METRIC_COLUMNS} from {full("e", "p >= 0.25")}"""),
    "eval_confusion": (eval_confusion, q("select y, (p_a >= 0.45)::int as pred, count(*) as n from sc group by 1, 2", SC)),
    "eval_threshold_sweep": (eval_threshold_sweep, q(f"""
        select i as step, {r("t")} as threshold, tp::bigint as tp, fp::bigint as fp, (np - tp)::bigint as fn, {r("fb")} as f_beta,
               {r("pr")} as precision, {r("rc")} as recall from {sweep(ONE, "1")}""", SC)),
    "eval_best_threshold": (eval_best_threshold, q(f"""
        , z as (select * from {sweep("scm", "model_name")})
        select g as model_name, {r("min(t)")} as best_threshold, {r("max(fb)")} as best_f_beta
        from (select *, max(fb) over (partition by g) as m from z) where fb = m group by g""", SCM)),
    "eval_pr": (eval_pr, q(f"select p as score, {r('tp / (tp + fp)')} as precision, {r('tp / np')} as recall from {curve(ONE)}", SC)),
    "eval_roc": (eval_roc, q(f"select p as score, {r('fp / nn')} as fpr, {r('tp / np')} as tpr from {curve(ONE)}", SC)),
    "eval_areas": (eval_areas, q(f"select g as model_name, {r('ap')} as pr_auc, {r('auc')} as roc_auc from {areas('scm', 'model_name')}", SCM)),
    "eval_dummy": (eval_dummy, "select 0 as majority, 0.0::double as precision, 0.0::double as recall, 0.0::double as f2, 0.0::double as f1"),
    "eval_gap": (eval_gap, q(f"""
        , m as (select * from {full("(select y, p_a as p, split from sc)", "p >= 0.45", "split")}),
        u as (unpivot (select g, f2, f1, pr as "precision", rc as recall, ap as pr_auc, auc as roc_auc from m)
              on f2, f1, "precision", recall, pr_auc, roc_auc into name metric value v)
        select metric, {r("max(v) filter (where g = 'val')")} as val, {r("max(v) filter (where g = 'test')")} as test,
               {r("max(v) filter (where g = 'test') - max(v) filter (where g = 'val')")} as gap from u group by metric""", SC)),
    "eval_compare": (eval_compare, q(f"""
        select g as model_name, {r("f2")} as f2_score, {r("rc")} as recall, {r("pr")} as precision_score, {r("ap")} as pr_auc,
               {r("auc")} as roc_auc, {r("t")} as optimal_threshold, (g = 'alpha')::int as is_selected from cmp order by f2 desc""", SCM, BEST)),
    "eval_rank": (eval_rank, q(f"""
        select g as model_name, {r("f1")} as mean_score, (select count(*) from cmp c2 where c2.f1 > cmp.f1) + 1 as rank from cmp""", SCM, BEST)),
    "biz_net_value": (biz_net_value, q("""
        select y, (p_a >= 0.45)::int as pred, count(*) as n, cast(count(*) * case when y = 1 and p_a >= 0.45 then 15
               when p_a >= 0.45 then -5 when y = 1 then -20 else 0 end as bigint) as net_value from sc group by y, 2, (y = 1 and p_a >= 0.45), (p_a >= 0.45)""", SC)),
    "biz_costs": (biz_costs, q(f"""
        select tp, fp, fn, tn, tp * 20 as gross_savings, fp * 5 as false_alarm_cost, fn * 20 as missed_cancellation_cost,
               tp * 15 - fp * 5 - fn * 20 as net_cost_matrix, tp * 20 - fp * 5 - fn * 20 as net_gross,
               {r("tp * 20 * 0.5 - fp * 5")} as expected_savings,
               {r("(tp * 20 * 0.5 - fp * 5) * 365 / (select count(distinct date) from sc)")} as expected_savings_annual,
               tp * 10 - fp * 5 as profit,
               {r("(tp + fp) / (select count(distinct date) from sc)")} as interventions_daily,
               {r("(tp * 10 - fp * 5) / (fp * 5) * 100")} as roi_pct from cm""", SC, CM)),
    "biz_break_even": (biz_break_even, q(f"""
        select {r("5 / 25")} as break_even_precision, {r("tp * 0.4::double / 0.6::double")} as fp_at_precision,
               {r("10 - 5 * 0.4::double / 0.6::double")} as savings_per_hit, {r("100000 / (10 - 5 * 0.4::double / 0.6::double)")} as required_tp,
               {r("100000 / (10 - 5 * 0.4::double / 0.6::double) / (tp + fn)")} as required_recall from cm""", SC, CM)),
}
