"""Classifier evaluation on (label, score) rows.

Scores are reduced to positives and negatives per threshold step or per distinct score in one shuffle;
curves, areas and sweeps are computed on those counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareflow.functions.columns import f_beta, ratio
from fareflow.scale import running_totals

# Project goals and threshold grids.
METRIC_TARGETS = {"f2": 0.68, "recall": 0.70, "precision": 0.60}
DEFAULT_THRESHOLD = 0.5
# start + i * step as an arange of doubles yields it: the step is (0.1 + 0.01) - 0.1
TUNING_GRID = [0.1 + i * ((0.1 + 0.01) - 0.1) for i in range(80)]
REPORT_GRID = [t / 100.0 for t in range(5, 96, 5)]


def predicted(score: str | Column, threshold: float | Column) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (s >= threshold).cast("int")


def confusion_cells(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, y, pred).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn as one row per group."""
    hit = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    return df.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"),
                               hit(0, 0).alias("tn"))


def rate_metrics(beta: float = 2.0) -> dict[str, Column]:
    """precision, recall, F-beta and F1 from columns tp, fp, fn; an undefined ratio is 0."""
    p = F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return {"precision": p, "recall": r, f"f{beta:g}": f_beta(p, r, beta), "f1": f_beta(p, r, 1.0)}


def score_table(df: DataFrame, y: str, score: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per distinct score: pos, neg and the counts with a higher score (tp_above, fp_above) and totals.

    ``weight``: the number of rows that each row stands for.
    Running totals over range slices keep it exact for any number of distinct scores.
    """
    label, n = F.col(y), F.col(weight) if weight else F.lit(1)
    counts = (df.where(label.isNotNull() & F.col(score).isNotNull())
              .groupBy(*by, F.col(score).alias("score"))
              .agg(F.sum(label * n).cast("bigint").alias("pos"), F.sum((1 - label) * n).cast("bigint").alias("neg")))
    placed = running_totals(counts, "score", ["pos", "neg"], by)
    return placed.select(*by, "score", "pos", "neg",
                         (F.col("pos_total") - F.col("pos_before") - F.col("pos")).alias("tp_above"),
                         (F.col("neg_total") - F.col("neg_before") - F.col("neg")).alias("fp_above"),
                         "pos_total", "neg_total")


def pr_curve(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tp, fp = F.col("tp_above") + F.col("pos"), F.col("fp_above") + F.col("neg")
    return scores.select(*by, "score", ratio(tp, tp + fp).alias("precision"), ratio(tp, "pos_total").alias("recall"))


def roc_curve(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    tp, fp = F.col("tp_above") + F.col("pos"), F.col("fp_above") + F.col("neg")
    return scores.select(*by, "score", ratio(fp, "neg_total").alias("fpr"), ratio(tp, "pos_total").alias("tpr"))


def curve_areas(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Average precision (step sum) and ROC area (pairs ranked right, ties half)."""
    tp, fp = F.col("tp_above") + F.col("pos"), F.col("fp_above") + F.col("neg")
    step = ratio("pos", "pos_total") * ratio(tp, tp + fp)
    pairs = ratio("neg", "neg_total") * ratio(F.col("tp_above") + F.col("pos") / F.lit(2.0), "pos_total")
    return scores.groupBy(*by).agg(F.sum(step).alias("pr_auc"), F.sum(pairs).alias("roc_auc"))


def evaluate(df: DataFrame, y: str, score: str, threshold: float | Column, by: Sequence[str] = (),
             weight: str | None = None) -> DataFrame:
    """f2, f1, precision, recall, pr_auc, roc_auc and the goal flags; one row per group.

    Everything, the confusion counts included, comes from the per-score counts: one shuffle of the rows.
    ``threshold`` may be a column over the group keys.
    """
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    scores = score_table(df, y, score, by, weight)
    hit = F.col("score") >= t
    tp, fp = F.col("tp_above") + F.col("pos"), F.col("fp_above") + F.col("neg")
    ap = ratio("pos", "pos_total") * ratio(tp, tp + fp)
    auc = ratio("neg", "neg_total") * ratio(F.col("tp_above") + F.col("pos") / F.lit(2.0), "pos_total")
    out = scores.groupBy(*by).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
        F.sum(ap).alias("pr_auc"), F.sum(auc).alias("roc_auc"),
    ).withColumns(rate_metrics())
    return out.withColumns({
        f"{m}_met": F.when(F.col(m) >= goal, 1).otherwise(0) for m, goal in METRIC_TARGETS.items()})


def threshold_sweep(df: DataFrame, y: str, score: str, by: Sequence[str] = (), grid: Sequence[float] = TUNING_GRID,
                    beta: float = 2.0) -> DataFrame:
    """Precision, recall and F-beta at every threshold of an evenly spaced grid, in one pass.

    Each row falls to the greatest threshold it reaches; counts per threshold are then summed from the
    top over at most ``len(grid) + 1`` rows per group.
    """
    grid = [float(t) for t in grid]
    last = len(grid) - 1
    t = F.array(*[F.lit(v) for v in grid])
    s = F.col(score)
    guess = F.floor((s - grid[0]) / ((grid[-1] - grid[0]) / max(last, 1)))
    i = F.least(F.greatest(guess, F.lit(0)), F.lit(last)).cast("int")
    reached = (F.when(s >= F.get(t, i + 1), i + 1).when(s >= F.get(t, i), i).otherwise(i - 1))
    counts = (df.where(F.col(y).isNotNull() & s.isNotNull()).groupBy(*by, reached.alias("i"))
              .agg(F.sum(y).cast("bigint").alias("pos"), F.sum(1 - F.col(y)).cast("bigint").alias("neg")))
    steps = F.explode(F.sequence(F.lit(-1), F.lit(last))).alias("i")
    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1)
    full = groups.select(*by, steps).join(counts, [*by, "i"], "left").na.fill(0, ["pos", "neg"])
    keys = list(by) or [F.lit(1)]
    down = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    cells = full.select(*by, "i", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
                        F.sum("pos").over(whole).alias("pos_total"))
    cells = cells.where(F.col("i") >= 0).withColumn("fn", F.col("pos_total") - F.col("tp"))
    m = rate_metrics(beta)
    return cells.select(*by, F.col("i").alias("step"), F.get(t, F.col("i")).alias("threshold"), "tp", "fp", "fn",
                        m[f"f{beta:g}"].alias("f_beta"), m["precision"].alias("precision"), m["recall"].alias("recall"))


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Smallest threshold with the highest F-beta; 0.5 and 0 when nothing scores above zero."""
    hit = F.when(F.col("f_beta") > 0, F.struct(F.col("f_beta"), -F.col("threshold")))
    return sweep.groupBy(*by).agg(F.max(hit).alias("best")).select(
        *by, F.coalesce(-F.col("best.col2"), F.lit(DEFAULT_THRESHOLD)).alias("best_threshold"),
        F.coalesce(F.col("best.f_beta"), F.lit(0.0)).alias("best_f_beta"))


def dummy_metrics(df: DataFrame, y: str) -> DataFrame:
    """Metrics of always predicting the majority class (the smaller label wins a tie)."""
    n1, n0 = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    out = df.agg(n0.alias("n0"), n1.alias("n1")).withColumn("majority", F.when(F.col("n1") > F.col("n0"), 1).otherwise(0))
    up = F.col("majority") == 1
    return out.withColumns({
        "tp": F.when(up, F.col("n1")).otherwise(0), "fp": F.when(up, F.col("n0")).otherwise(0),
        "fn": F.when(up, 0).otherwise(F.col("n1")),
    }).withColumns(rate_metrics()).select("majority", "precision", "recall", "f2", "f1")


def compare_models(metrics: DataFrame, selected: str) -> DataFrame:
    """Comparison table of per-model metric rows with the selected-model flag."""
    return metrics.select(
        "model_name", F.col("f2").alias("f2_score"), "recall", F.col("precision").alias("precision_score"),
        "pr_auc", "roc_auc", "optimal_threshold",
        (F.col("model_name") == selected).cast("int").alias("is_selected"))


def split_gap(metrics: DataFrame, names: Sequence[str], first: str = "val", second: str = "test") -> DataFrame:
    """Each metric on two splits and their difference, one row per metric."""
    pick = lambda m, s: F.max(F.when(F.col("split") == s, F.col(m)))
    wide = metrics.agg(*[F.struct(pick(m, first).alias("first"), pick(m, second).alias("second")).alias(m) for m in names])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}.first").alias(first),
                              F.col(f"{m}.second").alias(second),
                              (F.col(f"{m}.second") - F.col(f"{m}.first")).alias("gap")) for m in names])
    return wide.select(F.inline(rows))


def rank_results(results: DataFrame, score: str = "mean_score") -> DataFrame:
    """Search results ranked best first; the table has one row per parameter combination."""
    return results.withColumn("rank", F.rank().over(Window.orderBy(F.col(score).desc())))
