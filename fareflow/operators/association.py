"""Association between features and a binary target, and between categorical columns.

Each operator reduces the rows to a contingency or moment table in one shuffle and finishes with column
arithmetic on that table. Tail probabilities are added only where asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareflow.functions.columns import as_col, association_label, equal_width_bin, flag, ratio
from fareflow.functions.pvalues import chi2_p, fisher_p, t_p
from fareflow.operators.counts import group_rate
from fareflow.scale import totals_of

Z95 = 1.96


# -- categorical feature against binary target ---------------------------------------------------------

def nominal_vs_binary(df: DataFrame, feature: str, target: str = "is_cancelled") -> DataFrame:
    """Per category: volume, rate, 95 % Wilson interval, differs-from-mean flag, standardised residual."""
    g = group_rate(df, [feature], target)
    t = totals_of(g, n=F.sum("total"), pos=F.sum("cancelled"))
    n, p = F.col("total").cast("double"), F.col("cancel_rate")
    overall = ratio(t["pos"], t["n"])
    z2 = Z95 * Z95
    centre = ratio(p + z2 / (2 * n), 1 + z2 / n)
    half = ratio(Z95 * F.sqrt(ratio(p * (1 - p), n) + z2 / (4 * n * n)), 1 + z2 / n)
    expected = n * overall
    residual = ratio(F.col("cancelled") - expected, F.sqrt(expected))
    return g.where(F.col("total") > 0).select(
        feature, "total", "cancelled", (F.col("total") - F.col("cancelled")).alias("not_cancelled"),
        "cancel_rate", (centre - half).alias("ci_low"), (centre + half).alias("ci_high"),
        flag((centre - half > overall) | (centre + half < overall)).alias("differs"),
        expected.alias("expected"), residual.alias("residual"), flag(F.abs(residual) > 2).alias("is_notable"),
    )


def nominal_stats(df: DataFrame, feature: str, target: str = "is_cancelled", p_value: bool = False) -> DataFrame:
    """Chi-square, degrees of freedom and Cramer's V of one feature against a 0/1 target, one row."""
    pair = df.where(F.col(feature).isNotNull() & F.col(target).isNotNull())
    out = contingency_stats(
        pair.groupBy(F.lit(feature).alias("pair"), F.col(feature).cast("string").alias("a"),
                     F.col(target).cast("string").alias("b")).agg(F.count("*").alias("o")), yates=False)
    out = out.select(F.col("pair").alias("feature"), "n", "chi2", "dof", "cramers_v")
    return out.withColumn("p_value", chi2_p("chi2", F.col("dof").cast("double"))) if p_value else out


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cross-tab in long form; null keys are dropped."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a, b).agg(F.count("*").alias("n")))


def contingency_stats(cells: DataFrame, yates: bool = True) -> DataFrame:
    """Chi-square and Cramer's V per pair from cells (pair, a, b, o).

    chi2 = n (sum o^2 / (r c) - 1) needs no expected counts and covers absent cells. A 2 x 2 table takes
    the continuity correction, where every cell deviates from its expectation by the same amount, so one
    cell is enough. Levels are counted at the first cell of each row and column.
    """
    rows = cells.groupBy("pair", "a").agg(F.sum("o").alias("r"), F.min("b").alias("first_b"))
    cols = cells.groupBy("pair", "b").agg(F.sum("o").alias("c"), F.min("a").alias("first_a"))
    o, r, c = (F.col(x).cast("double") for x in "orc")
    per = cells.join(rows, ["pair", "a"]).join(cols, ["pair", "b"]).groupBy("pair").agg(
        F.sum("o").alias("n"), F.sum(o / r * (o / c)).alias("s"),
        F.count_if(F.col("b") == F.col("first_b")).alias("n_a"), F.count_if(F.col("a") == F.col("first_a")).alias("n_b"),
        F.max(F.struct(o.alias("o"), r.alias("r"), c.alias("c"))).alias("cell"))
    n = F.col("n").cast("double")
    o, r, c = F.col("cell.o"), F.col("cell.r"), F.col("cell.c")
    d = F.greatest(F.abs(o - r * c / n) - 0.5, F.lit(0.0))
    corrected = ratio(d * d * n * n, r * (n - r)) * ratio(n, c * (n - c))
    dof = (F.col("n_a") - 1) * (F.col("n_b") - 1)
    plain = n * F.greatest(F.col("s") - 1, F.lit(0.0))
    chi2 = F.when(dof == 0, F.lit(0.0)).when((dof == 1) & F.lit(yates), corrected).otherwise(plain)
    return per.select("pair", "n", "n_a", "n_b", chi2.alias("chi2"), dof.alias("dof")).withColumn(
        "cramers_v", F.coalesce(F.sqrt(ratio("chi2", n * F.least(F.col("n_a") - 1, F.col("n_b") - 1))), F.lit(0.0)))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cramer's V of two columns, one row; nulls count as the label 'nan'."""
    return cramers_matrix(df, [a, b], mirror=False)


def cramers_matrix(df: DataFrame, columns: Sequence[str], mirror: bool = True) -> DataFrame:
    """Cramer's V of all column pairs as rows (feature_a, feature_b, cramers_v).

    The rows are first counted by their whole combination of labels, so the pairs are expanded from the
    distinct combinations only, and one shuffle serves all pairs.
    """
    columns = list(columns)
    labels = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in columns]
    combos = df.select(*labels).groupBy(*columns).agg(F.count("*").alias("n"))
    pairs = [F.struct(F.lit(f"{i},{j}").alias("pair"), F.col(columns[i]).alias("a"), F.col(columns[j]).alias("b"))
             for i, j in combinations(range(len(columns)), 2)]
    cells = (combos.select("n", F.explode(F.array(*pairs)).alias("p"))
             .groupBy("p.pair", "p.a", "p.b").agg(F.sum("n").alias("o")))
    names = F.array(*[F.lit(c) for c in columns])
    at = F.split("pair", ",")
    stats = contingency_stats(cells).select(
        F.element_at(names, F.get(at, 0).cast("int") + 1).alias("feature_a"),
        F.element_at(names, F.get(at, 1).cast("int") + 1).alias("feature_b"), "n", "chi2", "dof", "cramers_v")
    if not mirror:
        return stats
    upper = stats.select("feature_a", "feature_b", "cramers_v")
    flipped = F.array(F.struct("feature_a", "feature_b", "cramers_v"),
                      F.struct(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "cramers_v"))
    both = upper.select(F.inline(flipped))
    diagonal = df.sparkSession.range(1).select(
        F.explode(names).alias("feature_a")).select("feature_a", F.col("feature_a").alias("feature_b"),
                                                    F.lit(1.0).alias("cramers_v"))
    return both.unionByName(diagonal)


def notable_pairs(stats: DataFrame, limit: float = 0.1) -> DataFrame:
    return (stats.where((F.col("cramers_v") > limit) & (F.col("feature_a") != F.col("feature_b")))
            .withColumn("strength", association_label("cramers_v")))


# -- binary feature against binary target --------------------------------------------------------------

def binary_vs_binary(df: DataFrame, features: Sequence[str], target: str = "is_cancelled",
                     p_value: bool = False) -> DataFrame:
    """2 x 2 counts, odds ratio with 95 % interval and signed phi per feature; all features in one pass.

    An empty cell makes the odds ratio 0 or infinite and leaves the interval NULL.
    """
    y = F.col(target)
    cell = lambda f, i, j: F.count_if((F.col(f) == i) & (y == j))
    wide = df.agg(*[F.struct(cell(f, 1, 1).alias("a"), cell(f, 1, 0).alias("b"),
                             cell(f, 0, 1).alias("c"), cell(f, 0, 0).alias("d")).alias(f) for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.a").alias("a"), F.col(f"{f}.b").alias("b"),
                              F.col(f"{f}.c").alias("c"), F.col(f"{f}.d").alias("d")) for f in features])
    out = wide.select(F.inline(rows))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    odds = F.when(b * c > 0, ratio(a * d, b * c)).when(a * d > 0, F.lit(float("inf")))
    spread = Z95 * F.sqrt(ratio(F.lit(1.0), a) + ratio(F.lit(1.0), b) + ratio(F.lit(1.0), c) + ratio(F.lit(1.0), d))
    full = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    out = out.withColumns({
        "odds_ratio": odds,
        "ci_low": F.when(full, F.exp(F.log(odds) - spread)),
        "ci_high": F.when(full, F.exp(F.log(odds) + spread)),
        "phi": ratio(a * d - b * c, F.sqrt((a + b) * (c + d) * (a + c) * (b + d))),
    })
    return out.withColumn("p_value", fisher_p("a", "b", "c", "d")) if p_value else out


# -- continuous feature against binary target ----------------------------------------------------------

def continuous_vs_binary(df: DataFrame, feature: str, target: str = "is_cancelled", bins: int = 50,
                         p_value: bool = False) -> DataFrame:
    """Class means, Cohen's d (pooled), Welch t and the overlap of the class histograms, one row."""
    x, y = F.col(feature).cast("double"), F.col(target)
    rows = df.where(x.isNotNull() & y.isNotNull())
    cls = lambda k: F.when(y == k, x)
    m = rows.agg(
        *[f(cls(k)).alias(f"{name}{k}") for k in (0, 1)
          for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))])
    span = totals_of(rows, low=F.min(x), high=F.max(x))
    hist = rows.groupBy(equal_width_bin(x, span["low"], span["high"], bins).alias("bin")).agg(
        F.count_if(y == 0).alias("h0"), F.count_if(y == 1).alias("h1"))
    h = totals_of(hist, n0=F.sum("h0"), n1=F.sum("h1"))
    overlap = totals_of(hist, v=F.sum(F.least(ratio("h0", h["n0"]), ratio("h1", h["n1"]))))["v"]
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    v0 = ratio(F.col("var0") * n0, n0 - 1)
    v1 = ratio(F.col("var1") * n1, n1 - 1)
    pooled = F.sqrt(ratio((n0 - 1) * v0 + (n1 - 1) * v1, n0 + n1 - 2))
    se2 = ratio(v0, n0) + ratio(v1, n1)
    gap = F.col("mean1") - F.col("mean0")
    dof = ratio(se2 * se2, ratio(ratio(v0, n0) * ratio(v0, n0), n0 - 1) + ratio(ratio(v1, n1) * ratio(v1, n1), n1 - 1))
    out = m.select("n0", "n1", "mean0", "mean1", ratio(gap, pooled).alias("cohens_d"),
                   ratio(gap, F.sqrt(se2)).alias("welch_t"), dof.alias("welch_dof"), overlap.alias("overlap"))
    return out.withColumn("p_value", t_p("welch_t", "welch_dof")) if p_value else out


def binned_trend(df: DataFrame, feature: str, width: float, target: str = "is_cancelled") -> DataFrame:
    """Count and rate per bucket of the given width."""
    low = F.floor(F.col(feature) / F.lit(width)) * F.lit(width)
    return group_rate(df.withColumn("bucket_low", low), ["bucket_low"], target)


def zone_breakdown(df: DataFrame, feature: str, zones: Sequence[tuple[float, float, str]],
                   target: str = "is_cancelled", width: float = 0.5) -> DataFrame:
    """Count and rate per narrow bucket and per named zone, from one shuffle over distinct values."""
    from fareflow.functions.columns import zoned
    per_value = group_rate(df, [feature], target)
    bucket = F.format_string("%.1f", F.floor(F.col(feature) / width) * width)
    kinds = F.array(F.struct(F.lit("bucket").alias("kind"), bucket.alias("label")),
                    F.struct(F.lit("zone").alias("kind"), zoned(feature, zones).alias("label")))
    return (per_value.select("cancelled", "total", F.inline(kinds)).where(F.col("label").isNotNull())
            .groupBy("kind", "label").agg(F.sum("total").alias("total"), F.sum("cancelled").alias("cancelled"))
            .withColumn("cancel_rate", ratio("cancelled", "total")))


# -- numeric columns -----------------------------------------------------------------------------------

def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson r over rows where both sides are present; NULL for a constant side."""
    a, b = as_col(x).cast("double"), as_col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    scale = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), F.nullif(scale, F.lit(0.0)))


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per ordered pair i <= j: n, mean_i, mean_j and the sum of centred products, over complete rows.

    Each task folds its Arrow batches into one k x k matrix with numpy, which is far cheaper than k * k
    JVM aggregate buffers per row; the task results are merged by a group-by of k * k rows per task.
    """
    k = len(columns)
    # nulls are dropped inside the fold: a filter would be pushed below the projections and repeat them
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])

    def fold(batches):
        n, mean, m2 = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            x = x[~np.isnan(x).any(axis=1)]
            if len(x):
                centre = x.mean(axis=0)
                c = x - centre
                gap, total = centre - mean, n + len(x)
                m2 += c.T @ c + np.outer(gap, gap) * (n * len(x) / total)
                mean += gap * (len(x) / total)
                n = total
        if n:
            i, j = np.triu_indices(k)
            yield pd.DataFrame({"i": i, "j": j, "n": n, "mi": mean[i], "mj": mean[j], "m2": m2[i, j]})

    parts = rows.mapInPandas(fold, "i int, j int, n bigint, mi double, mj double, m2 double")
    # merged around the common mean: sums of raw products would cancel where a mean is large against the spread
    n, cell = F.col("n"), Window.partitionBy("i", "j")  # one row per task in a cell
    common = lambda m: F.sum(n * F.col(m)).over(cell) / F.sum(n).over(cell)
    placed = parts.withColumns({"mean_i": common("mi"), "mean_j": common("mj")})
    apart = n * (F.col("mi") - F.col("mean_i")) * (F.col("mj") - F.col("mean_j"))
    return placed.groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.first("mean_i").alias("mean_i"), F.first("mean_j").alias("mean_j"),
        F.sum(F.col("m2") + apart).alias("centred"))


def correlation_pairs(df: DataFrame, columns: Sequence[str], complete: bool = False) -> DataFrame:
    """Pearson r for every pair, a before b in column order.

    ``complete`` uses only rows without nulls and suits many columns; otherwise each pair skips its own
    nulls, in one aggregation.
    """
    columns = list(columns)
    if complete:
        # k * (k + 1) / 2 values in one row
        cells = co_moments(df, columns).agg(F.collect_list(F.struct("i", "j", "centred")).alias("m"))
        own = F.map_from_entries(F.transform(F.filter("m", lambda c: c["i"] == c["j"]), lambda c: F.struct(c["i"], c["centred"])))
        off = cells.select(own.alias("own"), F.inline(F.filter("m", lambda c: c["i"] < c["j"])))
        names = F.array(*[F.lit(c) for c in columns])
        scale = F.sqrt(F.col("own")[F.col("i")] * F.col("own")[F.col("j")])
        return off.select(F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"),
                          F.try_divide(F.col("centred"), F.nullif(scale, F.lit(0.0))).alias("r"))
    pairs = list(combinations(range(len(columns)), 2))
    wide = df.agg(*[pearson(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(columns[i]).alias("feature_a"), F.lit(columns[j]).alias("feature_b"),
                              F.col(f"c{i}_{j}").alias("r")) for i, j in pairs])
    return wide.select(F.inline(rows))


def strong_pairs(pairs: DataFrame, limit: float = 0.5) -> DataFrame:
    return pairs.where(F.abs("r") > limit)


def target_correlations(df: DataFrame, columns: Sequence[str], target: str = "is_cancelled") -> DataFrame:
    """Signed and absolute correlation of each feature with the target."""
    wide = df.agg(*[pearson(c, target).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation"),
                              F.abs(F.col(c)).alias("abs_correlation")) for c in columns])
    return wide.select(F.inline(rows))


def point_biserial(df: DataFrame, x: str, by: str, target: str = "is_cancelled", p_value: bool = False) -> DataFrame:
    """Correlation of a continuous column with the target per group, with its t statistic."""
    both = F.count_if(F.col(x).isNotNull() & F.col(target).isNotNull())
    out = df.groupBy(by).agg(both.alias("n"), pearson(target, x).alias("r"))
    t = F.col("r") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    out = out.withColumn("t_stat", t)
    return out.withColumn("p_value", t_p("t_stat", (F.col("n") - 2).cast("double"))) if p_value else out


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation factors without intercept: VIF_i = G_ii * inverse(G)_ii.

    The uncentred k x k Gram matrix G follows from the co-moments; only those k * k values are inverted.
    Linearly dependent columns get infinity.
    """
    columns = list(columns)
    k = len(columns)
    product = F.col("centred") + F.col("n") * F.col("mean_i") * F.col("mean_j")
    gram = co_moments(df, columns).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "j", product.alias("g")))), lambda s: s["g"]).alias("g"))
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def invert(batches):
        for batch in batches:
            for values in batch["g"]:
                g = np.zeros((k, k))
                for (i, j), v in zip(upper, values, strict=True):
                    g[i, j] = g[j, i] = v
                scale = np.sqrt(np.diag(g))
                unit = g / np.outer(scale, scale)
                if np.linalg.cond(unit) < 1e13:
                    vif = np.diag(np.linalg.inv(unit))
                else:
                    # the null directions tell which columns depend on each other
                    w, v = np.linalg.eigh(unit)
                    null = v[:, w < 1e-12 * w.max()]
                    tied = (np.abs(null) > 1e-6).any(axis=1)
                    vif = np.where(tied, np.inf, np.diag(np.linalg.pinv(unit)))
                yield pd.DataFrame({"feature": columns, "vif": vif})

    out = gram.mapInPandas(invert, "feature string, vif double")
    return out.withColumn("level", F.when(F.col("vif") > 5, "HIGH").when(F.col("vif") > 2, "MODERATE").otherwise("OK"))


# -- interactions and missingness ----------------------------------------------------------------------

def pivot_rates(df: DataFrame, row: str, column: str, values: Sequence, target: str = "is_cancelled",
                names: Sequence[str] | None = None) -> DataFrame:
    """Mean target per row key and listed column value. The list makes the pivot a single pass.

    ``n_unlisted`` counts the rows whose value is not in the list (a null value included).
    """
    out = df.where(F.col(row).isNotNull()).groupBy(row)
    cells = [F.avg(F.when(F.col(column) == F.lit(v), F.col(target))).alias(n)
             for v, n in zip(values, names or [str(v) for v in values], strict=True)]
    listed = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return out.agg(*cells, F.count_if(~listed).alias("n_unlisted"))


def pivot_spread(df: DataFrame, row: str, column: str, target: str = "is_cancelled") -> DataFrame:
    """Per row key: widest rate gap over the column's categories, and which categories span it."""
    g = group_rate(df, [row, column], target)
    r, label = F.col("cancel_rate"), F.col(column)
    # smallest label wins a tie on either end
    return g.groupBy(row).agg(
        (F.max(r) - F.min(r)).alias("spread"),
        F.max(r).alias("max_rate"), F.min(r).alias("min_rate"),
        F.min_by(label, F.struct(-r, label)).alias("max_category"),
        F.min_by(label, F.struct(r, label)).alias("min_category"),
    )


def missing_spread(df: DataFrame, flag_column: str, features: Sequence[str]) -> DataFrame:
    """Missing rate over the categories of each feature: count of categories, min, max, spread in points."""
    combos = df.select(flag_column, *[F.col(f).cast("string").alias(f) for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("key")) for f in features])
    per = (combos.select(flag_column, F.inline(pairs)).where(F.col("key").isNotNull())
           .groupBy("feature", "key").agg(F.avg(flag_column).alias("rate")))
    return per.groupBy("feature").agg(
        F.count("*").alias("n_categories"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"),
        ((F.max("rate") - F.min("rate")) * 100).alias("spread_pp"))
