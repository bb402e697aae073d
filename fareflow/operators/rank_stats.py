"""Statistics that need a global order: Spearman, decile log-odds and mutual information.

The order is built over distinct values (counted first) and spread over range slices by
``running_totals``; no task ever sorts a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareflow.functions.columns import equal_width_bin, ratio
from fareflow.functions.pvalues import t_p
from fareflow.operators.association import pearson
from fareflow.scale import checkpointed, exact_quantiles, lookup_join, running_totals, value_counts_long


def centred_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, rank): mean rank of each distinct value, less the overall mean (n + 1) / 2."""
    ranked = running_totals(value_counts_long(df, columns), "value", ["n"], ["feature"])
    mid = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)
    return ranked.select("feature", "value", (mid - (F.col("n_total") + 1) / F.lit(2.0)).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, p_value: bool = False) -> DataFrame:
    """Rank correlation of two columns, one row: n, rho (and p by the t approximation).

    Rows are first counted by (x, y) pair; ranks are joined to the pairs, so equal rows cost one row.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    ranks = centred_ranks(rows, ["x", "y"])
    pick = lambda f: ranks.where(F.col("feature") == f).select(
        F.col("value").alias(f), F.col("rank").alias(f"r{f}"))
    # a column of few values (a 0/1 target) is broadcast, not hashed to as many tasks as it has values
    pairs = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    pairs = lookup_join(lookup_join(pairs, pick("x"), "x", "inner"), pick("y"), "y", "inner")
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    out = pairs.agg(F.sum("n").alias("n"), F.sum(n * rx * ry).alias("xy"), F.sum(n * rx * rx).alias("xx"),
                    F.sum(n * ry * ry).alias("yy")).select("n", ratio("xy", F.sqrt("xx") * F.sqrt("yy")).alias("rho"))
    if not p_value:
        return out
    t = F.col("rho") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    return out.withColumn("p_value", t_p(t, (F.col("n") - 2).cast("double")))


def spearman_trend(series: DataFrame, x: str, y: str, p_value: bool = False) -> DataFrame:
    """Spearman on a grouped series (one row per day or minute).

    A series is bounded by the calendar, so plain rank windows over it are enough.
    """
    rows = series.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    mid = lambda c: (F.rank().over(Window.orderBy(c))
                     + (F.count("*").over(Window.partitionBy(c)) - 1) / F.lit(2.0))
    out = rows.select(mid("x").alias("rx"), mid("y").alias("ry")).agg(
        F.count("*").alias("n"), pearson("rx", "ry").alias("rho"))
    if not p_value:
        return out
    t = F.col("rho") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    return out.withColumn("p_value", t_p(t, (F.col("n") - 2).cast("double")))


# -- decile log-odds -----------------------------------------------------------------------------------

def log_odds(p: Column) -> Column:
    """ln(p / (1 - p + 1e-10)); a rate of zero has none."""
    return F.when(p > 0, F.log(p / (1 - p + F.lit(1e-10))))


def decile_log_odds(df: DataFrame, columns: Sequence[str], target: str = "is_cancelled", q: int = 10) -> DataFrame:
    """Quantile bins (equal edges merged, lowest value included) with rate and log-odds per feature."""
    counts = checkpointed(value_counts_long(df, columns, {"pos": F.sum(F.col(target)), "n_y": F.count(F.col(target))}))
    edges = exact_quantiles(counts.select("feature", "value", "n"), [i / q for i in range(q + 1)])
    cuts = edges.groupBy("feature").agg(F.array_sort(F.collect_set("value")).alias("cuts"))  # q + 1 values each
    placed = counts.join(F.broadcast(cuts), "feature")
    below = F.size(F.filter("cuts", lambda e: e < F.col("value")))
    b = F.greatest(below, F.lit(1)) - 1
    return placed.groupBy("feature", b.cast("int").alias("bin")).agg(
        F.sum("n").alias("n"), ratio(F.sum("pos"), F.sum("n_y")).alias("rate"),
    ).withColumn("log_odds", log_odds(F.col("rate")))


# -- mutual information --------------------------------------------------------------------------------

def _cells(df: DataFrame, columns: Sequence[str], target: str, bins: int) -> DataFrame:
    """Rows per (feature, bin, y)."""
    # the bin edges are fitted first: two numbers per feature
    spans = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c)
                     for c in columns]).first()
    ranged = [c for c in columns if spans[c]["lo"] is not None]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 equal_width_bin(F.col(c).cast("double"), spans[c]["lo"], spans[c]["hi"], bins).alias("bin"))
        for c in ranged])
    return (df.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.inline(pairs))
            .where(F.col("bin").isNotNull()).groupBy("feature", "bin", "y").agg(F.count("*").alias("o")))


def binned_mutual_information(df: DataFrame, columns: Sequence[str], target: str = "is_cancelled",
                              bins: int = 20, few_values: bool = False) -> DataFrame:
    """Plug-in mutual information (nats) of equal-width bins and the target, per feature.

    ``few_values``: the columns are counted by value first, and spans and bins come from the counts, so the rows are
    read once instead of twice. It is exact for any columns, and small for columns of few values.
    """
    if few_values:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
        counts = checkpointed(df.select(F.col(target).alias("y"), F.inline(pairs)).where(F.col("value").isNotNull())
                              .groupBy("feature", "value", "y").agg(F.count("*").alias("n")))
        spans = counts.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row each
        cells = (counts.where(F.col("y").isNotNull()).join(F.broadcast(spans), "feature")
                 .select("feature", equal_width_bin("value", "lo", "hi", bins).alias("bin"), "y", "n")
                 .where(F.col("bin").isNotNull()).groupBy("feature", "bin", "y").agg(F.sum("n").alias("o")))
    else:
        cells = _cells(df, columns, target, bins)
    # at most bins x classes rows per feature from here on
    both = Window.partitionBy("feature")
    n = F.sum("o").over(both)
    r = F.sum("o").over(Window.partitionBy("feature", "bin"))
    c = F.sum("o").over(Window.partitionBy("feature", "y"))
    terms = cells.select("feature", (ratio("o", n) * F.log(ratio(F.col("o") * n, r * c))).alias("t"))
    return terms.groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("mutual_information"))


def digamma(x: Column) -> Column:
    """Digamma of a positive column: recurrence up to x + 6, then the asymptotic series."""
    x = x.cast("double")
    shift = sum((1 / (x + i) for i in range(1, 6)), 1 / x)
    z = x + 6
    z2 = z * z
    return F.log(z) - 1 / (2 * z) - 1 / (12 * z2) + 1 / (120 * z2 * z2) - 1 / (252 * z2 * z2 * z2) - shift


def _with_neighbours(counts: DataFrame, k: int) -> DataFrame:
    """Add ``near``: the k distinct same-class values on either side of each value, with their counts.

    Values are range-sliced; the k rows on either side of a slice border come from a table that holds the
    first and last k rows of every slice, 2k rows per slice at most.
    """
    keys = ["feature", "y"]
    spark = counts.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        counts.repartitionByRange(slices, *keys, "value").withColumn("slice", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "slice").orderBy("value")
    edge = placed.withColumns({
        "first": F.row_number().over(inner),
        "last": F.row_number().over(Window.partitionBy(*keys, "slice").orderBy(F.col("value").desc())),
    }).where((F.col("first") <= k) | (F.col("last") <= k))
    item = F.struct(F.col("value").alias("v"), F.col("n").alias("n"))
    across = Window.partitionBy(*keys).orderBy("value")
    edge = edge.withColumns({
        "before": F.collect_list(item).over(across.rowsBetween(-k, -1)),
        "after": F.collect_list(item).over(across.rowsBetween(1, k)),
    })
    halo = edge.groupBy(*keys, "slice").agg(
        F.max(F.when(F.col("first") == 1, F.col("before"))).alias("before"),
        F.max(F.when(F.col("last") == 1, F.col("after"))).alias("after"))
    rows = placed.withColumns({
        "left": F.collect_list(item).over(inner.rowsBetween(-k, -1)),
        "right": F.collect_list(item).over(inner.rowsBetween(1, k)),
    })
    left = F.concat("before", "left")
    right = F.concat("right", "after")
    return rows.join(F.broadcast(halo), [*keys, "slice"]).select(
        *counts.columns,
        F.concat(F.slice(left, F.greatest(F.size(left) - k + 1, F.lit(1)), k), F.slice(right, 1, k)).alias("near"))


def knn_mutual_information(df: DataFrame, columns: Sequence[str], target: str = "is_cancelled", k: int = 5) -> DataFrame:
    """Nearest-neighbour mutual information (nats) of continuous columns and a class, per feature.

    Each value's radius is the distance to its k-th neighbour of the same class; the estimate compares k
    with the number of points of any class inside the radius. Repeated values, which the usual estimator
    separates by adding noise, are counted as they are: with more than k copies of a value in its class,
    the copies take the place of k. All steps work on distinct values with counts.
    """
    rows = df.where(F.col(target).isNotNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = (rows.select(F.col(target).alias("y"), pairs.alias("p")).where(F.col("p.value").isNotNull())
              .groupBy("p.feature", "y", "p.value").agg(F.count("*").alias("n")))
    counts = checkpointed(counts)
    sizes = counts.groupBy("feature", "y").agg(F.sum("n").alias("n_class"))  # features x classes rows
    used = counts.join(F.broadcast(sizes.where(F.col("n_class") > 1)), ["feature", "y"])
    near = _with_neighbours(used, k)
    k_row = F.least(F.lit(k), F.col("n_class") - 1)
    missing = k_row - (F.col("n") - 1)
    by_distance = F.array_sort(F.transform("near", lambda s: F.struct(
        F.abs(s["v"] - F.col("value")).alias("d"), s["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0.0).alias("d"))
    reach = F.aggregate(by_distance, start, lambda acc, s: F.when(acc["seen"] >= missing, acc).otherwise(
        F.struct((acc["seen"] + s["n"]).alias("seen"), s["d"].alias("d"))))
    radii = near.select("feature", "y", "value", "n", "n_class", k_row.alias("k"),
                        F.when(missing <= 0, F.lit(0.0)).otherwise(reach["d"]).alias("radius"))
    # at most one row per class in each window
    radii = checkpointed(radii.withColumn("n_all", F.sum("n").over(Window.partitionBy("feature", "value"))))
    # points strictly inside the radius; the margin covers the rounding of value +- radius, and a radius
    # of a few last digits (or zero) holds the copies of the value only
    rounding = F.abs("value") * 4.5e-16
    exact = F.col("radius") <= rounding * 8
    inner = F.col("radius") - F.greatest(F.col("radius") * 1e-9, rounding)
    ends = F.array(F.struct(F.lit(-1).alias("side"), (F.col("value") - inner).alias("pos")),
                   F.struct(F.lit(1).alias("side"), (F.col("value") + inner).alias("pos")))
    queries = radii.where(~exact).select("feature", "y", "value", F.inline(ends)).withColumn("w", F.lit(0).cast("bigint"))
    points = used.groupBy("feature", F.col("value").alias("pos")).agg(F.sum("n").alias("w")).select(
        "feature", F.lit(None).cast(counts.schema["y"].dataType).alias("y"), F.lit(None).cast("double").alias("value"),
        F.lit(0).alias("side"), "pos", "w")
    ranked = running_totals(points.unionByName(queries), "pos", ["w"], ["feature"]).where(F.col("side") != 0)
    inside = ranked.groupBy("feature", "y", "value").agg(F.sum(F.col("side") * F.col("w_before")).alias("m"))
    joined = radii.join(inside, ["feature", "y", "value"], "left").withColumn(
        "m", F.when(exact, F.col("n_all")).otherwise(F.col("m")))
    copies = F.col("radius") == 0
    weight = F.col("n").cast("double")
    per = joined.groupBy("feature").agg(
        F.sum("n").alias("total"),
        F.sum(weight * digamma(F.when(copies, F.col("n")).otherwise(F.col("k")))).alias("a"),
        F.sum(weight * digamma(F.col("n_class"))).alias("b"),
        F.sum(weight * digamma(F.col("m"))).alias("c"))
    mi = digamma(F.col("total")) + (F.col("a") - F.col("b") - F.col("c")) / F.col("total")
    return per.select("feature", F.greatest(mi, F.lit(0.0)).alias("mutual_information"))
