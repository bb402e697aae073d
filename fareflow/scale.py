"""Building blocks that keep the operators safe on large and skewed data.

* ``checkpointed``      cuts lineage in the shared checkpoint folder of the cluster; ``written`` does so as parquet.
* ``lookup_join``       broadcasts a table only after measuring it, else shuffles.
* ``split_hot_keys``    joins per-key counts back to rows without sending a hot key to one task.
* ``running_totals``    cumulative sums over an ordering, spread over range slices.
* ``exact_quantiles``   interpolated quantiles of many columns from running totals.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_CHARS = 32 * 1024 * 1024
HOT_SHARE = 0.001


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only for local runs that have none."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        folder = tempfile.mkdtemp(prefix="fareflow-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``checkpointed`` as parquet in the checkpoint folder: columns of few values take a small part of the disk."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    saved = df.sparkSession.read.schema(df.schema).parquet(folder)
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return saved.repartition(wanted) if saved.rdd.getNumPartitions() < wanted else saved


def spread(saved: DataFrame) -> DataFrame:
    """Use all cores for a checkpointed table that is read many times; enough partitions are left alone."""
    wanted = saved.sparkSession.sparkContext.defaultParallelism
    return checkpointed(saved.repartition(wanted)) if saved.rdd.getNumPartitions() < wanted else saved


def fits_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS, max_chars: int = BROADCAST_CHARS) -> bool:
    """Measure a (materialised) table; at most ``max_rows + 1`` rows are looked at."""
    text = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType)]
    chars = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(0)).cast("long")
    size = table.limit(max_rows + 1).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(chars), F.lit(0)).alias("chars")
    ).first()
    return size["rows"] <= max_rows and size["chars"] <= max_chars


def lookup_join(df: DataFrame, table: DataFrame, on: str | Sequence[str], how: str = "left",
                broadcast: bool | None = None) -> DataFrame:
    """Join a lookup table that has one row per key.

    ``broadcast`` may carry an earlier measurement; otherwise the table is measured here. A table over
    the limit is joined by shuffle, with ``split_hot_keys`` style skew left to AQE.
    """
    small = fits_broadcast(table) if broadcast is None else broadcast
    return df.join(F.broadcast(table) if small else table, on, how)


def totals_of(df: DataFrame, **aggregates: Column) -> Column:
    """One-row aggregate of ``df`` as a scalar struct, read as ``t["name"]``."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("t")).scalar()


def split_hot_keys(rows: DataFrame, keys: Sequence[str], wanted: Column, how: str = "left_semi",
                   hot_share: float = HOT_SHARE) -> DataFrame:
    """Attach ``n_rows`` (rows per key) or keep rows whose key satisfies ``wanted(n_rows)``.

    Keys holding at least ``hot_share`` of all rows number at most ``1 / hot_share``, so that table is
    bounded and broadcast: rows of hot keys are never shuffled. The remaining rows are joined by shuffle,
    where no key can exceed ``hot_share`` of the data. Null keys compare equal.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    total = totals_of(counts, n=F.sum("n_rows"))["n"]
    hot_limit = F.greatest(total * F.lit(hot_share), F.lit(2.0))
    renamed = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], "n_rows")
    hot = renamed.where(F.col("n_rows") >= hot_limit)
    cold = renamed.where((F.col("n_rows") < hot_limit) & wanted)

    def same(left: DataFrame, right: DataFrame) -> Column:
        condition = F.lit(True)
        for k in keys:
            condition = condition & left[k].eqNullSafe(right[f"__{k}"])
        return condition

    keep = how == "left_semi"
    columns = rows.columns if keep else [*rows.columns, "n_rows"]
    from_hot = rows.join(F.broadcast(hot), same(rows, hot), "inner").where(wanted).select(*columns)
    rest = rows.join(F.broadcast(hot), same(rows, hot), "left_anti")
    if keep:
        from_cold = rest.join(cold, same(rest, cold), "left_semi").select(*columns)
    else:
        from_cold = rest.join(cold, same(rest, cold), "inner").select(*columns)
    return from_hot.unionByName(from_cold)


def running_totals(values: DataFrame, order_by: str, sums: Sequence[str], groups: Sequence[str] = (),
                   slices: int | None = None) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller ``order_by``) and ``<s>_total`` per group.

    ``values`` holds one row per (groups, order_by). Rows are range-partitioned into slices, the slice
    number is fixed by a checkpoint, and only the slice totals (slices + groups rows) are accumulated in
    one window; the rest happens inside each slice.
    """
    groups = list(groups)
    count = slices or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        values.repartitionByRange(count, *groups, order_by).withColumn("slice", F.spark_partition_id())
    )
    per_slice = placed.groupBy(*groups, "slice").agg(*[F.sum(s).alias(s) for s in sums])
    ordered = Window.partitionBy(*groups).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = per_slice.select(
        *groups, "slice",
        *[F.coalesce(F.sum(s).over(ordered), F.lit(0)).alias(f"{s}_offset") for s in sums],
        *[F.sum(s).over(whole).alias(f"{s}_total") for s in sums],
    )
    inner = Window.partitionBy(*groups, "slice").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(offsets), [*groups, "slice"]).select(
        *values.columns,
        *[(F.col(f"{s}_offset") + F.coalesce(F.sum(s).over(inner), F.lit(0))).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def value_counts_long(df: DataFrame, columns: Sequence[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per (feature, value) with counts; all columns in a single pass with map-side combine.

    ``extra`` adds further aggregates over the row's other columns.
    """
    extra = extra or {}
    used = sorted({c for c in df.columns if c not in columns})
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ]))
    carried = used if extra else []
    return (
        df.select(*carried, pairs.alias("pair"))
        .where(F.col("pair.value").isNotNull())
        .groupBy(F.col("pair.feature").alias("feature"), F.col("pair.value").alias("value"))
        .agg(F.count("*").alias("n"), *[e.alias(name) for name, e in extra.items()])
    )


def exact_quantiles(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per feature from (feature, value, n): columns feature, q, value."""
    ranked = running_totals(counts, "value", ["n"], ["feature"])
    points = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("q"),
                 (F.lit(float(p)) * (F.col("n_total") - 1)).alias("at")) for i, p in enumerate(probs)
    ])
    lo, hi = F.col("n_before"), F.col("n_before") + F.col("n")
    covers = F.filter(points, lambda s: ((F.floor(s["at"]) >= lo) & (F.floor(s["at"]) < hi))
                      | ((F.ceil(s["at"]) >= lo) & (F.ceil(s["at"]) < hi)))
    hits = ranked.select("feature", "value", "n_before", "n", F.explode(covers).alias("s"))
    low = F.when((F.floor("s.at") >= lo) & (F.floor("s.at") < hi), F.col("value"))
    high = F.when((F.ceil("s.at") >= lo) & (F.ceil("s.at") < hi), F.col("value"))
    return (
        hits.groupBy("feature", F.col("s.i").alias("i"), F.col("s.q").alias("q"))
        .agg(F.max(low).alias("low"), F.max(high).alias("high"), F.max("s.at").alias("at"))
        .select("feature", "i", "q",
                (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("value"))
    )
