"""Streaming forms of scoring and monitoring, and the drift table behind the retrain rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.functions.columns import binned, ratio
from fareflow.operators.features import VTAT_BUCKETS, VTAT_EDGES
from fareflow.scale import totals_of

# Retrain rule.
RETRAIN_F2, RETRAIN_RECALL, DRIFT_LIMIT = 0.68, 0.85, 0.2


def score_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame],
                 score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch transform and model applied to a stream: projections and joins to static fit tables."""
    return score(transform(stream))


def windowed_rates(stream: DataFrame, ts: str = "ts", target: str = "is_cancelled", window: str = "1 hour",
                   lateness: str = "10 minutes") -> DataFrame:
    """Cancellation rate per tumbling window; rows later than the watermark are dropped."""
    return (
        stream.withWatermark(ts, lateness).groupBy(F.window(ts, window).alias("w"))
        .agg(F.sum(target).cast("bigint").alias("cancelled"), F.count(target).alias("total"))
        .select(F.col("w.start").alias("window_start"), "cancelled", "total", ratio("cancelled", "total").alias("cancel_rate"))
    )


def drift_table(df: DataFrame, column: str = "avg_vtat", split: str = "split", reference: str = "train") -> DataFrame:
    """Population stability index of the binned column, each split against the reference split.

    A bin absent on one side counts as half a row, so that its logarithm exists.
    """
    b = F.coalesce(binned(column, VTAT_EDGES, VTAT_BUCKETS), F.lit(-1.0))
    counts = df.groupBy(split, b.alias("bin")).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(split).agg(F.sum("n").alias("size"))
    bins = counts.select("bin").distinct()
    ref = counts.where(F.col(split) == reference).select("bin", F.col("n").alias("ref_n"))
    ref_size = totals_of(counts.where(F.col(split) == reference), n=F.sum("n"))["n"]
    # splits x bins: both sides are bounded by the bin list and the split labels
    grid = sizes.withColumn("bin", F.explode(F.array(*[F.lit(x) for x in [-1.0, *VTAT_BUCKETS]]))).join(
        bins, "bin", "left_semi")
    full = grid.join(counts, [split, "bin"], "left").join(ref, "bin", "left")
    p = ratio(F.coalesce(F.col("n").cast("double"), F.lit(0.5)), "size")
    q = ratio(F.coalesce(F.col("ref_n").cast("double"), F.lit(0.5)), ref_size)
    return full.groupBy(split).agg(F.sum((p - q) * F.log(p / q)).alias("psi")).withColumn(
        "is_drifted", (F.col("psi") > DRIFT_LIMIT).cast("int"))


def needs_retrain(f2: str | Column, recall: str | Column) -> Column:
    a = F.col(f2) if isinstance(f2, str) else f2
    b = F.col(recall) if isinstance(recall, str) else recall
    return ((a < RETRAIN_F2) | (b < RETRAIN_RECALL)).cast("int")
