"""Helpers shared by the training-data operators: exact spread ranks, components of a link graph, literal tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareflow.scale import checkpointed

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text as an array; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash31(*parts: Column) -> Column:
    """A repeatable number from 0 to 2^31 - 1 for a row's identity."""
    return F.xxhash64(*parts).bitwiseAND(F.lit(0x7FFFFFFF))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from driver values, as one literal in the plan."""
    kind = T.ArrayType(T._parse_datatype_string(schema))
    value = F.from_json(F.lit(json.dumps(rows)), kind)
    return spark.range(0, 1, 1, 1).select(F.inline(value))


def spread_rank(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], name: str) -> DataFrame:
    """Rank from 0 of each row among the rows with equal ``keys``, ordered by ``order`` (``hash31``) and ``ties``.

    A key may hold any share of the rows: the range of the hash is cut into as many slices as there are shuffle
    partitions, rows are ranked inside (key, slice) and the counts of the slices before are added. The ranks
    don't depend on the number of slices. Keys must not be null.
    """
    slices, keys = partitions_for(df.sparkSession), list(keys)
    dealt = df.withColumn("__slice", F.shiftright(F.col(order) * F.lit(slices), 31).cast("int"))
    counts = dealt.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__slice").orderBy(order, *ties)
    ranked = dealt.withColumn("__inside", F.row_number().over(inside) - 1)
    return (ranked.join(offsets, [*keys, "__slice"])
            .withColumn(name, F.col("__before") + F.col("__inside"))
            .drop("__slice", "__inside", "__before"))


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of a link table: one row (node, component) per linked node, component the smallest node.

    Alternating large-star and small-star steps: a node's links are moved to its smallest neighbour until the table
    is a set of stars. A step is an aggregate with map-side combine and a join that Spark may split where a node is
    hot; the lineage is cut after each round. Links of a node with itself and links with a null are ignored.
    """
    links = checkpointed(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct())
    seen = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        links = checkpointed(small)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return (links.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
