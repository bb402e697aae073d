"""Mixing sources to target weights by entropy balancing.

Every source gets a target of words. Among all document rates r between 0 and a limit that meet the target of each
source, entropy balancing takes those nearest to 1 in relative entropy; the dual is convex with one multiplier per
source, and its solution is an exponential tilt r = min(limit, exp(multiplier * size / mean size of the source)).
Newton iterations solve it: each is one distributed sum over (source, size) counts, and a bracket guards the step.
Rates become copies inside (source, size) groups by systematic rounding along the sizes, so a source's words miss its
target by little more than the size of one document.

Defined results: a null source is a source of its own, last in the order; a null text has size 0; a source without
words has target 0 and keeps its documents once; repeated rows are mixed one by one; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareflow.llm.common import hash31, literal_table, spread_rank, table, word_count
from fareflow.scale import checkpointed

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3.0


def targets(sizes: Sequence[int], weights: Sequence[float], limit: float = LIMIT) -> list[float]:
    """Shares of the total by weight; none above ``limit`` times its size, the excess shared again by weight."""
    fixed: dict[int, float] = {}
    total = float(sum(sizes))
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        weight = sum(weights[i] for i in free)
        rest = total - sum(fixed.values())
        share = {i: rest * weights[i] / weight for i in free} if weight else {}
        over = [i for i in free if share[i] > limit * sizes[i]]
        if not over:
            return [fixed[i] if i in fixed else share[i] for i in range(len(sizes))]
        fixed |= {i: limit * sizes[i] for i in over}


def balance(groups: DataFrame, sources: list[dict], limit: float = LIMIT, tolerance: float = 1e-7,
            rounds: int = 60) -> dict[int, float]:
    """Multiplier of each source. ``groups``: (k, size, n) counts; ``sources``: k, words, mean, target.

    A source at its limit or without words needs no iteration. Each round sums words and slope of all other sources
    in one job; the driver holds three numbers a source.
    """
    spark, top = groups.sparkSession, math.log(limit)
    found = {s["k"]: 60.0 for s in sources if s["target"] >= limit * s["words"] * (1 - 1e-12)}
    found |= {s["k"]: 0.0 for s in sources if s["words"] == 0}
    open_ = {s["k"]: s for s in sources if s["k"] not in found}
    at = {k: 0.0 for k in open_}
    low, high = dict.fromkeys(open_, -math.inf), dict.fromkeys(open_, math.inf)
    for _ in range(rounds):
        if not open_:
            break
        now = literal_table(spark, [{"k": k, "m": at[k], "mean": s["mean"]} for k, s in open_.items()],
                            "k int, m double, mean double")
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("m") * x, F.lit(top)))
        sums = (groups.join(now, "k").groupBy("k").agg(
            F.sum(rate * F.col("size") * F.col("n")).alias("words"),
            F.sum(F.when(F.col("m") * x < top, rate * F.col("size") * x * F.col("n")).otherwise(0.0)).alias("slope")))
        for r in sums.collect():
            k, s = r["k"], open_[r["k"]]
            miss = s["target"] - r["words"]
            if abs(miss) <= tolerance * max(1.0, s["target"]):
                found[k] = at[k]
                del open_[k]
                continue
            (low if miss > 0 else high)[k] = at[k]
            # the sum is closer to linear in the multiplier on a log scale: Newton on log(words)
            step = math.log(s["target"] / r["words"]) * r["words"] / r["slope"] if r["slope"] > 0 and r["words"] > 0 else math.inf
            to = at[k] + step
            if not low[k] < to < high[k] or not math.isfinite(to):
                if math.isinf(low[k]):
                    to = high[k] * 2 - 1
                elif math.isinf(high[k]):
                    to = low[k] * 2 + 1
                else:
                    to = (low[k] + high[k]) / 2
            at[k] = to
    return found | {k: at[k] for k in open_}


def mixed_documents(docs: DataFrame, identity: Sequence[str], weights: Sequence[float] = WEIGHTS,
                    limit: float = LIMIT, seed: int = 7) -> DataFrame:
    """One row per row of ``docs`` (columns of ``identity``, ``source``, ``size``): source_size, target, rate, copies.

    Sources are as many as there are weights to give, a short list that the driver orders. The weights repeat along
    it.
    """
    spark, names = docs.sparkSession, list(identity)
    rows = checkpointed(docs.select(*names, "source", F.col("size").cast("long").alias("size"),
                                    hash31(F.lit(seed), *[F.col(c) for c in names]).alias("__h")))
    counts = checkpointed(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    found = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    aims = targets([r["words"] for r in found], [weights[i % len(weights)] for i in range(len(found))], limit)
    sources = [{"k": k, "source": r["source"], "words": r["words"], "target": t, "mean": max(r["words"] / r["n"], 1e-9)}
               for k, (r, t) in enumerate(zip(found, aims, strict=True))]
    known = literal_table(spark, sources, "k int, source string, words bigint, target double, mean double")
    numbered = checkpointed(counts.join(known, counts["source"].eqNullSafe(known["source"]))
                            .select("k", counts["source"], "size", "n", "words", "target", "mean"))
    multiplier = balance(numbered.select("k", "size", "n"), sources, limit)
    tilt = literal_table(spark, [{"k": k, "m": m} for k, m in multiplier.items()], "k int, m double")
    rated = numbered.join(tilt, "k").withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(
        F.exp(F.least(F.col("m") * F.col("size") / F.col("mean"), F.lit(math.log(limit))))))
    rated = rated.withColumn("rate", F.when(F.col("rate") > limit - 1e-9, F.lit(float(limit))).otherwise(F.col("rate")))
    # systematic rounding along the sizes of a source: whole copies so far, of the copies that the rates ask for
    along = Window.partitionBy("k").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.sum(F.col("n") * (F.col("rate") - F.floor("rate"))).over(along)
    rated = rated.withColumn("__to", F.floor(asked + 0.5)).withColumn(
        "__from", F.coalesce(F.lag("__to").over(Window.partitionBy("k").orderBy("size")), F.lit(0)))
    groups = rated.select("k", "size", "words", "target", "rate", F.floor("rate").cast("long").alias("__least"),
                          F.least(F.greatest(F.col("__to") - F.col("__from"), F.lit(0)), F.col("n")).alias("__more"))
    keyed = rows.join(known.select("k", F.col("source").alias("__s")), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    ranked = spread_rank(keyed, ["k", "size"], "__h", names, "__rank")
    return joined(ranked, groups, names)


def joined(ranked: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Copies of each document: the whole part of its rate, and one more for the first ranks of its group.

    A group may be hot, so its rows keep to the slices that ranked them: the groups are repeated over a salt.
    """
    salts = 16
    left = ranked.withColumn("__salt", F.pmod("__h", F.lit(salts)).cast("int"))
    right = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = F.col("__least") + (F.col("__rank") < F.col("__more")).cast("long")
    return left.join(right, ["k", "size", "__salt"]).select(
        *names, "source", "size", F.col("words").alias("source_size"), "target", "rate", copies.alias("copies"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mix = mixed_documents(docs, ["doc_id"])
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                      "copies", "rate")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    columns = docs.columns
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mix = mixed_documents(sized, ["doc_id"]).groupBy("doc_id").agg(F.max("copies").alias("__copies"))
    many = docs.join(mix, docs["doc_id"].eqNullSafe(mix["doc_id"])).select(*[docs[c] for c in columns], "__copies")
    return (many.where("__copies > 0")
            .withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*columns))
