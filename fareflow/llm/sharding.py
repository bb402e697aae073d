"""Sharding by a hypergeometric communication matrix (DataFrame functions only).

A uniform shuffle with exact shard sizes in one exchange: how many rows each source partition sends to each shard is
drawn first, exactly as a random permutation of all rows would send them; rows are permuted inside their partition,
sent, and permuted again inside their shard.

Defined results: an empty table gives an empty table; a null text has no bytes; equal rows are placed like different
ones; the placement depends on the rows and ``seed`` alone, so a lost task is recomputed alike.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import hash31, literal_table, spread_rank, table
from fareflow.scale import checkpointed

SHARDS = 24
ROWS_PER_PARTITION = 1_000_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` taken from ``good + bad``: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, ((good + 1) * (draws + 1)) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    peak = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - peak
    down = up = mode
    p_down = p_up = peak
    while left > 0:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if (up == high and down == low) or p_up + p_down < 1e-300:
            return mode  # what is left of the probability is rounding
    return mode


def communication_matrix(sizes: Sequence[int], shards: Sequence[int], seed: int) -> list[list[int]]:
    """Rows that partition i (``sizes[i]`` rows) sends to shard j (``shards[j]`` rows) under a uniform permutation."""
    rng, room, matrix = random.Random(seed), list(shards), []
    for size in sizes:
        row, rest, left = [], size, sum(room)
        for j, r in enumerate(room):
            take = hypergeometric(rng, r, left - r, rest) if rest else 0
            left, rest = left - r, rest - take
            row.append(take)
            room[j] -= take
        matrix.append(row)
    return matrix


def shuffle_into_shards(rows: DataFrame, identity: Sequence[str], shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """Add ``shard`` (0 to shards - 1, counts at most one apart) and ``slot`` (gapless from 0 in the shard, at random).

    Columns of these names are replaced. ``identity``: the columns that tell rows apart. The matrix has one row per million rows and is the only thing the
    driver draws. The rank in a shard is spread over slices of a hash, so no task holds a shard.
    """
    named = [F.col(c) for c in identity]
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    dealt = checkpointed(rows.select(
        *kept, hash31(F.lit(seed), *named).alias("__first"), hash31(F.lit(seed + 1), *named).alias("__second")))
    total = dealt.count()
    parts = max(64, -(-total // ROWS_PER_PARTITION))
    dealt = dealt.withColumn("__part", F.pmod(F.xxhash64(F.lit(seed + 2), *named), F.lit(parts)).cast("int"))
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}
    present = sorted(sizes)
    matrix = communication_matrix(
        [sizes[p] for p in present], [total // shards + (j < total % shards) for j in range(shards)], seed)
    plan = []
    for p, row in zip(present, matrix, strict=True):
        ends, at = [], 0
        for n in row:
            at += n
            ends.append(at)
        plan.append({"__part": p, "__ends": ends})
    ends = literal_table(rows.sparkSession, plan, "__part int, __ends array<bigint>")
    ranked = spread_rank(dealt, ["__part"], "__first", identity, "__rank")
    sent = ranked.join(ends, "__part").select(
        *kept, "__second", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))).alias("shard"))
    return spread_rank(sent, ["shard"], "__second", identity, "slot").select(*kept, "shard", "slot")


def size_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8).cast("long")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law ``rows``."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", size_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    placed = shuffle_into_shards(docs, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
