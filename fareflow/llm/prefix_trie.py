"""Conversation prefix trie with subtree roll-ups by a centroid decomposition of its root paths.

A conversation is a path from the textless root; every distinct sequence of first turns is a node. Totals of a subtree
(childless nodes, saved tokens) are sums over descendants. Adding each node to all its ancestors costs the sum of all
depths; instead, root paths are cut at their centroids (the midpoint of a path), recursively, aligned by depth so that
conversations sharing a prefix share its pieces. A node's value goes to the O(log depth) pieces that cover its path to the
root; Spark sums each piece once (map-side combined), and the piece totals are pushed down, halving the pieces each
round, until every piece is one node. All of it is joins and aggregates; no tree is held by one task.

Defined results: rows with a null ``conv_id`` belong to no conversation and are ignored; a null ``role`` or ``text`` is
empty; turns are ordered by ``turn`` (null first), then role and text; repeated rows are repeated turns; a conversation
whose rebuilt form has no turn is a member of the root only; extra columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareflow.llm.common import table
from fareflow.scale import checkpointed

#: The first ``crc32(conv_id) % 9`` turns of a conversation come from the conversation ``conv_id - conv_id % 5``.
PREFIX_MOD, FAMILY = 9, 5

_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(c, d, role, text): the d-th turn (from 1) of every rebuilt conversation c, and each c with its length ``n``."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").alias("c"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = rows.withColumn("pos", F.row_number().over(order)).drop("turn")
    ids = turns.select("c").distinct().select(
        "c", (F.crc32(F.col("c").cast("string")) % PREFIX_MOD).alias("h"), (F.col("c") - F.col("c") % FAMILY).alias("b"))
    head = (ids.join(turns.select(F.col("c").alias("b"), "pos", "role", "text"), "b")
            .where(F.col("pos") <= F.col("h")).select("c", "pos", "role", "text"))
    own = turns.join(ids.select("c", "h"), "c").where(F.col("pos") > F.col("h")).select("c", "pos", "role", "text")
    return ids.select("c"), head.unionByName(own)


def paths(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per rebuilt conversation: c, n (turns) and the node keys of its path, the root's first.

    A node key is a SHA-256 chain over (role, text) with lengths before both, so that distinct sequences differ.
    """
    listed = turns.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("t"))
    step = lambda acc, t: F.concat(acc, F.array(F.sha2(F.concat(
        F.element_at(acc, -1), F.lit("|"), F.length(t["role"]).cast("string"), F.lit(":"), t["role"],
        F.length(t["text"]).cast("string"), F.lit(":"), t["text"]), 256)))
    keyed = listed.select("c", F.aggregate("t", F.array(F.lit("root")), step).alias("keys"), "t")
    return ids.join(keyed, "c", "left").select(
        "c", F.coalesce(F.col("keys"), F.array(F.lit("root"))).alias("keys"),
        F.coalesce(F.transform("t", lambda t: F.octet_length(t["text"])), F.array().cast("array<int>")).alias("bytes"))


def _end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined members that end at each node, streamed in order: a node's list is never held whole."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state, first, out = None, None, True, []
        for batch in batches:
            for key, c in zip(batch["key"].tolist(), batch["c"].tolist()):
                if key != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state, first = key, hashlib.sha256(), True
                state.update((str(c) if first else f",{c}").encode())
                first = False
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["key", "ends_sha256"])
                out = []
        if node is not None:
            out.append((node, state.hexdigest()))
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])

    placed = ends.repartition("key").sortWithinPartitions("key", "c")
    return placed.mapInPandas(digest, "key string, ends_sha256 string")


def prefix_trie(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """One row per trie node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ids, turns = rebuilt_turns(conversations)
    path = checkpointed(paths(ids, turns))
    zipped = F.arrays_zip(
        F.col("keys").alias("key"),
        F.concat(F.array(F.lit(None).cast("string")), F.slice("keys", 1, F.size("bytes"))).alias("parent_key"),
        F.concat(F.array(F.lit(0)), F.col("bytes")).alias("last_bytes"))
    visits = path.select("c", F.size("bytes").alias("n"), F.posexplode(zipped).alias("depth", "v")).select(
        "c", "depth", F.col("v.key").alias("key"), (F.col("depth") == F.col("n")).alias("ends"),
        F.col("v.parent_key").alias("parent_key"), F.col("v.last_bytes").cast("long").alias("last_bytes"))
    nodes = visits.groupBy("key").agg(
        F.min("c").alias("conv_id"), F.first("depth").cast("long").alias("depth"), F.first("parent_key").alias("parent_key"),
        F.count("*").alias("n_convs"), F.first("last_bytes").alias("last_bytes"))
    children = nodes.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(
        F.count("*").alias("n_children"))
    nodes = checkpointed(nodes.join(children, "key", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)).cast("long")))

    # Each node's value is sent up its representative path (that of its smallest member) to the depth-aligned pieces
    # that cover depths 0..depth: piece (bottom node, k) holds the 2^k nodes above and at its bottom.
    # A conversation's path is read once for all nodes it represents, so no node carries a whole path.
    valued = nodes.select("conv_id", F.struct(
        "key", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("last_bytes")).alias("saved")).alias("r"))
    owned = checkpointed(valued.groupBy(F.col("conv_id").alias("c")).agg(F.collect_list("r").alias("reps"))
                         .join(path.select("c", "keys"), "c"))
    pieces = F.expr("""
        flatten(transform(reps, r -> transform(filter(sequence(0, 40), k -> (shiftright(r.depth + 1, k) & 1) = 1),
          k -> named_struct('k', k, 'leaves', r.leaves, 'saved', r.saved, 'key',
            keys[cast(shiftleft(shiftright(r.depth + 1, k + 1), k + 1) + shiftleft(cast(1 as bigint), k) - 1 as int)]))))""")
    sent = owned.select(F.explode(pieces).alias("p")).select("p.key", "p.k", "p.leaves", "p.saved")
    blocks = checkpointed(sent.groupBy("key", "k").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    top = blocks.agg(F.max("k")).first()[0]
    if top:
        up = F.expr("""
            transform(reps, r -> named_struct('key', r.key, 'up', transform(sequence(0, 40),
              i -> case when r.depth >= shiftleft(cast(1 as bigint), i)
                then keys[cast(r.depth - shiftleft(cast(1 as bigint), i) as int)] end)))""")
        jumps = checkpointed(owned.select(F.explode(up).alias("j")).select("j.key", "j.up"))
        for k in range(top, 0, -1):
            level = blocks.where(F.col("k") == k).join(jumps, "key")
            halves = level.select(F.explode(F.array(
                F.struct(F.col("key").alias("key"), "leaves", "saved"),
                F.struct(F.element_at("up", k).alias("key"), "leaves", "saved"))).alias("h")).select("h.*")
            lower = blocks.where(F.col("k") < k).select("key", "k", "leaves", "saved")
            blocks = checkpointed(lower.unionByName(halves.withColumn("k", F.lit(k - 1)))
                                  .groupBy("key", "k").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    totals = blocks.where(F.col("k") == 0).select(
        "key", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))

    ends = _end_hashes(visits.where("ends").select("key", "c"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(parents, "parent_key", "left").join(totals, "key", "left").join(ends, "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                    F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
                    F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt ``conversations``."""
    return prefix_trie(spark, table(spark, sf_dir, "conversations"))
