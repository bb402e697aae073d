"""Embedding near-dedup by sorted projection passes.

Each pass hashes every vector by the signs of random projections; the bits, one after another, are a key by which all vectors
are ordered, so near vectors stand near one another. Each vector is compared with a bounded window of neighbours, verified
pairs are kept, and the passes' pairs are united. Where more vectors than a window share a key's leading bits, the window does
not hold them all: such groups are counted and all pairs of theirs that are not connected yet are compared in blocks. So a pass
compares every two vectors that agree in these bits, however dense a part of the space is, and the number of passes follows from
that alone (see ``passes_for``). Pairs found are kept as spanning stars: a component needs no more. A dense cone of vectors that
don't link costs work that grows with the square of its vectors.

The window bounds what a pass compares, not what counts as a link: links inside each component are then counted exactly. Each
vector's angle to its component's centre settles most of them: two angles that sum to less than the threshold's angle prove a
link. What this leaves open is compared in blocks, both sides of which are bounded; counts are added up, pairs never listed.

Defined results: vectors are scaled by their largest component first, so finite vectors of any magnitude are compared;
equal vectors (after that scaling) are one entry with a weight, so copies don't fill windows; vectors that are null, zero,
or hold null or non-finite components link with nothing, and so does a vector whose vec_id is null (component_id null); vectors link with vectors of their own length, the passes run once for each
length; a repeated vec_id is two vectors; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import components, literal_table, table
from fareflow.scale import checkpointed

THRESHOLD = 0.95
WINDOW = 24
BITS = 60
RECALL = 0.999
ROWS_PER_SLICE = 40_000
BLOCK = 1_024
#: Vectors on each side of one comparison inside a crowded group.
CROWD_BLOCK = 4_096


def prefix_bits(n: int, window: int = WINDOW) -> int:
    """Leading bits of a key whose groups are compared whole: as many as leave a window of evenly spread vectors."""
    return min(BITS, max(1, math.ceil(math.log2(max(2.0, n / window)))))


def passes_for(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair exactly at the threshold has been compared with probability ``recall``.

    Two vectors at an angle a agree in one sign bit with probability 1 - a / pi; they are compared for sure once they
    agree in the leading bits, in a window or, where the bits' group is larger than one, in its blocks.
    """
    share = (1 - math.acos(threshold) / math.pi) ** prefix_bits(n, window)
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def planes_of(passes: int, size: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((passes, size, BITS))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """(members: vec_id, vec; classes: rep, weight, vec), and each length with the number of its classes.

    ``members`` hold null for vectors that link with nothing. Equal vectors are grouped with map-side combine.
    """
    values = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite & F.exists(values, lambda x: x != 0)
    # Scaled by the largest component: cosines stay, and no square of a huge or tiny component leaves the doubles.
    largest = F.aggregate(values, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    members = vectors.select("vec_id", F.when(good, F.transform(values, lambda x: x / largest)).alias("vec"))
    classes = checkpointed(members.where(F.col("vec").isNotNull()).groupBy("vec")
                           .agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    sizes = classes.groupBy(F.size("vec").alias("s")).agg(F.count("*").alias("n")).orderBy("s").collect()
    return members, classes, [(r["s"], r["n"]) for r in sizes]


def found_pairs(classes: DataFrame, size: int, count: int, seed: int = 17, threshold: float = THRESHOLD,
                window: int = WINDOW) -> DataFrame:
    """Stars (a, b) that connect what the passes' windows verify. ``classes``: rep, vec of one length."""
    passes = passes_for(count, threshold, window)


    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = planes_of(passes, size, seed)
        weights = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                v = matrix(part.column("vec"), size)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                unit = pa.array(list(v.astype("<f8").view(np.uint8).reshape(len(v), -1).tobytes()[i * 8 * size:(i + 1) * 8 * size]
                                     for i in range(len(v))), pa.binary())
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(v), p, np.int32)), pa.array(((v @ planes[p]) > 0) @ weights), part.column("rep"), unit],
                        names=["pass", "key", "rep", "unit"])

    def unit_rows(units: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(units), "<f8").reshape(-1, size)

    def stars(reps: np.ndarray, units: np.ndarray, fresh_from: int) -> list[tuple[int, int]]:
        """Verified pairs of neighbours in a window, as a spanning forest of what is in memory."""
        root = np.arange(len(reps))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for d in range(1, min(window, len(reps) - 1) + 1):
            near = np.einsum("ij,ij->i", units[:-d], units[d:]) >= threshold
            for i in np.flatnonzero(near):
                if i + d < fresh_from:
                    continue
                a, b = find(int(i)), find(int(i) + d)
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(reps[i]), int(reps[i + d])))
        return out

    schema = "a bigint, b bigint, slice int, tail boolean, pos int, rep bigint, unit binary"

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of one sorted slice, and its first and last rows for the windows across slices."""
        from pyspark import TaskContext
        here, held, seen = TaskContext.get().partitionId(), None, 0
        names = ["a", "b", "slice", "tail", "pos", "rep", "unit"]

        def edge(part, tail: bool) -> pa.RecordBatch:
            n = len(part[0])
            return pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, here if tail else here - 1, np.int32)),
                 pa.array([tail] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(part[0], pa.int64()),
                 pa.array([u.tobytes() for u in part[2]], pa.binary())], names=names)

        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                reps, passes_ = np.asarray(part.column("rep")), np.asarray(part.column("pass"))
                units = unit_rows(part.column("unit").to_pylist())
                if seen < window:
                    n = min(window - seen, len(reps))
                    yield edge((reps[:n], passes_[:n], units[:n]), False)
                fresh = 0
                if held is not None:
                    reps, passes_, units = (np.concatenate([x, y]) for x, y in zip(held, (reps, passes_, units), strict=True))
                    fresh = len(held[0])
                pairs = stars(reps, units, fresh)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64()),
                     pa.nulls(len(pairs), pa.int32()), pa.nulls(len(pairs), pa.bool_()), pa.nulls(len(pairs), pa.int32()),
                     pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.binary())], names=names)
                held = tuple(x[-window:].copy() for x in (reps, passes_, units))
                seen += part.num_rows
        if held is not None:
            yield edge(held, True)

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tail", "pos"], ascending=[False, True])
        pairs = stars(frame["rep"].to_numpy(), unit_rows(list(frame["unit"])), int(frame["tail"].sum()))
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")

    slices = max(1, -(-count * passes // ROWS_PER_SLICE))
    rows = classes.select("rep", "vec").mapInArrow(keyed, "pass int, key bigint, rep bigint, unit binary")
    found = checkpointed(rows.repartitionByRange(slices, "pass", "key", "rep").sortWithinPartitions("pass", "key", "rep")
                         .mapInArrow(windows, schema))
    crossing = found.where(F.col("slice").isNotNull()).groupBy("slice").applyInPandas(across, "a bigint, b bigint")
    pairs = checkpointed(found.where(F.col("a").isNotNull()).select("a", "b").unionByName(crossing).distinct())
    return pairs.unionByName(crowded_pairs(classes, pairs, size, count, seed, threshold, window)).distinct()


def crowded_pairs(classes: DataFrame, pairs: DataFrame, size: int, count: int, seed: int, threshold: float, window: int) -> DataFrame:
    """(a, b) that join components of ``pairs``: all pairs inside groups of leading bits that are larger than a window.

    Members of a group's largest component don't ask: they are connected already. Members that ask are dealt to blocks, and
    each block is compared with each block of the whole group.
    """
    passes, bits = passes_for(count, threshold, window), prefix_bits(count, window)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = planes_of(passes, size, seed)[:, :, :bits]
        weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
        for b in batches:
            v = matrix(b.column("vec"), size)
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            for p in range(passes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), p, np.int32)), pa.array(((v @ planes[p]) > 0) @ weights), b.column("rep")],
                    names=["pass", "prefix", "rep"])

    def joined(left: list[tuple], right: list[tuple]) -> np.ndarray:
        """Distinct pairs of components that a block of asking vectors and a block of the group link."""
        (a, la), (b, lb) = ((np.concatenate([x[0] for x in side]), np.concatenate([x[1] for x in side])) for side in (left, right))
        out = []
        for at in range(0, len(a), BLOCK):
            i, j = np.nonzero(a[at:at + BLOCK] @ b.T >= threshold)
            two = np.stack([la[at + i], lb[j]], 1)
            out.append(np.unique(two[two[:, 0] != two[:, 1]], axis=0))
        return np.unique(np.concatenate(out), axis=0)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by job; no more than one job, two blocks, is held."""
        key, sides = None, ([], [])

        def flushed() -> Iterator[pa.RecordBatch]:
            if sides[0] and sides[1] and len(two := joined(*sides)):
                yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            jobs = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("pass", "prefix", "left", "right", "side")], 1)
            v, label = matrix(batch.column("vec"), size), np.asarray(batch.column("label"))
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            cuts = [0, *(np.flatnonzero((jobs[1:] != jobs[:-1]).any(1)) + 1).tolist(), len(jobs)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                now = tuple(jobs[lo, :4].tolist())
                if now != key:
                    yield from flushed()
                    key, sides = now, ([], [])
                sides[int(jobs[lo, 4])].append((v[lo:hi].copy(), label[lo:hi].copy()))
        yield from flushed()

    labels = components(pairs)
    placed = checkpointed(classes.select("rep", "vec").mapInArrow(prefixes, "pass int, prefix bigint, rep bigint")
                          .join(labels, F.col("rep") == F.col("node"), "left")
                          .select("pass", "prefix", "rep", F.coalesce("component", "rep").alias("label")))
    groups = (placed.groupBy("pass", "prefix", "label").agg(F.count("*").alias("c")).groupBy("pass", "prefix")
              .agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"))
              .where((F.col("n") > window + 1) & (F.col("top.c") < F.col("n"))))
    groups = checkpointed(groups.select("pass", "prefix", "n", (F.col("n") - F.col("top.c")).alias("asking"), F.col("top.label").alias("lead"))
                          .withColumn("lefts", F.ceil(F.col("asking") / CROWD_BLOCK).cast("int"))
                          .withColumn("rights", F.ceil(F.col("n") / CROWD_BLOCK).cast("int")))
    total = groups.agg(F.sum(F.col("asking") * F.col("rights") + F.col("n") * F.col("lefts"))).first()[0]
    if not total:
        return pairs.where("false")
    rows = placed.join(groups, ["pass", "prefix"]).join(classes.select("rep", "vec"), "rep")
    job = ["pass", "prefix", "left", "right", "side"]
    asking = rows.where("label <> lead").select(
        "pass", "prefix", F.pmod(F.xxhash64("rep"), F.col("lefts")).cast("int").alias("left"),
        F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("right"), F.lit(0).alias("side"), "label", "vec")
    answering = rows.select(
        "pass", "prefix", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("left"),
        F.pmod(F.xxhash64("rep", F.lit(1)), F.col("rights")).cast("int").alias("right"), F.lit(1).alias("side"), "label", "vec")
    return (asking.unionByName(answering).repartition(max(1, -(-total // ROWS_PER_SLICE)), *job[:4]).sortWithinPartitions(*job)
            .mapInArrow(compared, "a bigint, b bigint"))


def link_counts(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, links): exact weight of the linked classes of each class in its component, itself included.

    ``members``: component, rep, weight, vec, all of one length. A component's centre is the mean of its unit vectors, summed by blocks.
    """
    limit, slack = math.acos(threshold), 1e-7

    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(frame["vec"].to_numpy()).astype(np.float64)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        return pd.DataFrame({"component": [int(frame["component"].iloc[0])], "total": [v.sum(0)]})

    salted = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(64)).cast("int"))
    sums = salted.groupBy("component", "salt").applyInPandas(partial, "component bigint, total array<double>")
    centre = checkpointed(sums.select("component", F.posexplode("total").alias("i", "x")).groupBy("component", "i")
                          .agg(F.sum("x").alias("x")).groupBy("component")
                          .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre")))

    def angles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v, c = np.stack(b["vec"].to_numpy()), np.stack(b["centre"].to_numpy())
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
                yield pd.DataFrame({"component": b["component"], "rep": b["rep"], "weight": b["weight"],
                                    "vec": [x for x in v],
                                    "angle": 2 * np.arcsin(np.clip(np.linalg.norm(v - c, axis=1) / 2, 0, 1))})

    placed = checkpointed(members.join(centre, "component").mapInPandas(
        angles, "component bigint, rep bigint, weight bigint, vec array<double>, angle double"))
    spans = checkpointed(placed.groupBy("component").agg(F.max("angle").alias("widest"), F.sum("weight").alias("whole"),
                                                         F.count("*").alias("n")))
    rows = placed.join(spans, "component")
    sure = rows.where(F.col("angle") + F.col("widest") <= limit - slack).select("rep", F.col("whole").alias("links"))
    # a row is open against rows whose angle isn't small enough; the rest of its component is linked for certain
    wide = checkpointed(rows.where(F.col("widest") * 2 > limit - slack).select(
        "component", "rep", "weight", "vec", "angle", "widest", "whole", "n",
        F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / BLOCK)).cast("int").alias("block")))

    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        a, b = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
        weight = right["weight"].to_numpy()
        out = np.concatenate([((a[i:i + BLOCK] @ b.T >= threshold) * weight).sum(1) for i in range(0, len(a), BLOCK)])
        return pd.DataFrame({"rep": left["rep"].to_numpy(), "links": out.astype(np.int64)})

    blocks = F.sequence(F.lit(0), (F.ceil(F.col("n") / BLOCK) - 1).cast("int"))
    asking = wide.where(F.col("angle") + F.col("widest") > limit - slack).select(
        "component", "rep", "vec", "block", F.explode(blocks).alias("other"))
    answering = wide.select("component", "rep", "weight", "vec", F.col("block").alias("other"), F.explode(blocks).alias("block"))
    counted = (asking.groupBy("component", "block", "other").cogroup(answering.groupBy("component", "block", "other"))
               .applyInPandas(compare, "rep bigint, links bigint"))
    checked = counted.groupBy("rep").agg(F.sum("links").alias("links"))
    return sure.unionByName(checked)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, seed: int = 17) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    members, classes, sizes = distinct_vectors(rows)
    if sizes:
        groups, links = (literal_table(rows.sparkSession, [], f"{a} bigint, {b} bigint") for a, b in (("node", "component"), ("rep", "links")))
        for size, count in sizes:
            if count < 2:
                continue
            of_size = classes.where(F.size("vec") == size)
            own = checkpointed(components(found_pairs(of_size, size, count, seed, threshold, window)))
            linked = of_size.join(own, F.col("rep") == F.col("node")).select("component", "rep", "weight", "vec")
            groups, links = groups.unionByName(own), links.unionByName(link_counts(checkpointed(linked), threshold))
        known = classes.join(groups, F.col("rep") == F.col("node"), "left").join(links, "rep", "left").select(
            "vec", F.coalesce("links", "weight").alias("links"), F.coalesce("component", "rep").alias("component"))
    else:
        known = literal_table(rows.sparkSession, [], "vec array<double>, links bigint, component bigint")
    known = checkpointed(known.withColumnRenamed("vec", "__vec"))
    out = members.join(known, F.col("vec") == F.col("__vec"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(1)) - 1).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings with their links, component and whether they stay."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
