"""Near-dedup by ProbMinHash signatures, banding and exact verification.

Distinct shingles of five words weigh alike, however often a document repeats them, as they do in the verified similarity.
ProbMinHash draws, for each shingle, arrivals of a Poisson
process whose rate is the weight; each arrival falls into a random slot, a slot keeps the shingle that came first, and a
document stops as soon as no further arrival can be first anywhere. With equal weights two documents agree in a slot with the
Jaccard similarity of their distinct shingles. Slots are banded; documents that share a band meet in a star, and the stars
form candidate groups.

Verification is exact: inside a candidate group documents are linked if the Jaccard similarity of their distinct shingles
reaches the threshold, and classes are the connected components of these links. The search expands one document after another
against those not yet reached, so a tight group takes a few expansions; large groups do the same with their members spread over
all tasks. No bucket and no group has a cap.

Defined results: a null or blank text is a class of its own; a document under five words is only the same as one with equal
words; texts with equal words are one entry, so exact copies cost nothing; repeated rows are copies; an empty table stays
empty; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import components, table
from fareflow.llm.textnum import Words, blocks, mixed, whole, windows
from fareflow.scale import checkpointed

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Members of a candidate group that one task verifies; larger groups are spread.
ONE_TASK = 20_000
FRONTIER = 256


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle and its document; ``weighted`` makes them distinct."""
    h = words.hashes()
    inside = whole(words.doc, SHINGLE)
    return words.doc[: len(inside)][inside], windows(h, SHINGLE)[inside]


def weighted(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted, each with weight 1."""
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return doc[fresh], shingle[fresh], np.ones(int(fresh.sum()))


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """ProbMinHash of ``n`` documents: the shingle that arrives first in each slot (rows of SLOTS numbers)."""
    total = np.bincount(doc, weight, n)
    rate = weight / total[doc]
    first = np.full(n * SLOTS, np.inf)
    winner = np.zeros(n * SLOTS, np.uint64)
    time, state = np.zeros(len(doc)), mixed(shingle ^ np.uint64(0x5851F42D4C957F2D))
    while len(doc):
        state = mixed(state + np.uint64(0x14057B7EF767814F))
        time = time - np.log1p(-((state >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
        slot = doc * SLOTS + (mixed(state ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(SLOTS)).astype(np.int64)
        earlier = time < first[slot]
        np.minimum.at(first, slot[earlier], time[earlier])
        won = earlier & (time == first[slot])
        winner[slot[won]] = shingle[won]
        alive = time < first.reshape(n, SLOTS).max(1)[doc]
        doc, shingle, rate, time, state = doc[alive], shingle[alive], rate[alive], time[alive], state[alive]
    return winner.reshape(n, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One number for each band of each signature, different bands apart."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = mixed(key + parts[:, :, r] * np.uint64(2 * r + 3))
    return key


def word_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell word sequences apart."""
    h = words.hashes()
    place = (np.arange(len(h)) - words.first[words.doc]).astype(np.uint64)
    out = []
    for salt in (0x9FB21C651E98DF25, 0xD1342543DE82EF95):
        own = mixed(h + mixed(place * np.uint64(salt) + np.uint64(salt)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own)])
        out.append(mixed(sums[words.first[1:]] - sums[words.first[:-1]] + words.count.astype(np.uint64)))
    return out[0], out[1]


def documents_keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (equal words: equal keys), n_words and the band keys (null under five words)."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column("text"))
            n = block.num_rows
            doc, shingle, weight = weighted(*shingles(words))
            some = np.flatnonzero(np.bincount(doc, minlength=n))
            keys = band_keys(signatures(np.searchsorted(some, doc), shingle, weight, len(some))).view(np.int64)
            has = np.zeros(n, bool)
            has[some] = True
            offsets = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel(), pa.int64()))
            k1, k2 = word_keys(words)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").cast(pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                 pa.array(words.count, pa.int64()), bands], names=["doc_id", "k1", "k2", "n_words", "bands"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, bands array<bigint>")


def candidate_groups(entries: DataFrame) -> DataFrame:
    """(rep, grp): documents that stars of shared bands connect. ``entries``: rep, bands."""
    dealt = entries.select("rep", F.explode("bands").alias("band"))
    leads = checkpointed(dealt.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead"))
    stars = dealt.join(leads, "band").where("rep <> lead").select("rep", "lead").distinct()
    return components(stars, "rep", "lead").select(F.col("node").alias("rep"), F.col("component").alias("grp"))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """rep, grp and the distinct shingles as packed sorted numbers. ``docs``: rep, grp, text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            doc, shingle, _ = weighted(*shingles(Words(block.column("text"))))
            cuts = np.searchsorted(doc, np.arange(block.num_rows + 1))
            sets = [shingle[a:b].astype("<u8").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("rep"), block.column("grp"), pa.array(sets, pa.binary())],
                                             names=["rep", "grp", "shingles"])

    return docs.select("rep", "grp", "text").mapInArrow(rows, "rep bigint, grp bigint, shingles binary")


class Group:
    """Distinct shingles of some documents, for similarities of one against all."""

    def __init__(self, packed: list[bytes]):
        sets = [np.frombuffer(p, "<u8") for p in packed]
        self.size = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(sets)), self.size)

    def similar(self, one: np.ndarray, threshold: float) -> np.ndarray:
        """Which documents have a Jaccard similarity with the sorted set ``one`` of ``threshold`` or more."""
        if not len(one):
            return np.zeros(len(self.size), bool)
        at = np.minimum(np.searchsorted(one, self.flat), len(one) - 1)
        both = np.bincount(self.doc[one[at] == self.flat], minlength=len(self.size))
        return both >= threshold * (self.size + len(one) - both) - 1e-9

    def only(self, kept: np.ndarray) -> Group:
        out = object.__new__(Group)
        chosen = kept[self.doc]
        out.flat, out.size = self.flat[chosen], self.size[kept]
        out.doc = np.repeat(np.arange(len(out.size)), out.size)
        return out


def classes_of(reps: np.ndarray, packed: list[bytes], threshold: float) -> np.ndarray:
    """Smallest rep of the connected component of each document: breadth first, against those not yet reached."""
    order = np.argsort(reps)
    reps_, sets = reps[order], [np.frombuffer(packed[i], "<u8") for i in order]
    left, group = np.arange(len(reps_)), Group([packed[i] for i in order])
    label = np.zeros(len(reps_), np.int64)
    while len(left):
        queue = [left[0]]
        label[left[0]] = reps_[left[0]]
        lead = reps_[left[0]]
        group, left = group.only(np.arange(len(left)) > 0), left[1:]
        while queue and len(left):
            found = group.similar(sets[queue.pop()], threshold)
            if found.any():
                label[left[found]] = lead
                queue += left[found].tolist()
                group, left = group.only(~found), left[~found]
    out = np.zeros(len(reps), np.int64)
    out[order] = label
    return out


def verified_here(sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, class) for groups of at most ``ONE_TASK`` members, each in one task."""
    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        reps = frame["rep"].to_numpy()
        return pd.DataFrame({"rep": reps, "class": classes_of(reps, frame["shingles"].tolist(), threshold)})

    return sets.groupBy("grp").applyInPandas(verify, "rep bigint, class bigint")


def verified_spread(sets: DataFrame, threshold: float, salts: int) -> DataFrame:
    """(rep, class) for large groups: rounds of comparing some members with all others, spread over ``salts`` parts.

    In a round each group expands up to ``FRONTIER`` members, those without a link first. They are compared with every
    member that isn't expanded yet, so of each pair the one expanded first finds the other. A group is finished when all
    members that aren't expanded are connected already: no comparison that is left could join two classes.
    """
    rows = checkpointed(sets.select("rep", "grp", "shingles", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int").alias("salt")))
    state = checkpointed(rows.select("rep", "grp", "salt", F.lit(False).alias("done"), F.col("rep").alias("class")))
    links = checkpointed(rows.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false"))

    def against(key, members: pd.DataFrame, ones: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        if len(members) and len(ones):
            reps, group = members["rep"].to_numpy(), Group(members["shingles"].tolist())
            for rep, raw in zip(ones["rep"], ones["shingles"], strict=True):
                found = reps[group.similar(np.frombuffer(raw, "<u8"), threshold)]
                a += [rep] * len(found)
                b += found.tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    def some(of: DataFrame, *keys: str) -> DataFrame:
        """Up to ``FRONTIER`` members of each key: a bounded list, first of a part and then of a group."""
        few = F.slice(F.array_sort(F.collect_list(F.struct("linked", "rep"))), 1, FRONTIER)
        return of.groupBy(*keys).agg(few.alias("few")).select(*keys, F.inline("few"))

    while True:
        undone = state.where("not done")
        spans = undone.groupBy("grp").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("grp")
        open_ = checkpointed(undone.join(spans, "grp").withColumn("linked", F.col("class") != F.col("rep")))
        if open_.isEmpty():
            break
        chosen = checkpointed(some(some(open_.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(4096))), "grp", "part"), "grp")
                              .select("grp", "rep"))
        # The keys of the chosen side get names of their own: both sides come from the same checkpoint.
        ones = chosen.join(rows.select("rep", "shingles"), "rep").select(
            F.col("grp").alias("chosen_grp"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("chosen_salt"),
            "rep", "shingles")
        waiting = rows.join(open_.select("rep"), "rep", "left_semi")
        found = (waiting.groupBy("grp", "salt").cogroup(ones.groupBy("chosen_grp", "chosen_salt"))
                 .applyInPandas(against, "a bigint, b bigint"))
        links = checkpointed(links.unionByName(found.where("a <> b")).distinct())
        joined = components(links)
        out = chosen.select("rep", F.lit(True).alias("out"))
        state = checkpointed(state.join(out, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select(
            "rep", "grp", "salt", (F.col("done") | F.coalesce("out", F.lit(False))).alias("done"),
            F.coalesce("component", "rep").alias("class")))
    return state.select("rep", "class")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD, one_task: int = ONE_TASK) -> DataFrame:
    """doc_id, n_words, class_id (smallest doc_id of the class) and kept for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = checkpointed(documents_keyed(rows))
    with_words = keyed.where((F.col("n_words") > 0) & F.col("doc_id").isNotNull())
    entries = checkpointed(with_words.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    groups = checkpointed(candidate_groups(entries.where(F.size("bands") > 0).select("rep", "bands")))
    texts = rows.join(groups, F.col("doc_id") == F.col("rep")).dropDuplicates(["doc_id"])
    sets = checkpointed(shingle_sets(texts.select("rep", "grp", "text")))
    sizes = sets.groupBy("grp").agg(F.count("*").alias("n"))
    large = checkpointed(sizes.where(F.col("n") > one_task).select("grp"))
    verified = verified_here(sets.join(large, "grp", "left_anti"), threshold)
    if not large.isEmpty():
        wide = sets.join(large, "grp", "left_semi")
        verified = verified.unionByName(verified_spread(wide, threshold, max(8, spark.sparkContext.defaultParallelism * 2)))
    classes = checkpointed(entries.select("k1", "k2", "rep").join(verified, "rep", "left")
                           .select("k1", "k2", F.coalesce("class", "rep").alias("class_id")))
    out = keyed.select("doc_id", "n_words", "k1", "k2").join(classes, ["k1", "k2"], "left")
    own = F.when((F.col("n_words") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_words", own.alias("class_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def minhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest doc_id."""
    gone = near_duplicate_classes(docs).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").select(*docs.columns)
