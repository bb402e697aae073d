"""Substring dedup by fixed-block anchors.

A repeat is a run of ``WINDOW`` words or more that also starts in a document with a smaller id. Every such run holds a whole
aligned block of ``BLOCK_WORDS`` words of the earlier document (2 * 7 - 1 = 13), so:

1. index and probe: the blocks that begin at multiples of 7 are the index, every rolling block of 7 words probes it. Both go
   by a hash to one of many buckets, packed as (3 bytes of hash, document, place); a bucket finds which rolling blocks hit
   an aligned block of an earlier document, and which aligned blocks are hit.
2. extend: around a hit, the windows of 13 words that hold the block are compared exactly (64 bits of hash beyond the
   bucket) with the windows around the blocks that are hit; windows that follow one another are one maximal repeat.
3. remove: the words that confirmed windows cover are taken out of the later documents.

Documents meet only through block and window hashes, never as pairs. Equal entries of one batch are settled in the batch, so
a passage that a third of all documents share sends a few entries a batch, not one a document.

Defined results: a null or blank text has no words; documents under 13 words lose nothing; a null id is kept whole and removes
nothing elsewhere; rows with the same id and text are treated alike (an id never removes from itself); an empty table stays
empty; texts are read whole whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import table, word_count
from fareflow.llm.textnum import Words, blocks, mixed, planes, unplanes, whole, windows

BLOCK_WORDS = 7
WINDOW = 13
#: Entries of a bucket, about; a block that is more often than ``OFTEN`` in a batch counts as hit without asking.
BUCKET = 1_500_000
OFTEN = 16
_PACKED = "bucket int, ids binary, counts binary, places binary, hashes binary"


def grouped_rows(bucket: np.ndarray, ids: np.ndarray, place: np.ndarray, value: np.ndarray | None, width: int) -> Iterator[dict]:
    """Entries sorted by bucket, id and place as one packed row a bucket."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]]), strict=True):
        if hi > lo:
            own = ids[lo:hi]
            at = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
            step = np.diff(place[lo:hi], prepend=0)
            step[at] = place[lo:hi][at]
            yield {"bucket": int(bucket[lo]), "ids": own[at].astype("<i8").tobytes(),
                   "counts": np.diff(np.append(at, hi - lo)).astype("<u4").tobytes(), "places": planes(step, 4),
                   "hashes": planes(value[lo:hi], width) if width else b""}


def as_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r["bucket"] for r in rows], pa.int32())]
        + [pa.array([r[c] for r in rows], pa.binary()) for c in ("ids", "counts", "places", "hashes")],
        names=["bucket", "ids", "counts", "places", "hashes"])


def unpacked(frame: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, places and hashes of packed rows."""
    ids, places, hashes = [], [], []
    for i, c, p, h in zip(frame["ids"], frame["counts"], frame["places"], frame["hashes"], strict=True):
        counts = np.frombuffer(c, "<u4").astype(np.int64)
        step = unplanes(p, 4).astype(np.int64)
        ends = np.cumsum(counts)
        total = np.cumsum(step)
        base = np.zeros(len(counts), np.int64)
        base[1:] = total[ends[:-1] - 1]
        places.append(total - np.repeat(base, counts))
        ids.append(np.repeat(np.frombuffer(i, "<i8"), counts))
        if width:
            hashes.append(unplanes(h, width))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(ids or [empty]), np.concatenate(places or [empty]),
            np.concatenate(hashes) if hashes else np.zeros(0, np.uint64))


def ranges_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts ``key``, and the group number of each sorted entry."""
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    return order, np.cumsum(fresh) - 1


def settle(key: np.ndarray, ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For blocks with equal keys: which hit an aligned block of an earlier document, which aligned ones are hit by a later
    document, and the group of each entry (all in the given order)."""
    order, group = ranges_of(key)
    aligned = place[order] % BLOCK_WORDS == 0
    n = int(group[-1]) + 1 if len(group) else 0
    first = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, group[aligned], ids[order][aligned])
    last = np.full(n, np.iinfo(np.int64).min)
    np.maximum.at(last, group, ids[order])
    hit, asked = np.zeros(len(key), bool), np.zeros(len(key), bool)
    hit[order] = ids[order] > first[group]
    asked[order] = aligned & (ids[order] < last[group])
    back = np.zeros(len(key), np.int64)
    back[order] = group
    return hit, asked, back


def candidate_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed rows (bucket, ids, counts, places, hashes): rolling blocks to ask for; bucket -1 - k: hits settled in a batch."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column("text"))
            ids = np.asarray(block.column("doc_id").cast(pa.int64()))
            inside = whole(words.doc, BLOCK_WORDS)
            h = windows(words.hashes(), BLOCK_WORDS)[inside]
            start = np.flatnonzero(inside)
            if not len(h):
                continue
            doc = words.doc[start]
            own, place = ids[doc], start - words.first[doc]
            hit, asked, group = settle(h, own, place)
            size = np.bincount(group)
            often = size[group] > OFTEN
            hit |= often
            told = hit | asked
            last = np.full(len(size), np.iinfo(np.int64).min)
            np.maximum.at(last, group, own)
            # what other batches still have to see: the first aligned entry of each block, all that aren't settled, and of a
            # frequent block the last document, which tells earlier ones that they are repeated
            aligned = place % BLOCK_WORDS == 0
            least = np.full(len(size), np.iinfo(np.int64).max)
            np.minimum.at(least, group[aligned], own[aligned])
            open_ = (aligned & (own == least[group])) | ~hit | often & (own == last[group])
            out = []
            bucket = ((h >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
            low = h & np.uint64(0xFFFFFF)
            for chosen, named, value, width in ((open_, bucket, low, 3), (told, np.full(len(h), -1 - int(own[0]) % 64), None, 0)):
                i = np.flatnonzero(chosen)
                i = i[np.lexsort((place[i], own[i], named[i]))]
                out += grouped_rows(named[i], own[i], place[i], None if value is None else value[i], width)
            if out:
                yield as_batch(out)

    return docs.mapInArrow(rows, _PACKED)


_RUNS = "doc_id bigint, start bigint, n bigint"


def hit_places(packed: DataFrame) -> DataFrame:
    """(doc_id, start, n): runs of blocks that hit or are hit."""
    def find(frame: pd.DataFrame) -> pd.DataFrame:
        told = frame["bucket"].iloc[0] < 0
        ids, places, hashes = unpacked(frame, 0 if told else 3)
        if not told:
            hit, asked, _ = settle(hashes, ids, places)
            chosen = hit | asked
            ids, places = ids[chosen], places[chosen]
        return runs(ids, places)

    return packed.groupBy("bucket").applyInPandas(find, _RUNS)


def runs(ids: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    """Consecutive places of a document as one row."""
    order = np.lexsort((places, ids))
    ids, places = ids[order], places[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (places[1:] > places[:-1] + 1)
    at = np.flatnonzero(fresh)
    ends = np.append(at[1:], len(ids))[: len(at)]
    last = places[ends - 1] if len(at) else places[:0]
    return pd.DataFrame({"doc_id": ids[at].astype(np.int64), "start": places[at], "n": last - places[at] + 1})


def runs_by_document(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias(name))


def row_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and number of all runs of a batch."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    flat = column.flatten()
    return (np.repeat(np.arange(len(sizes)), sizes), np.asarray(flat.field("start"), np.int64), np.asarray(flat.field("n"), np.int64))


def candidate_windows(with_hits: DataFrame, buckets: int) -> DataFrame:
    """Packed windows around hits (8 bytes of hash beyond the bucket); bucket -1 - k: repeats settled in a batch."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column("text"))
            ids = np.asarray(block.column("doc_id").cast(pa.int64()))
            hashes = words.hashes()
            n = max(0, len(hashes) - WINDOW + 1)
            wanted = np.zeros(len(hashes) + WINDOW, np.int64)
            row, at, many = row_runs(block.column("hits"))
            inside = at + many <= words.count[row]
            row, at, many = row[inside], at[inside] + words.first[row[inside]], many[inside]
            np.add.at(wanted, np.maximum(at - (WINDOW - BLOCK_WORDS), words.first[row]), 1)
            np.add.at(wanted, at + many, -1)
            inside = (np.cumsum(wanted)[:n] > 0) & whole(words.doc, WINDOW)
            start = np.flatnonzero(inside)
            if not len(start):
                continue
            h = windows(hashes, WINDOW)[start]
            # windows go by the least of their blocks, which neighbours share: their places stay together in a bucket
            block_hash = windows(hashes, BLOCK_WORDS, 1)
            other = mixed(np.minimum.reduce([block_hash[start + k] for k in range(WINDOW - BLOCK_WORDS + 1)]))
            doc = words.doc[start]
            own, place = ids[doc], start - words.first[doc]
            order, group = ranges_of(h)
            least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, own[order])
            later = np.zeros(len(h), bool)
            later[order] = own[order] > least[group]
            bucket = (other % np.uint64(buckets)).astype(np.int64)
            out = []
            for chosen, named, width in ((~later, bucket, 8), (later, np.full(len(h), -1 - int(own[0]) % 64), 0)):
                i = np.flatnonzero(chosen)
                i = i[np.lexsort((place[i], own[i], named[i]))]
                out += grouped_rows(named[i], own[i], place[i], h[i], width)
            if out:
                yield as_batch(out)

    return with_hits.mapInArrow(rows, _PACKED)


def confirmed_windows(packed: DataFrame) -> DataFrame:
    """(doc_id, start, n): runs of windows whose words also start in a document with a smaller id."""
    def confirm(frame: pd.DataFrame) -> pd.DataFrame:
        told = frame["bucket"].iloc[0] < 0
        ids, places, hashes = unpacked(frame, 0 if told else 8)
        if not told:
            order, group = ranges_of(hashes)
            least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
            np.minimum.at(least, group, ids[order])
            chosen = order[ids[order] > least[group]]
            ids, places = ids[chosen], places[chosen]
        return runs(ids, places)

    return packed.groupBy("bucket").applyInPandas(confirm, _RUNS)


def repeats(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with ``windows``: runs of confirmed windows, null where there are none."""
    # both joins below read texts by id from one exchange: plain columns (a cast would rename one side) let Spark reuse it
    kinds = dict(docs.dtypes)
    rows = docs.select(*[F.col(c) if kinds[c] == t else F.col(c).cast(t).alias(c) for c, t in (("doc_id", "bigint"), ("text", "string"))])
    named = rows.where(F.col("doc_id").isNotNull())
    words = rows.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    buckets = max(8, int(words // BUCKET))
    hits = runs_by_document(hit_places(candidate_blocks(named, buckets)), "hits")
    with_hits = named.join(hits, "doc_id").select("doc_id", "text", "hits")
    found = runs_by_document(confirmed_windows(candidate_windows(with_hits, buckets)), "windows")
    unnamed = rows.where(F.col("doc_id").isNull()).withColumn("windows", F.lit(None).cast("array<struct<start: bigint, n: bigint>>"))
    return named.join(found, "doc_id", "left").select("doc_id", "text", "windows").unionByName(unnamed)


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by one space) and spans: the maximal repeats as [start, end) words."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column("text"))
            row, at, many = row_runs(block.column("windows"))
            inside = at + many + (WINDOW - 1) <= words.count[row]
            row, at, many = row[inside], at[inside] + words.first[row[inside]], many[inside]
            drop = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(drop, at, 1)
            np.add.at(drop, at + many + (WINDOW - 1), -1)
            gone = np.cumsum(drop)[:-1] > 0
            kept, lost, spans = [], [], []
            for i in range(block.num_rows):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                own = gone[lo:hi]
                edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                stay = np.flatnonzero(~own) + lo
                text = words.data[words.offsets[i]: words.offsets[i + 1]].tobytes()
                base = words.offsets[i]
                kept.append(b" ".join([text[a:b] for a, b in zip((words.start[stay] - base).tolist(), (words.end[stay] - base).tolist(), strict=True)])
                            .decode("utf-8", "replace"))
                lost.append(int(own.sum()))
            n = words.count
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(spans, span)], names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return repeats(docs).mapInArrow(
        rows, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<start: bigint, end: bigint>>")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the number of its repeated words and a digest of the others."""
    out = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def substring_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeats; a text that loses nothing stays as it is."""
    columns = docs.columns
    out = removed(docs.select("doc_id", "text")).where("n_removed > 0").select(
        F.col("doc_id").alias("__id"), F.col("kept_text").alias("__kept")).dropDuplicates(["__id"])
    text = F.coalesce("__kept", docs["text"])
    changed = {"text": text, "n_chars": F.when(F.col("__kept").isNotNull(), F.length("__kept").cast("long")).otherwise(docs["n_chars"])
               if "n_chars" in columns else None}
    return docs.join(out, F.col("doc_id") == F.col("__id"), "left").select(
        *[changed[c].alias(c) if changed.get(c) is not None else docs[c] for c in columns])


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()
