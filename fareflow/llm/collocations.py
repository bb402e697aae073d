"""Phrase collocation mining by direct-address tiling.

Words of a language are numbered by frequency (0 is the most frequent), counting only words seen at least ``MIN_COUNT``
times: a rarer word can't be part of a phrase that is. A phrase of m words is a pair (phrase of its first m - 1 words,
last word); pairs are counted inside each task over its own documents and only the counts are shuffled. Ids are ranked
by frequency, so the pairs of frequent ids fill a small square tile that is counted by a dense ``numpy.bincount``; the
sparse rest is counted as sorted COO (``numpy.unique`` over packed keys). Pairs seen ``MIN_COUNT`` times become the
phrases of the next level, numbered again by frequency: the recursion stops at ``MAX_WORDS`` or when a level is empty.
Cuts, scores, the containment rule and the ranking are joins over the frequent phrases alone, in exact decimals.

Each pass sends the task the word list and the frequent phrases found so far. They are the words and phrases seen at
least ``MIN_COUNT`` times, so their number is at most the words of the corpus over ``MIN_COUNT``; they are measured before
they are sent, and a table over ``BROADCAST_ENTRIES`` stops the job with an error instead of giving a partial answer.

Defined results: a null text has no words; a null ``lang`` is ``und``; only A-Z are lower-cased; repeated rows count
twice; ties in the ranking go by the phrase's UTF-8 bytes; an empty table or one without a frequent phrase has no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareflow.llm.common import table
from fareflow.llm.textnum import blocks
from fareflow.scale import checkpointed

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Side of the dense tile: pairs of the ``TILE`` most frequent ids of a level are counted by direct address.
TILE = 1024
#: Bytes of text split into words at once, pairs held before they are counted, and rows sent to Spark at once.
STEP_BYTES, HELD_PAIRS, OUT_ROWS = 1 << 20, 1 << 20, 1 << 17
#: Most words and phrases sent to the tasks in one pass.
BROADCAST_ENTRIES = 20_000_000

#: Fixed values of the contract: piece breaks and word gaps.
PIECE_BREAK = "[.,;:!?\n\x0b\x0c\r]"
WORD_GAP = "[ \t]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces_of(docs: DataFrame) -> DataFrame:
    """(lang, text): the columns the tasks read, a null ``lang`` as ``und``."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.col("text").cast("string").alias("text"))


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row of each word, the words, and each word's piece number (distinct across rows), by Arrow's own kernels."""
    text = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
    pieces = pc.split_pattern_regex(text, PIECE_BREAK)
    inner = pc.list_flatten(pieces)
    split = pc.split_pattern_regex(inner, WORD_GAP)
    words = pc.list_flatten(split)
    piece_len = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    doc_pieces = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
    piece_doc = np.repeat(np.arange(len(doc_pieces)), doc_pieces)
    piece_no = np.repeat(np.arange(len(piece_len)), piece_len)
    real = pc.not_equal(words, "")
    keep = real.to_numpy(zero_copy_only=False)
    return piece_doc[piece_no][keep], words.filter(real), piece_no[keep]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: (lang, word, n) for the words of its rows."""
    for batch in blocks(batches, "text", STEP_BYTES):
        word_doc, words, _ = _flat(batch)
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in set(langs.tolist()):
            mine = words.filter(pa.array((langs == lang)[word_doc] if len(word_doc) else np.zeros(0, bool)))
            counted = pc.value_counts(mine)
            if len(counted):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counted), pa.string()), counted.field("values"),
                     counted.field("counts").cast(pa.int64())], names=["lang", "word", "n"])


def _pairs(lang: str, prefix: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, prefix, last, n): the tile by direct address, the rest as sorted packed keys, in slices of ``OUT_ROWS``."""
    dense = (prefix < TILE) & (last < TILE)
    tile = np.bincount(prefix[dense] * TILE + last[dense], minlength=1)
    hit = np.flatnonzero(tile)
    keys, n = np.unique((prefix[~dense] << 32) | last[~dense], return_counts=True)
    keys = np.concatenate([(hit // TILE) << 32 | hit % TILE, keys])
    n = np.concatenate([tile[hit], n])
    for lo in range(0, len(keys), OUT_ROWS):
        some = keys[lo: lo + OUT_ROWS]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array(some >> 32, pa.int64()),
             pa.array(some & 0xFFFFFFFF, pa.int64()), pa.array(n[lo: lo + OUT_ROWS], pa.int64())],
            names=["lang", "prefix", "last", "n"])


def _pair_counter(words_by_lang: dict, levels_by_lang: dict, target: int):
    """A function over Arrow batches giving (lang, prefix, last, n): counts of level-``target`` pairs in those batches.

    A batch is read in blocks of about ``STEP_BYTES``; the pairs of a language are held until ``HELD_PAIRS`` of all
    languages are, then counted, so memory depends on neither the batch nor the task's rows.
    """

    def level_pairs(ids: np.ndarray, piece: np.ndarray, levels: dict) -> tuple[np.ndarray, np.ndarray]:
        phrase = ids
        for m in range(2, target + 1):
            if len(phrase) < m:
                break
            prefix, last = phrase[: len(phrase) - 1], ids[m - 1:]
            ok = (prefix >= 0) & (last >= 0) & (piece[: len(prefix)] == piece[m - 1:])
            if m == target:
                return prefix[ok], last[ok]
            known, ranks = levels[m]
            keys = (prefix << 32) | np.maximum(last, 0)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                phrase = np.where(ok & (known[at] == keys), ranks[at], -1)
            else:
                phrase = np.full(len(keys), -1, np.int64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        pairs = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                yield from _pairs(lang, np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts]))
            held.clear()

        for batch in blocks(batches, "text", STEP_BYTES):
            word_doc, words, piece_no = _flat(batch)
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                if lang not in words_by_lang:
                    continue
                docs_here = np.array([x == lang for x in langs])
                mask = docs_here[word_doc] if len(word_doc) else np.zeros(0, bool)
                ids = pc.fill_null(pc.index_in(words.filter(pa.array(mask)), value_set=words_by_lang[lang]), -1)
                ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
                prefix, last = level_pairs(ids, piece_no[mask], levels_by_lang[lang])
                if len(prefix):
                    held.setdefault(lang, []).append((prefix, last))
                    pairs += len(prefix)
            if pairs >= HELD_PAIRS:
                yield from counted()
                pairs = 0
        yield from counted()

    return count


def _sent(df: DataFrame, what: str) -> list:
    entries = df.count()
    if entries > BROADCAST_ENTRIES:
        raise ValueError(f"{entries} frequent {what} are more than BROADCAST_ENTRIES = {BROADCAST_ENTRIES}")
    return df.collect()


def collocations(spark: SparkSession, docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score for each language's ``top`` phrases."""
    split = pieces_of(docs)
    counts = checkpointed(split.mapInArrow(_word_counts, "lang string, word string, n long")
                          .groupBy("lang", "word").agg(F.sum("n").alias("f")))
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    by_freq = Window.partitionBy("lang").orderBy(F.desc("f"), "word")
    vocab = counts.where(F.col("f") >= min_count).withColumn("id", F.row_number().over(by_freq) - 1)
    rows = _sent(vocab.select("lang", "word", "id").orderBy("lang", "id"), "words")
    words_by_lang: dict[str, list] = {}
    for row in rows:
        words_by_lang.setdefault(row["lang"], []).append(row["word"])
    words_by_lang = {k: pa.array(v, pa.string()) for k, v in words_by_lang.items()}
    context = spark.sparkContext
    shared_words = context.broadcast(words_by_lang)

    phrases = vocab.select("lang", F.col("id").alias("pid"), F.array("id").alias("wids"), "f")
    levels_by_lang: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {k: {} for k in words_by_lang}
    every = [phrases]
    shared_levels = None
    for m in range(2, max_words + 1):
        if not words_by_lang:
            break
        words_b, levels_b = shared_words, context.broadcast(levels_by_lang)

        def counted(batches, words_b=words_b, levels_b=levels_b, m=m):
            return _pair_counter(words_b.value, levels_b.value, m)(batches)

        pairs = (split.mapInArrow(counted, "lang string, prefix long, last long, n long")
                 .groupBy("lang", "prefix", "last").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count))
        ranked = checkpointed(pairs.withColumn(
            "pid", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("f"), "prefix", "last")) - 1))
        level = _sent(ranked.select("lang", "prefix", "last", "pid"), f"phrases of {m} words")
        if shared_levels is not None:
            shared_levels.unpersist()
        shared_levels = levels_b
        if not level:
            break
        found: dict[str, list] = {}
        for row in level:
            found.setdefault(row["lang"], []).append(((row["prefix"] << 32) | row["last"], row["pid"]))
        for lang, entries in found.items():
            entries.sort()
            levels_by_lang[lang][m] = (np.array([k for k, _ in entries], np.int64), np.array([p for _, p in entries], np.int64))
        for lang in levels_by_lang:
            levels_by_lang[lang].setdefault(m, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        previous = every[-1].select("lang", F.col("pid").alias("prefix"), F.col("wids").alias("head"))
        every.append(ranked.join(previous, ["lang", "prefix"]).select(
            "lang", "pid", F.concat("head", F.array("last")).alias("wids"), "f"))

    known = every[0].select("lang", "wids", "f")
    for level_table in every[1:]:
        known = known.unionByName(level_table.select("lang", "wids", "f"))
    known = checkpointed(known)
    return _ranked(known, vocab, totals, top)


def _ranked(known: DataFrame, vocab: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Cuts, scores, the containment rule and the first ``top`` of each language, from the frequent phrases."""
    candidates = known.where(F.size("wids") >= 2).select("lang", "wids", F.col("f").alias("a"))
    cuts = candidates.select("lang", "wids", "a", F.explode(F.sequence(F.lit(1), F.size("wids") - 1)).alias("k"))
    left = known.select("lang", F.col("wids").alias("lw"), F.col("f").alias("l"))
    right = known.select("lang", F.col("wids").alias("rw"), F.col("f").alias("r"))
    scored = (cuts.withColumn("lw", F.slice("wids", 1, F.col("k"))).withColumn("rw", F.slice("wids", F.col("k") + 1, 99))
              .join(left, ["lang", "lw"]).join(right, ["lang", "rw"]).join(totals, "lang")
              .withColumn("score", F.expr(
                  "(cast(a as decimal(38,0)) * cast(n as decimal(38,0)) * 1000) div "
                  "(cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")))
    best = scored.groupBy("lang", "wids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inside = candidates.where(F.size("wids") >= 3).select(
        "lang", F.col("a").alias("outer"), F.explode(F.expr("""
          flatten(transform(sequence(2, size(wids) - 1), len ->
            transform(sequence(1, size(wids) - len + 1), s -> slice(wids, s, len))))""")).alias("wids"))
    covered = inside.join(candidates, ["lang", "wids"]).where(F.col("outer") >= F.col("a")).select("lang", "wids").distinct()
    kept = best.join(covered, ["lang", "wids"], "left_anti")
    spelled = (kept.select("lang", "wids", F.posexplode("wids").alias("at", "id"))
               .join(vocab.select("lang", "id", "word"), ["lang", "id"])
               .groupBy("lang", "wids").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
               .select("lang", "wids", F.concat_ws(" ", F.transform("w", lambda x: x["word"])).alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (kept.join(spelled, ["lang", "wids"]).select(
        "lang", "phrase", F.col("a").cast("long").alias("a"), F.col("c.l").cast("long").alias("l"),
        F.col("c.r").cast("long").alias("r"), F.col("n").cast("long").alias("n"), F.col("c.score").cast("long").alias("score"))
        .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over all ``documents``."""
    return collocations(spark, table(spark, sf_dir, "documents"))
