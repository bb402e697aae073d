"""Best-fit packing planned on the histogram of lengths.

Documents are tokenized and cut into pieces; best fit decreasing runs over the *counts* of pieces of each length, so
the driver plans at most ``SEQUENCE`` lengths whatever the number of documents. The plan is a list of runs of slots;
pieces take slots by joining on their rank within their length.

Defined results: a null text is empty; every document ends with id 0, so an empty one is a piece of length 1; the first
piece of a long document may be shorter, all others are full; repeated rows are packed one by one; an empty table
needs no sequence.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import hash31, literal_table, spread_rank, table
from fareflow.llm.textnum import Words, blocks
from fareflow.scale import checkpointed

SEQUENCE = 2048
END = 0


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts by a byte-level tokenizer, each distinct chunk encoded once.

    The tokenizer splits a text before each run of white space and never looks past it, so a word with the one space
    before it has the same ids wherever it stands; other white space is encoded as a chunk of its own. Texts with other
    Unicode spaces, or with what could be a special token, are encoded as they are.
    """

    MOST = 2_000_000

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.own = Tokenizer.from_file(path)
        self.chunk = chunk_encoder(path, self.own)
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def chunks(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, text and key of the chunks: words with a space before them, and the white space that is left."""
        data, start, end = words.data, words.start.copy(), words.end
        hashes = words.hashes()
        begin = words.offsets[words.doc]
        spaced = (start > begin) & (data[np.maximum(start - 1, 0)] == 0x20)
        key = np.where(spaced, hashes * np.uint64(3) + np.uint64(1), hashes)
        start = start - spaced
        # white space between chunks: from the end of the word before (or of the text's beginning) to the next chunk
        text_end = words.offsets[1:]
        left = np.concatenate([[0], end[:-1]]) if len(end) else np.zeros(0, np.int64)
        first = np.ones(len(start), bool)
        first[1:] = words.doc[1:] != words.doc[:-1]
        left = np.where(first, begin, left)
        gap_from, gap_to, gap_doc = left, start, words.doc
        used = np.flatnonzero(words.count)
        tail_from = words.offsets[:-1].copy()
        tail_from[used] = end[words.first[used + 1] - 1]
        gap_from = np.concatenate([gap_from, tail_from])
        gap_to = np.concatenate([gap_to, text_end])
        gap_doc = np.concatenate([gap_doc, np.arange(len(text_end))])
        full = gap_to > gap_from
        gap_from, gap_to, gap_doc = gap_from[full], gap_to[full], gap_doc[full]
        # a run before a word is split before its last character; at a text's end it is whole
        inner = np.isin(gap_to, start[~spaced]) & (gap_to < text_end[gap_doc]) & (gap_to - gap_from > 1)
        s = np.concatenate([start, gap_from, gap_to[inner] - 1])
        cut = gap_to - inner
        e = np.concatenate([end, cut, gap_to[inner]])
        d = np.concatenate([words.doc, gap_doc, gap_doc[inner]])
        gaps_s, gaps_e = s[len(start):], e[len(start):]
        gap_key = np.array([hash_bytes(data[a:b].tobytes()) for a, b in zip(gaps_s, gaps_e, strict=True)], np.uint64)
        k = np.concatenate([key, gap_key])
        order = np.argsort(s, kind="stable")
        return s[order], e[order], d[order], k[order]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        words = Words(texts)
        n = len(words.offsets) - 1
        data = words.data
        # what chunks can't express: other Unicode spaces, control separators, special tokens
        odd = (data >= 0x1C) & (data <= 0x1F)
        one, two = np.append(data[1:], np.uint8(0)), np.append(data[2:], np.zeros(2, np.uint8))[: len(data)]
        odd |= (data == 0x3C) & (one == 0x7C)
        odd |= (data == 0xC2) & ((one == 0x85) | (one == 0xA0))
        odd |= (data == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
        odd |= (data == 0xE2) & (one == 0x81) & (two == 0x9F)
        odd |= ((data == 0xE1) & (one == 0x9A) | (data == 0xE3) & (one == 0x80)) & (two == 0x80)
        doc_odd = np.zeros(n, bool)
        doc_odd[np.searchsorted(words.offsets, np.flatnonzero(odd), "right") - 1] = True
        start, end, doc, key = self.chunks(words)
        plain = ~doc_odd[doc]
        start, end, doc, key = start[plain], end[plain], doc[plain], key[plain]
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            if len(self.keys) + len(fresh) > self.MOST:
                self.clear()
                fresh = np.arange(len(distinct))
            raw = [data[start[i]: end[i]].tobytes().decode("utf-8") for i in first[fresh]]
            ids = [self.chunk(x) for x in raw]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            at = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
            keys = np.concatenate([self.keys, distinct[fresh]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at = keys[order], np.concatenate([self.at, at])[order]
            self.size = np.concatenate([self.size, sizes])[order]
            place = np.searchsorted(self.keys, distinct)
        at, size = self.at[place][inverse], self.size[place][inverse]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(at - (ends - size), size) + np.arange(total)]
        per_doc = np.bincount(doc, weights=size, minlength=n).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(per_doc)])
        out = [flat[cuts[i]: cuts[i + 1]] for i in range(n)]
        if doc_odd.any():
            which = np.flatnonzero(doc_odd)
            whole = [data[words.offsets[i]: words.offsets[i + 1]].tobytes().decode("utf-8") for i in which]
            for i, ids in zip(which, self.encode(whole), strict=True):
                out[i] = np.array(ids, np.uint32)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder for each Python worker, so that its chunks serve the next task too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def chunk_encoder(path: str, own):
    """How one chunk is encoded. Where the tokenizer is plain byte-level BPE, its own vocabulary and merges are handed to
    a faster library as ranks: same ids, which a test and a look at a few words here confirm; else the tokenizer does it.
    """
    plain = lambda text: own.encode(text, add_special_tokens=False).ids
    spec = json.loads(own.to_str())
    steps = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or spec.get("normalizer") or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space"):
        return plain
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel
    import public_tokenizers
    letters = sorted(ByteLevel.alphabet())
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    if set(letters) != set(byte_of):
        return plain
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    probe = [" the", "Étion,", "x'll", " 123abc", "\n", "naïve…", " 日本", "thndhain."]
    return fast._core_bpe.encode_ordinary if all(fast.encode_ordinary(x) == plain(x) for x in probe) else plain


def hash_bytes(raw: bytes) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(raw, seed=977)


def pieces(docs: DataFrame, path: str | None = None, with_ids: bool = True, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    ``path``: the tokenizer's file, on every machine. Tokenizing is a step inside the tasks, in blocks of bytes.
    """
    path = path or tokenizer_path()
    kept = {f.name: f for f in docs.schema.fields}["doc_id"].dataType
    schema = f"doc_id {kept.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        for block in blocks(batches):
            names, rows = block.column("doc_id").to_pylist(), ([], [], [], [], [], [])
            for name, ids in zip(names, encoder(block.column("text")), strict=True):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                head = len(ids) % sequence or min(len(ids), sequence)
                at, piece = 0, 0
                while at < len(ids):
                    to = at + (head if at == 0 else sequence)
                    part = ids[at:to]
                    for column, value in zip(rows, (name, piece, at, len(part), zlib.crc32(part.tobytes()), part), strict=True):
                        column.append(value)
                    at, piece = to, piece + 1
            kinds = [block.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=False)]
            labels = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in rows[5]], pa.list_(pa.int32())))
                labels.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=labels)

    return docs.select("doc_id", "text").mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def plan(counts: dict[int, int], sequence: int = SEQUENCE) -> tuple[list[dict], int]:
    """Best fit decreasing over counts: runs of slots, and the number of sequences.

    Open sequences with the same room are ranges of numbers. Pieces of one length go to the range with the least room
    that takes them, as many into each sequence as fit; then to new sequences. A run holds slots for ranks
    ``rank`` to ``rank + n * each - 1`` of a length: the sequence is first + (r - rank) // each, the offset base +
    (r - rank) % each * length.
    """
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    runs, used = [], 0

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                insort(rooms, room)
            ranges.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room]
                    rooms.pop(i)
            else:
                room = sequence
                first, n = used, -(-left // (sequence // length))
                used += n
            each = min(room // length, left)
            full = min(n, left // each)
            runs.append({"length": length, "rank": rank, "first": first, "n": full, "each": each, "base": sequence - room})
            rank, left = rank + full * each, left - full * each
            add(room - each * length, first, full)
            add(room, first + full, n - full)  # not reached by full groups; the next turn takes the last few pieces
    return runs, used


def packed(cut: DataFrame, identity: list[str], sequence: int = SEQUENCE, seed: int = 3) -> DataFrame:
    """Add sequence_id and offset to pieces (a ``length`` and columns that tell them apart).

    The plan has a few runs for each length, whatever the number of pieces: it is broadcast by construction.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, sequence)
    slots = literal_table(cut.sparkSession, runs, "length bigint, rank bigint, first bigint, n bigint, each bigint, base bigint")
    slots = slots.select(F.col("length").alias("__length"), F.col("rank").alias("__at"), "first", "n", "each", "base")
    hashed = cut.withColumn("__h", hash31(F.lit(seed), *[F.col(c) for c in identity]))
    ranked = spread_rank(hashed, ["length"], "__h", identity, "__rank")
    past = F.col("__rank") - F.col("__at")
    return ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("__length")) & (past >= 0) & (past < F.col("n") * F.col("each"))
    ).select(*cut.columns, (F.col("first") + F.floor(past / F.col("each"))).cast("long").alias("sequence_id"),
             (F.col("base") + past % F.col("each") * F.col("length")).cast("long").alias("offset"))


def packed_documents(docs: DataFrame) -> DataFrame:
    cut = checkpointed(pieces(docs, with_ids=False))
    return packed(cut, ["doc_id", "piece", "ids_crc32"])


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return packed_documents(table(spark, sf_dir, "documents"))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)


def sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences from placed pieces with ids: sequence_id, ids, lengths. A sequence has ``SEQUENCE`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.size(x["ids"])).alias("lengths"))


__all__ = ["Encoder", "op9_best_fit_packing", "pack_stage", "packed", "packed_documents", "pieces", "plan", "sequences"]
