"""LM scoring, phrase collocations and the conversation prefix trie against brute force and their DuckDB SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fareflow.llm import collocations, lm_score, prefix_trie, textnum
from fareflow.llm.catalog import OP12, OP13

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def duck(tmp_path, name, rows, schema, sql):
    path = tmp_path / f"{name}.parquet"
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), path)
    con = duckdb.connect()
    con.sql(f"create view {name} as select * from '{path}'")
    return con.sql(sql).fetchall()


CONV = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                  ("n_convs", pa.string())])


def conversations():
    rng = random.Random(7)
    rows = []
    for c in range(0, 60):
        for t in range(rng.randint(0, 6)):
            rows.append({"conv_id": c, "turn": t, "role": rng.choice(["user", "assistant", None]),
                         "text": rng.choice(["hi", "hello", "é ok", "", None, "bye"]), "n_convs": "x"})
    for t in range(40):
        rows.append({"conv_id": 100, "turn": t, "role": "user", "text": f"step {t}", "n_convs": "x"})
        rows.append({"conv_id": 101, "turn": t, "role": "user", "text": f"step {t}", "n_convs": "x"})
    rows += [{"conv_id": 7, "turn": None, "role": "user", "text": "first", "n_convs": None},
             {"conv_id": 7, "turn": None, "role": "user", "text": "first", "n_convs": None},
             {"conv_id": None, "turn": 0, "role": "user", "text": "lost", "n_convs": None},
             {"conv_id": -7, "turn": 0, "role": "user", "text": "neg", "n_convs": None}]
    return rows


def test_prefix_trie_matches_sql(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_convs string")
    got = sorted(tuple(r) for r in prefix_trie.prefix_trie(spark, df).collect())
    want = sorted(duck(tmp_path, "conversations", rows, CONV, OP13))
    assert got == want
    assert max(r[1] for r in got) >= 40


def test_prefix_trie_brute_force(spark):
    rows = conversations()
    by = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            by[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    turns = {c: [(t[2], t[3]) for t in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        rebuilt[c] = turns.get(base, [])[:h] + turns[c][h:]
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        sub = [q for q in nodes if q[:len(p)] == p]
        leaves = sum(1 for q in sub if kids[q] == 0)
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in sub)
        ends = sorted(c for c in members if len(rebuilt[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n_convs string")
    assert sorted(tuple(r) for r in prefix_trie.prefix_trie(spark, df).collect()) == sorted(out, key=lambda r: r)


def test_prefix_trie_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.prefix_trie(spark, df).count() == 0


DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()),
                  ("n_chars", pa.int64()), ("phrase", pa.string())])


def phrase_docs():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "é", "x\x0by", "Zeta"]
    rows = []
    for i in range(300):
        body = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        body += rng.choice([". new york city hall.", ", ", "!", "\tNew York City\n", ""])
        rows.append({"doc_id": i, "text": body, "lang": rng.choice(["en", "de", None]), "source": "s",
                     "n_chars": 0, "phrase": "p"})
    rows += [{"doc_id": None, "text": None, "lang": "en", "source": None, "n_chars": None, "phrase": None}] * 2
    return rows


def brute_collocations(rows, min_count, top):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r["lang"] or "und"
        text = (r["text"] or "").translate(LOW)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) >= 2 and a >= min_count}
        kept = []
        for p, a in cands.items():
            if any(len(q) > len(p) and b >= a and any(q[s:s + len(p)] == p for s in range(len(q) - len(p) + 1))
                   for q, b in cands.items()):
                continue
            cuts = [((1000 * a * n[lang]) // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((lang, " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        kept.sort(key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i + 1, *x[1:]) for i, x in enumerate(kept[:top])]
    return sorted(out)


def test_collocations_brute_force(spark):
    rows = phrase_docs()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, phrase string")
    got = sorted(tuple(r) for r in collocations.collocations(spark, df, min_count=5, top=7).collect())
    want = brute_collocations(rows, 5, 7)
    assert got == want and len(want) > 7


def test_collocations_sql_and_empty(spark, tmp_path):
    rows = phrase_docs() * 40
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, phrase string")
    got = sorted(tuple(r) for r in collocations.collocations(spark, df).collect())
    assert got == sorted(duck(tmp_path, "documents", rows, DOCS, OP12)) and got
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert collocations.collocations(spark, empty).count() == 0


def lm_docs():
    rng = random.Random(5)
    vocab = ["The", "cat", "sat", "on", "mat", "dog", "ran", "é", "ünï", "a"]
    rows = [{"doc_id": i, "text": " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))} for i in range(60)]
    rows += [{"doc_id": None, "text": "The cat"}, {"doc_id": 3, "text": None}, {"doc_id": 3, "text": ""},
             {"doc_id": 70, "text": "x" * 5000}, {"doc_id": 71, "text": "\t\n "}]
    return rows


def test_lm_base_and_rows(spark):
    rows = lm_docs()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = lm_score.lm_scores(spark, df).collect()
    assert len(got) == len(rows)

    def toks(t):
        return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [" "]

    train = [r for r in rows if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10]
    c = Counter(w for r in train for w in toks(r["text"]))
    big_n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        ts = toks(r["text"])
        held = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0
        base = sum(math.log10(c[w] + 0.1) - math.log10(big_n + 0.1 * (v + 1)) for w in ts)
        want[(r["doc_id"], held, len(ts), sum(c[w] > 0 for w in ts), big_n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                   for r in got) == want
    for r in got:
        assert r["score"] < 0 and math.isfinite(r["score"])


def sequential_score(stream: bytes, bits: int, zeros, ones, start) -> float:
    """The model, one bit at a time: weights change after every CHUNK bits."""
    b = lm_score._Batch(*textnum.text_bytes(pa.array([stream.decode()])), bits)
    n = 8 * len(stream)
    y, j, slots = b.bits(np.arange(n, dtype=np.int64))
    w = start.copy()
    total, pending = 0.0, []
    for i in range(n):
        x = [float(lm_score._stretch(np.float32(zeros[o][slots[i, o]]), np.float32(ones[o][slots[i, o]])))
             for o in range(len(lm_score.ORDERS))] + [0.5]
        seen = int(zeros[lm_score._LONG][slots[i, lm_score._LONG]]) + int(ones[lm_score._LONG][slots[i, lm_score._LONG]])
        g = int(j[i]) * 3 + min((seen + 2) // 3, 2)
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w[g], x))))
        p = min(max(p, 2.0 ** -16), 1 - 2.0 ** -16)
        total += math.log10(p if y[i] else 1 - p)
        pending.append((g, [(y[i] - p) * v for v in x]))
        if (i + 1) % lm_score.CHUNK == 0 or i == n - 1:
            by = defaultdict(list)
            for g2, grad in pending:
                by[g2].append(grad)
            for g2, grads in by.items():
                w[g2] += lm_score.LEARNING_RATE * np.mean(grads, axis=0)
            pending = []
    return total


def lm_tables(batches, bits):
    """Tables from the count pass of each batch as if each were a task, merged as Spark merges them."""
    import pandas as pd

    by = defaultdict(list)
    for batch in batches:
        for out in lm_score._count_pass(iter([batch]), bits):
            for block, blob in zip(out.column("block").to_pylist(), out.column("counts").to_pylist()):
                by[block].append(blob)
    merged = [(b, lm_score._merged(pd.DataFrame({"block": [b] * len(v), "counts": v}), True)["counts"][0])
              for b, v in by.items()]
    return lm_score._tables(merged, bits)


def test_lm_merged_counts_halve_alike():
    import pandas as pd

    counts = np.zeros((2, lm_score.BLOCK_SLOTS), np.uint32)
    counts[:, 0] = [200_000, 50_000]
    counts[:, 1] = [3, 7]
    merged = lm_score._merged(pd.DataFrame({"block": [0, 0], "counts": [lm_score._pack(counts)] * 2}), True)
    out = lm_score._unpack(merged["counts"][0])
    assert out[:, 0].tolist() == [65_535, 16_384] and out[:, 1].tolist() == [6, 14]


def lm_model(streams, bits):
    zeros, ones = lm_tables([pa.RecordBatch.from_arrays([pa.array(streams)], names=["stream"])], bits)
    model = ([lm_score._stretch(z.astype(np.float32), o.astype(np.float32)) for z, o in zip(zeros, ones)],
             lm_score._confidence(zeros[lm_score._LONG].astype(np.int64) + ones[lm_score._LONG]).astype(np.int8))
    return zeros, ones, model


def test_lm_mixer_matches_sequential():
    rng = random.Random(9)
    words = ["ab", "abc", "b", "ca", "é"]
    streams = ["".join(rng.choice(words) + " " for _ in range(rng.randint(0, 400))) + "\n" for _ in range(5)]
    bits = 16
    zeros, ones, model = lm_model(streams, bits)
    start = lm_score._start()
    batch = lm_score._Batch(*textnum.text_bytes(pa.array(streams)), bits)
    logs = np.zeros(len(streams))
    lm_score._mix(batch, model, lm_score.Mixer(start, len(streams)), logs)
    for s, got in zip(streams, logs):
        assert got == pytest.approx(sequential_score(s.encode(), bits, zeros, ones, start), rel=1e-4, abs=1e-6)


def test_lm_long_streams_in_parts(monkeypatch):
    """A stream longer than a task's step is read in parts with their context; the scores are those of one piece."""
    rng = random.Random(4)
    words = ["ab", "abc", "b", "ca", "é", "x" * 1500]
    streams = ["".join(rng.choice(words) + " " for _ in range(rng.randint(200, 900))) + "\n" for _ in range(3)]
    bits = 16
    zeros, ones, model = lm_model(streams, bits)
    whole = []
    for s in streams:
        b = lm_score._Batch(*textnum.text_bytes(pa.array([s])), bits)
        out = np.zeros(1)
        lm_score._mix(b, model, lm_score.Mixer(lm_score._start(), 1), out)
        whole.append(out[0])
    monkeypatch.setattr(lm_score, "STEP_BYTES", 512)
    parted = []
    batches = iter([pa.RecordBatch.from_arrays([pa.array([s])], names=["stream"]) for s in streams])
    parts = 0
    for batch, b, first, last in lm_score._pieces(batches, bits):
        parts += 1
        if first:
            mixer, out = lm_score.Mixer(lm_score._start(), 1), np.zeros(1)
        lm_score._mix(b, model, mixer, out)
        if last:
            parted.append(out[0])
    assert parts > 10
    assert parted == pytest.approx(whole, rel=1e-9)
    tasks = lm_tables([pa.RecordBatch.from_arrays([pa.array([s])], names=["stream"]) for s in streams], bits)
    assert all(a.tolist() == b.tolist() for a, b in zip(tasks[0] + tasks[1], zeros + ones))


def test_lm_start_weights_learn_from_all_training_text(spark, monkeypatch):
    """No bound on the fitted bytes changes a score: every training text moves the starting weights."""
    df = spark.createDataFrame([(i, f"the cat {i} sat on mat {i % 3} " * 20) for i in range(40)], "doc_id long, text string")
    want = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(spark, df).collect()}
    monkeypatch.setattr(lm_score, "MIXER_BYTES", 1, raising=False)
    got = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(spark, df).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_lm_own_counts_and_nibble_counts():
    """Counting nibbles gives the counts of bits, and the sorted runs take out what a plain count of each stream does."""
    rng = random.Random(6)
    streams = ["".join(rng.choice(["ab", "abc", "b", "é"]) + " " for _ in range(rng.randint(0, 60))) + "\n" for _ in range(7)]
    bits = 16
    zeros, ones, _ = lm_model(streams, bits)
    b = lm_score._Batch(*textnum.text_bytes(pa.array(streams)), bits)
    n = 8 * len(b.data)
    y, j, slots = b.bits(np.arange(n))
    for o in range(len(lm_score.ORDERS)):
        assert np.bincount(slots[y == 0, o], minlength=1 << bits).tolist() == zeros[o].tolist()
        assert np.bincount(slots[y == 1, o], minlength=1 << bits).tolist() == ones[o].tolist()
    inputs, classes = lm_score._own_inputs(b, [z.astype(np.uint32) << 16 | k for z, k in zip(zeros, ones)])
    doc = b.doc[np.arange(n) >> 3]
    for o in range(len(lm_score.ORDERS)):
        own = Counter(zip(doc, slots[:, o], y))
        for i in range(0, n, 5):
            z, k = int(zeros[o][slots[i, o]]), int(ones[o][slots[i, o]])
            mine = own[(doc[i], slots[i, o], y[i])]
            z, k = (z, k - mine) if y[i] else (z - mine, k)
            want = max(-8, min(8, math.log((k + 0.4) / (z + 0.4))))
            assert inputs[o, j[i] // 4, i >> 3, j[i] % 4] == pytest.approx(want, abs=1e-5)
            if o == lm_score._LONG:
                assert classes[j[i] // 4, i >> 3, j[i] % 4] == min((z + k + 2) // 3, 2)


def test_lm_paths_hold_the_nodes_of_each_nibble():
    """One lookup of a nibble gives its four nodes; inputs and scores from paths are those from nodes, the counts full."""
    rng = random.Random(12)
    nodes = np.arange(64, dtype=np.uint32)
    paths = lm_score._paths(nodes).view(np.uint32).reshape(-1, 4)
    for block, nibble in ((b, v) for b in range(0, 64, 16) for v in range(16)):
        assert paths[(block | nibble) >> 1].tolist() == [block | (nibble | 16) >> (4 - bit) for bit in range(4)]
    streams = ["".join(rng.choice(["ab", "abc", "b", "é"]) + " " for _ in range(rng.randint(0, 900))) + "\n" for _ in range(5)]
    zeros, ones, by_node = lm_model(streams, 16)
    zeros[0][:], ones[0][:] = np.minimum(zeros[0], 3), np.minimum(ones[0], 3)  # fewer than a stream's own, as after scaling
    b = lm_score._Batch(*textnum.text_bytes(pa.array(streams)), 16)
    plain = lm_score._own_inputs(b, [z.astype(np.uint32) << 16 | k for z, k in zip(zeros, ones)])
    for got, want in zip(lm_score._own_inputs(b, lm_score._packed_paths(zeros, ones)), plain):
        assert np.array_equal(got, want) and np.isfinite(got).all()
    zeros, ones, by_node = lm_model(streams, 16)
    scores = []
    for model in (by_node, lm_score._stretched_paths(zeros, ones)):
        scores.append(np.zeros(len(streams)))
        lm_score._mix(b, model, lm_score.Mixer(lm_score._start(), len(streams)), scores[-1])
    assert scores[0].tolist() == scores[1].tolist()


def test_lm_tables_have_a_slot_for_each_training_byte(spark, monkeypatch):
    """The tables grow with the training text from the start, so contexts seen once are still told apart: a held-out text
    is then predicted better than by tables of the least size."""
    for n in (0, 1, 1 << 16, 23_000_000 // 2, (1 << 23) - 1):
        assert 1 << lm_score.table_bits(n) >= n
    assert [lm_score.table_bits(n) for n in (0, 1 << 15, 100_000, 1 << 40)] == [16, 16, 18, lm_score.MAX_TABLE_BITS]
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(150)], "doc_id long, text string")
    held = [r["score"] for r in lm_score.lm_scores(spark, df).collect() if r["held_out"]]
    monkeypatch.setattr(lm_score, "table_bits", lambda train_bytes: 16)
    least = [r["score"] for r in lm_score.lm_scores(spark, df).collect() if r["held_out"]]
    assert held and sum(held) > 0.97 * sum(least)


def test_lm_sent_counts_unpack_to_the_same_tables(monkeypatch):
    """Counts take the bytes that the largest needs; tables made block by block, by path or node, are those made whole."""
    for top, width in ((255, 1), (256, 2), (70_000, 4), (1 << 33, 8)):
        leaves = np.zeros(lm_score.BLOCK_SLOTS, np.int64)
        leaves[3] = top
        blob = lm_score._pack(leaves)
        assert blob[0] == 16 + width and lm_score._unpack_as_sent(blob).tolist() == leaves.tolist()
        assert lm_score._unpack(blob)[1, 1] == 0 and lm_score._unpack(blob)[0, 1] == top
    bits, rng = 18, np.random.default_rng(2)
    sent = [(b, lm_score._pack(rng.integers(0, 9, (2, lm_score.BLOCK_SLOTS)))) for b in (0, 3, 5, 9, 15)]
    zeros, ones = lm_score._tables(sent, bits)
    packed, stretched = lm_score._packed_paths(zeros, ones), lm_score._stretched_paths(zeros, ones)
    for got, want in ((lm_score._unpacked_tables("a", sent, bits, False)[0], packed),
                      (lm_score._unpacked_tables("a", sent, bits, True)[0], stretched[0]),
                      ([lm_score._unpacked_tables("a", sent, bits, True)[1]], [stretched[1]])):
        assert [g.tobytes() for g in got] == [w.tobytes() for w in want]
    monkeypatch.setattr(lm_score, "MAX_PATH_BITS", 17)
    by_node, classes = lm_score._unpacked_tables("b", sent, bits, True)
    assert [lm_score._paths(n).tobytes() for n in by_node] == [w.tobytes() for w in stretched[0]]
    assert lm_score._paths(classes).tobytes() == stretched[1].tobytes()
    by_node, _ = lm_score._unpacked_tables("b", sent, bits, False)
    assert [lm_score._paths(n).tobytes() for n in by_node] == [w.tobytes() for w in packed]


def test_lm_streams_match_words():
    rng = random.Random(1)
    letters = ["A", "z", " ", "\t", "\n", "\x0b", "\x0c", "\r", "é", "Ü", " ", "\x1c", "."]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(500)] + [None, "", " "]
    got = [x for b in lm_score._streams(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["stream"])]))
           for x in b.column("stream").to_pylist()]
    assert got == ["".join(w + " " for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))) + "\n" for t in texts]


def test_collocation_pairs_in_blocks(monkeypatch):
    """A batch is read block by block and pairs are held up to a bound; their counts are those of the whole batch."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("a b c d, e. f".split(" ")) for _ in range(rng.randint(0, 50))) for _ in range(200)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array([rng.choice(["en", "de", "xx"]) for _ in texts]), pa.array(texts)],
                                       names=["lang", "text"])
    words = {k: pa.array(["a", "b", "c", "d", "e"]) for k in ("en", "de")}
    levels = {k: {2: (np.array([1, 1 << 32]), np.array([0, 1]))} for k in words}

    def counts(target):
        total = Counter()
        for out in collocations._pair_counter(words, levels, target)(iter([batch])):
            sizes.append(out.num_rows)
            for lang, prefix, last, k in zip(*(c.to_pylist() for c in out.columns)):
                total[(lang, prefix, last)] += k
        return total

    sizes: list[int] = []
    want = [counts(2), counts(3)]
    assert all(want)
    monkeypatch.setattr(collocations, "TILE", 2)
    for name, value in (("STEP_BYTES", 100), ("HELD_PAIRS", 20), ("OUT_ROWS", 3)):
        monkeypatch.setattr(collocations, name, value)
    sizes.clear()
    assert [counts(2), counts(3)] == want and max(sizes) <= 3 and len(sizes) > 20
