"""Training-data operators against brute force on small tables with nulls, empty and long texts, ties, copies and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fareflow.llm import chat, embeddings, license, minhash, mixing, packing, quality, sharding, substring, textnum, toxicity
from fareflow.llm.common import components, hash31, spread_rank, word_array, word_count

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept int, shard int, rank string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgé日") for _ in range(rng.randint(1, 6))) for _ in range(160)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage = prose(31)
    texts = [None, "", " \n\t ", "one", "a b c d", prose(12), prose(13), passage, passage]
    for i in range(40):
        texts.append(prose(rng.randint(5, 60)) + "\n" + passage + "  " + prose(rng.randint(0, 40)))
    base = prose(80)
    for i in range(12):
        edited = base.split(" ")
        edited[rng.randrange(80)] = f"edit{i}"
        texts.append(" ".join(edited))
    texts += [base, base, base.replace(" ", "\n"), prose(30_000), "x " * 60, "same line here\n" * 9 + "other line", prose(14) * 3]
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en", ["a", "b", None][i % 3] if i % 7 else "a", 0, "clash", 7, 7, "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_helpers_follow_the_pattern(spark, texts):
    odd = [*texts, "a\x0bb\x0cc\rd", "nbsp stays one", "\x1fcontrol x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, text string").select(
        "i", word_count(F.col("text")).alias("n"), word_array(F.col("text")).alias("w")).collect()
    for r in got:
        assert r["w"] == words(odd[r["i"]]) and r["n"] == len(words(odd[r["i"]]))
    seen = textnum.Words(pa.array(odd))
    at = [[seen.text(k) for k in range(seen.first[i], seen.first[i + 1])] for i in range(len(odd))]
    assert at == [words(t) for t in odd]
    hashes = seen.hashes()
    named = defaultdict(set)
    for i in range(len(seen.start)):
        named[seen.text(i)].add(int(hashes[i]))
    assert all(len(v) == 1 for v in named.values()) and len({h for v in named.values() for h in v}) == len(named)


def test_spread_rank_is_a_rank_whatever_the_slices(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), "id", hash31(F.col("id")).alias("h"))
    got = {r["id"]: r["rank"] for r in spread_rank(rows, ["k"], "h", ["id"], "rank").collect()}
    for k in range(3):
        own = sorted((r["h"], r["id"]) for r in rows.where(f"k = {k}").collect())
        assert [got[i] for _, i in own] == list(range(len(own)))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in list(root)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 1 embeddings
def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 8))
    vectors = [*base, *(base[0] + 0.01 * rng.standard_normal((40, 8))), *(base[1] + 0.28 * rng.standard_normal((50, 8))),
               base[2], base[2], base[2] * 2.5]
    rows = [(i + 10, [float(x) for x in v], 7) for i, v in enumerate(vectors)]
    rows += [(1, None, 0), (2, [], 0), (3, [0.0] * 8, 0), (4, [float("nan")] * 8, 0), (5, [None] * 8, 0), (6, [float("inf")] * 8, 0), (7, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, component int")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(table).collect()}
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    reach = np.linalg.matrix_power(link.astype(float), 1) > 0
    for _ in range(8):
        reach = (reach.astype(float) @ reach.astype(float)) > 0
    for i in range(len(vectors)):
        assert got[i + 10]["n_links"] == link[i].sum() - 1
        assert got[i + 10]["component_id"] == np.flatnonzero(reach[i])[0] + 10
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in range(1, 8))
    assert embeddings.near_duplicates(table.limit(0)).count() == 0
    assert embeddings.near_duplicates(table.where("vec_id < 6")).count() == 5


def test_embeddings_of_any_magnitude_and_null_ids(spark):
    rows = [(1, [1e200, 2e200, 3e200]), (2, [1e200, 2e200, 3.01e200]), (3, [1e-200, -1e-200, 5e-201]),
            (4, [1e-200, -1e-200, 5e-201]), (5, [5e-324, 0.0, 0.0]), (6, [1e-300, 0.0, 0.0]), (None, [1.0, 2.0, 3.0]),
            (None, [1.0, 2.0, 3.0]), (7, [-1.0, 0.0, 0.0])]
    got = sorted((r["vec_id"] is None, r["vec_id"], r["n_links"], r["component_id"], r["kept"])
                 for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(False, 1, 1, 1, True), (False, 2, 1, 1, False), (False, 3, 1, 3, True), (False, 4, 1, 3, False),
                   (False, 5, 1, 5, True), (False, 6, 1, 5, False), (False, 7, 0, 7, True),
                   (True, None, 0, None, True), (True, None, 0, None, True)]


def test_embeddings_sql_agrees_on_edge_vectors(spark, tmp_path):
    import duckdb
    import pyarrow.parquet as pq

    from fareflow.llm.catalog import OP1

    rows = [(1, [1e200, 2e200, 3e200]), (2, [1e200, 2e200, 3.01e200]), (3, [1e-200, -1e-200, 5e-201]), (4, None),
            (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [1.0, None, 1.0]), (None, [1.0, 2.0, 3.0]),
            (8, [1.0, 2.0, 3.0]), (9, [2.0, 4.0, 6.0]), (10, [1.0, 2.0]), (11, [1.0, 2.01])]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()),
                             "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}), tmp_path / "e.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path / 'e.parquet'}'")
    want = sorted(con.execute(f"select vec_id, n_links, component_id, kept from ({OP1})").fetchall(), key=str)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(table).collect()), key=str)
    assert got == want


def test_embeddings_find_isolated_pairs_in_a_hot_cone(spark):
    rng = np.random.default_rng(11)

    def across(n):
        r = rng.standard_normal((n, 64))
        r[:, 0] = 0
        return r / np.linalg.norm(r, axis=1, keepdims=True)

    centre = np.eye(64)[0]
    r = across(2000)
    side = across(60)
    side -= (side * r[:60]).sum(1, keepdims=True) * r[:60]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.96, (60, 1))
    share = (cosine - 0.9) / 0.1
    pairs = np.sqrt(0.9) * centre + np.sqrt(0.1) * (share * r[:60] + np.sqrt(1 - share**2) * side)
    x = np.concatenate([np.sqrt(0.9) * centre + np.sqrt(0.1) * r, pairs, rng.standard_normal((4000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.95).sum(1) - 1
    assert (linked[2000:2060] > 0).all()
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(table).collect()}
    assert sum(got[i] < n for i, n in enumerate(linked.tolist())) <= 2
    assert not any(got[i] > n for i, n in enumerate(linked.tolist()))


def test_embeddings_of_each_length_are_compared(spark):
    rng = np.random.default_rng(5)
    rows = []
    for size, n in ((8, 40), (12, 20)):
        for v in rng.standard_normal((n, size)):
            rows += [(len(rows), v.tolist()), (len(rows) + 1, (v + 0.01 * rng.standard_normal(size)).tolist())]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    for size in (8, 12):
        own = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if len(v) == size]
        for i, v in own:
            assert got[i]["n_links"] == sum(float(v @ w) >= 0.95 for j, w in own if j != i) > 0
            assert got[i]["component_id"] <= i - i % 2


def test_more_vectors_take_more_passes():
    assert embeddings.passes_for(10**3) < embeddings.passes_for(10**6) < embeddings.passes_for(10**9)


# 2 substring
def brute_repeats(rows):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - 12):
            k = tuple(w[i:i + 13])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < d:
                gone |= set(range(i, i + 13))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("often", [0, 16])
def test_substring_matches_brute_force(docs, empty, texts, often, monkeypatch):
    monkeypatch.setattr(substring, "OFTEN", often)
    monkeypatch.setattr(substring, "BUCKET", 500)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.removed(docs).collect()}
    assert got == brute_repeats([(i * 3, t) for i, t in enumerate(texts)])
    assert substring.removed(empty).count() == 0


def test_substring_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(20))
    got = substring.removed(spark.createDataFrame([(None, t), (5, t), (5, t), (9, t)], "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 0), (5, 0), (5, 0), (9, 20)]


def test_substring_stage_keeps_columns(docs, spark):
    out = substring.substring_stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()


# 3 toxicity
def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_accepts_what_one_edit_reaches():
    rng = random.Random(2)
    terms = ["idiot", "moron", "scum", "worthless", "lowe*"]
    table = toxicity.automaton(terms)
    tried = [*["".join(rng.choice("idotmrnscuwehlx") for _ in range(rng.randint(0, 8))) for _ in range(3000)], "lowe", "lower", "lowx", "é", ""]
    for t in terms[:4]:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w) + 1)
                w[k:k + rng.randint(0, 1)] = rng.choice(["", "x", "é", "i"])
            tried.append("".join(w))
    term, edits = table.run(tried)
    for w, t, e in zip(tried, term, edits, strict=True):
        near = [(levenshtein(w, x), i) for i, x in enumerate(terms[:4]) if levenshtein(w, x) <= (len(x) >= 5)]
        if w.startswith("lowe"):
            near.append((0, 4))
        assert (e, t) == min(near) if near else t == -1, (w, t, e, near)


def test_toxicity_learns_and_handles_edges(spark):
    rng = random.Random(8)
    calm = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(300)]
    rows, marks = [], []
    for i in range(600):
        w = [rng.choice(calm) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["zzgrumm", "zzgrumm", "zzgrumn"])
            w[rng.randrange(40)] = "zzgrumm"
        rows.append((i, " ".join(w), "clash"))
        marks.append((i, int(toxic), 0.5))
    rows += [(9000, None, ""), (9001, "", ""), (9002, "zzgruum zzgrumm", "")]
    marks += [(None, 1, 0.0), (9000, None, 0.0), (77777, 1, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int, score double")
    model = toxicity.fitted(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[9000] == got[9001] < 0.5 < got[9002]
    assert toxicity.scores(toxicity.fitted(docs, labels.limit(0)), ["x"]).tolist() == [0.0]
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_quotation_lowers_a_context_score():
    model = toxicity.Model(["idiot"], [4.0], {"quoted": -2.0}, 0.5, 0.0, (1.0,) * 5, toxicity.automaton(["idiot"]))
    score = lambda t: next(toxicity.evidence(model, h, w) for h, w in toxicity.matches(model, [t]))
    assert score("you idiot go") == 4 and score('they wrote "idiot" here') == 2 and score("they quoted idiot here") == 2


# 4 minhash
def brute_classes(rows):
    root = {d: d for d, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {d: {tuple(words(t)[i:i + 5]) for i in range(len(words(t)) - 4)} for d, t in rows}
    for d, t in rows:
        for e, u in rows:
            if e < d and words(t) and (words(t) == words(u) or sets[d] and sets[e] and
                                       len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize("one_task", [20_000, 3])
def test_minhash_matches_brute_force(docs, empty, texts, one_task):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs, one_task=one_task).collect()}
    assert got == brute_classes([(i * 3, t) for i, t in enumerate(texts)])
    assert minhash.near_duplicate_classes(empty).count() == 0


def test_minhash_finds_copies_with_a_repeated_footer(spark):
    rows, expected = [], {}
    for i in range(20):
        base = " ".join(f"b{i}x{k}" for k in range(84))
        footer = " ".join(f"f{i}x{k}" for k in range(16))
        rows += [(2 * i, base), (2 * i + 1, base + (" " + footer) * 100)]
        expected |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    assert brute_classes(rows[:4]) == {k: expected[k] for k in range(4)}
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == expected


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    ids = rng.integers(1, 2**63, 300, dtype=np.uint64)
    wa, wb = rng.integers(0, 5, 300).astype(float), rng.integers(0, 5, 300).astype(float)
    doc = np.concatenate([np.zeros(300, int), np.ones(300, int)])[np.concatenate([wa, wb]) > 0]
    shingle, weight = np.concatenate([ids, ids])[np.concatenate([wa, wb]) > 0], np.concatenate([wa, wb])[np.concatenate([wa, wb]) > 0]
    s = minhash.signatures(doc, shingle, weight, 2)
    both = (wa > 0) & (wb > 0)
    a, b = wa / wa.sum(), wb / wb.sum()
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(both))
    assert abs((s[0] == s[1]).mean() - exact) < 0.16


def test_minhash_stage_keeps_one_of_each_class(docs, spark):
    out = minhash.minhash_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert out.count() == minhash.near_duplicate_classes(docs).select("class_id").distinct().count()


# 5 quality
def brute_statistics(t):
    t = t or ""
    w, at, seen, dup = words(t), defaultdict(list), set(), 0
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_statistics_match_brute_force(docs, texts, empty):
    got = quality.base_statistics(docs.select("doc_id", "text")).collect()
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(texts[r["doc_id"] // 3])
    assert quality.base_statistics(empty.select("doc_id", "text")).count() == 0


def test_quality_rules_separate_and_handle_missing_labels(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + ("&&" if bad and rng.random() < 0.6 else "") for _ in range(60)]
        rows.append((i, " ".join(w), "x"))
        marks.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rule string")
    labels = spark.createDataFrame([*marks, (None, 0), (5000, 0), (1, None)], "doc_id bigint, quality int")
    statistics = quality.base_statistics(docs.select("doc_id", "text")).cache()
    rules = quality.learn(statistics, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(statistics, rules).collect()}
    assert rules and sum(kept[i] == (i % 5 > 0) for i in range(900)) >= 880
    assert quality.learn(statistics, labels.limit(0)) == []
    assert all(r["kept"] for r in quality.judged(statistics, []).collect())


def test_quality_stage_judges_each_row_by_itself(spark, tmp_path):
    clean, bad = " ".join(f"word{i}" for i in range(40)), "too short"
    rows = [(None, clean, "a"), (None, bad, "b"), (7, clean, "c"), (7, bad, "d"), (8, clean, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.quality_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {rows[0], rows[2], rows[4]} and out.count() == 3


# 6 mixing
def test_targets_share_and_stop():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    t = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert t[0] == 30 and abs(sum(t) - 2010) < 1e-9 and abs(t[1] - 2 * t[2]) < 1e-9
    assert mixing.targets([0, 7], [5, 2])[0] == 0


def test_mixing_meets_targets_and_repeats(docs, texts):
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    got = mixing.mixed_documents(sized, ["doc_id"]).collect()
    assert len(got) == len(texts)
    assert {(r["doc_id"], r["copies"]) for r in got} == {(r["doc_id"], r["copies"]) for r in mixing.mixed_documents(sized.repartition(3), ["doc_id"]).collect()}
    assert all(0 <= r["copies"] <= 3 for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
        assert own[0]["source_size"] == sum(r["size"] for r in own)


def test_balance_solves_the_dual(spark):
    groups = spark.createDataFrame([(0, 10, 50), (0, 100, 20), (0, 5000, 1)], "k int, size bigint, n bigint")
    words_ = 500 + 2000 + 5000
    for share in (0.05, 0.7, 1.0, 1.9, 2.9):
        s = {"k": 0, "words": words_, "mean": words_ / 71, "target": share * words_}
        m = mixing.balance(groups, [s])[0]
        got = sum(n * z * min(3.0, np.exp(min(m * z / s["mean"], 50))) for z, n in ((10, 50), (100, 20), (5000, 1)))
        assert abs(got / s["target"] - 1) < 1e-5


def test_mixing_empty(empty):
    assert mixing.mixed_documents(empty.select("doc_id", "source", F.lit(0).alias("size")), ["doc_id"]).count() == 0


# 7 license
def test_license_scan_and_inheritance(spark):
    mit, gpl = license.TEMPLATES["MIT"][0], license.TEMPLATES["GPL-3.0"][0]
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.txt", "plain words only"), (3, "a/b/COPYING", gpl + "\n"), (4, "a/d.txt", None), (5, "z/y.txt", "nothing"),
            (6, None, "nothing"), (7, "z/w.txt", "some prose first\n" + license.TEMPLATES["CC-BY-NC-4.0"][0] + "\nmore prose"), (8, "a/b/c/x.txt", ""),
            (9, "z/long.txt", "filler words " * 20000 + "\n" + mit)]
    rows += [(100 + i, f"q/{i}", "filler text of other words") for i in range(60)]
    got = {r["file"]: r for r in license.scan(spark.createDataFrame([(*r, "clash") for r in rows], "file bigint, path string, text string, license string")).collect()}
    assert len(got) == len(rows)
    assert [got[i]["license"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == ["MIT", "GPL-3.0", "GPL-3.0", "MIT", None, None, "CC-BY-NC-4.0", "GPL-3.0", "MIT"]
    assert [got[i]["how"] for i in (1, 2, 4, 5, 7)] == ["file", "inherited", "inherited", "none", "header"]
    assert license.scan(spark.createDataFrame([], "file bigint, path string, text string")).count() == 0


def test_license_rows_without_or_with_repeated_ids(spark):
    mit, gpl = license.TEMPLATES["MIT"][0], license.TEMPLATES["GPL-3.0"][0]
    rows = [(None, "a/x.txt", mit), (None, "b/y.txt", "plain words only"), (5, "c/z.txt", gpl), (5, "d/w.txt", "plain words"),
            (6, "e/LICENSE", mit), (7, "e/COPYING", mit), (8, "e/f/g.txt", "plain")]
    out = license.scan(spark.createDataFrame(rows, "file bigint, path string, text string")).collect()
    assert sorted(((r["file"], r["license"], r["how"], r["license_dir"]) for r in out), key=repr) == sorted([
        (None, "MIT", "file", None), (None, None, "none", None), (5, "GPL-3.0", "file", None), (5, None, "none", None),
        (6, "MIT", "file", None), (7, "MIT", "file", None), (8, "MIT", "inherited", "e")], key=repr)


# 8 chat
def test_chat_round_trip_of_hostile_texts():
    rng = random.Random(9)
    pieces = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "a", "<", "[", " ", "\\n", "é"]
    for _ in range(3000):
        role = rng.choice([None, "user", "assistant", "", "\\0", "a\nb", "<s>[INST]"])
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        out, start, end = chat.formatted_turn(role, text)
        assert chat.parse(out + out) == [(role, text, start, end), (role, text, start + len(out), end + len(out))]
        assert not any(c in out[start:end] for c in chat.CONTROL)
        assert out[start:end] == text or any(c in text for c in (*chat.CONTROL, "\\"))


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, None, None, "</s>"), (3, 0, "assistant", ""), (3, 0, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, rendered int"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\na\nassistant\nb\n") and got[1]["loss_sha256"] == sha("b") and got[1]["loss_chars"] == 1
    assert got[2]["turns_sha256"] == sha("\n</s>\nuser\n\n") and got[2]["loss_chars"] == 0
    assert got[3]["n_turns"] == 2
    assert chat.digests(chat.formatted(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


# 9 packing
def test_encoder_equals_the_tokenizer(texts):
    rng = random.Random(1)
    parts = ["a", "b", "'s", "'ll", "1", "9", ".", " ", "  ", "\n", "\t", "\r\n", "é", "¿", " ", " ", "　", "\x1c", "…", "<|endoftext|>", "日本", "\x85", "\x00", " \n", "🙂"]
    tried = [*texts, *["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]]
    encoder = packing.Encoder(packing.tokenizer_path())
    for _ in range(2):  # the second time from the cache
        assert [x.tolist() for x in encoder(pa.array(tried))] == encoder.encode([t or "" for t in tried])


def test_packing_places_every_piece(docs, texts, empty):
    out = packing.packed_documents(docs).collect()
    encoder = packing.Encoder(packing.tokenizer_path())
    for i, t in enumerate(texts):
        ids = np.array([*encoder.encode([t or ""])[0], 0], "<u4")
        own = sorted((r for r in out if r["doc_id"] == 3 * i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert all(r["length"] == 2048 for r in own[1:])
    spans = defaultdict(list)
    for r in out:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed_documents(empty).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(0, 120))), reverse=True)
        rooms = []
        for x in lengths:
            fit = min((r for r in rooms if r >= x), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((64 if fit is None else fit) - x)
        runs, used = packing.plan(dict(Counter(lengths)), 64)
        assert used == len(rooms)
        assert sum(r["n"] * r["each"] for r in runs) == len(lengths)


# 10 sharding
def test_sharding_is_exact_and_uniform(docs, texts, empty):
    rows = docs.select("doc_id", "text")
    out = sharding.shuffle_into_shards(rows, ["doc_id"], 7).collect()
    per = Counter(r["shard"] for r in out)
    assert len(out) == len(texts) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(per[s]))
    again = sharding.shuffle_into_shards(rows.repartition(2), ["doc_id"], 7).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    assert sharding.shuffle_into_shards(empty, ["doc_id"]).count() == 0


def test_communication_matrix_has_its_margins_and_law():
    rng = random.Random(0)
    for seed in range(20):
        sizes = [rng.randint(0, 50) for _ in range(6)]
        shards = [sum(sizes) // 4 + (j < sum(sizes) % 4) for j in range(4)]
        m = sharding.communication_matrix(sizes, shards, seed)
        assert [sum(r) for r in m] == sizes and [sum(c) for c in zip(*m, strict=True)] == shards
    rng = random.Random(5)
    drawn = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(drawn) - 6) < 0.15 and abs(np.var(drawn) - 20 * 0.3 * 0.7 * 80 / 99) < 0.35
    assert 10**11 // 3 < sharding.hypergeometric(rng, 10**12, 10**12, 10**12) < 10**12
