"""Toxicity by a Levenshtein automaton over a lexicon trie, and context windows around what it finds.

The lexicon is learned from labelled documents: words, and beginnings of words, that toxic documents use and others don't. Its
trie is intersected with the Levenshtein automaton of one edit, and the product is made deterministic, so all words of a block
of texts run through one table, character by character, as arrays. What it accepts, exactly or misspelled, is scored by the
words and quotation marks around it: contexts that labelled documents show around quoted terms lower a term's weight, those
around abuse raise it. A logistic function of the summed scores is the probability.

Defined results: a null, blank or clean text has the score of a text without terms; without labels of both kinds every text
scores 0; a document with several labels counts as toxic if one is; ids, languages, sources and labels are never inputs of a
score; repeated rows score alike; an empty table stays empty; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import hash31, table, word_array, word_count
from fareflow.scale import checkpointed

#: Labelled documents that the lexicon and the weights are learned from, chosen by hash, as many of each label at most.
FIT_ROWS_PER_LABEL = 5_000
LEAST_DOCUMENTS = 4
LEAST_SHARE = 0.003
LEAST_ODDS = 6.0
FUZZY_ODDS = 100.0
STEM_LENGTHS = (4, 5, 6, 7)
CONTEXT = 5
EDITS_FROM = 5
_OTHER = "\0"
_QUOTES = "\"'“”„«»‘’`"


def cleaned(word: str) -> str:
    return word.strip(".,;:!?()[]{}…-_*#&%$|<>" + _QUOTES).lower()


@dataclass
class Automaton:
    """A deterministic table for the trie of terms within ``edits`` edits; a term that ends in * is a beginning of words."""

    alphabet: dict[str, int]
    step: np.ndarray
    term: np.ndarray
    edits: np.ndarray

    def run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word the term that it is (-1: none) and the edits it took."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        code = np.zeros(max(0x250, int(joined.max()) + 1 if len(joined) else 1), np.int32)
        for c, i in self.alphabet.items():
            if c != _OTHER and ord(c) < len(code):
                code[ord(c)] = i
        letters = code[joined]
        at, state = np.cumsum(size) - size, np.full(len(words), 1, np.int32)
        order = np.argsort(-size, kind="stable")
        live = order
        for k in range(int(size.max(initial=0))):
            live = live[(size[live] > k)]
            live = live[state[live] > 0]
            if not len(live):
                break
            state[live] = self.step[state[live], letters[at[live] + k]]
        return self.term[state], self.edits[state]


def automaton(terms: list[str], strong: list[bool] | None = None) -> Automaton:
    """Subset construction of (trie node, edits used) pairs; state 0 is dead, 1 the start.

    Terms under ``EDITS_FROM`` letters, beginnings of words and terms that aren't ``strong`` take no edit.
    """
    tall = {t for i, t in enumerate(terms) if not t.endswith("*") and len(t) >= EDITS_FROM and (strong is None or strong[i])}
    children: list[dict[str, int]] = [{}]
    ends: dict[int, int] = {}
    loose: set[int] = set()
    fuzzy: list[bool] = [False]
    for t, term in enumerate(terms):
        node, word = 0, term.rstrip("*")
        allows = term in tall
        fuzzy[0] |= allows
        for c in word:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                fuzzy.append(False)
            node = children[node][c]
            fuzzy[node] |= allows
        if term.endswith("*"):
            loose.add(node)
        ends.setdefault(node, t)
    letters = [_OTHER, *sorted({c for term in terms for c in term.rstrip("*")})]
    fuzzy_ends = {n for n, t in ends.items() if terms[t] in tall}

    def spread(pairs: dict[int, int]) -> frozenset:
        """Least edits for each node, letters of a term left out included."""
        todo = list(pairs.items())
        while todo:
            node, e = todo.pop()
            if e == 0:
                for n in children[node].values():
                    if fuzzy[n] and pairs.get(n, 9) > 1:
                        pairs[n] = 1
        return frozenset(pairs.items())

    def after(state: frozenset, c: str) -> frozenset:
        out: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e < out.get(node, 9) and (e == 0 or fuzzy[node]):
                out[node] = e

        for node, e in state:
            if node < 0:
                put_loose = -node - 1
                out[-put_loose - 1] = 0
                continue
            if node in loose and e == 0:
                out[-node - 1] = 0
            n = children[node].get(c)
            if n is not None:
                put(n, e)
            if e == 0:
                put(node, 1)
                for k, m in children[node].items():
                    if k != c:
                        put(m, 1)
        return spread(out)

    start = spread({0: 0})
    number, todo = {frozenset(): 0, start: 1}, [start]
    step: list[list[int]] = [[0] * len(letters), [0] * len(letters)]
    while todo:
        state = todo.pop()
        own = number[state]
        for i, c in enumerate(letters):
            to = after(state, c)
            if to not in number:
                number[to] = len(number)
                step.append([0] * len(letters))
                todo.append(to)
            step[own][i] = number[to]
    term, edits = np.full(len(number), -1, np.int64), np.zeros(len(number), np.int64)
    for state, i in number.items():
        best = None
        for node, e in state:
            at = -node - 1 if node < 0 else node
            if at in ends and (e == 0 or at in fuzzy_ends):
                best = min(best or (9, 0), (e, ends[at]))
        if best:
            edits[i], term[i] = best
    return Automaton({c: i for i, c in enumerate(letters)}, np.array(step, np.int32), term, edits)


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weight: list[float] = field(default_factory=list)
    context: dict[str, float] = field(default_factory=dict)
    quoted: float = 0.0
    misspelled: float = 0.0
    curve: tuple[float, ...] = ()
    table: Automaton | None = None


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def in_quotes(words: list[str], at: int) -> bool:
    """Whether a word stands in quotation marks of its own or of its context window."""
    if words[at][0] in _QUOTES or words[at].rstrip(".,;:!?")[-1:] in _QUOTES:
        return True
    before = words[max(0, at - CONTEXT): at]
    after = words[at + 1: at + 1 + CONTEXT]
    opens = any(w[0] in _QUOTES for w in before) and not any(w.rstrip(".,;:!?")[-1:] in _QUOTES for w in before)
    return opens and any(w.rstrip(".,;:!?")[-1:] in _QUOTES for w in after)


def matches(model: Model, texts: list[str]) -> Iterator[list[tuple[int, int, list[str]]]]:
    """For each text its matches: (place, term, edits) with its words. Each distinct word of the block is run once."""
    split = [words_of(t) for t in texts]
    codes, distinct = pd.factorize(np.array([w for ws in split for w in ws], object))
    term, edits = model.table.run([cleaned(w) for w in distinct])
    found, cost = term[codes], edits[codes]
    at = 0
    for ws in split:
        own = np.flatnonzero(found[at: at + len(ws)] >= 0)
        yield [(int(i), int(found[at + i]), int(cost[at + i])) for i in own], ws
        at += len(ws)


def evidence(model: Model, hits: list, words: list[str]) -> float:
    """Sum of the context-window scores of a text's terms."""
    total = 0.0
    for place, term, edits in hits:
        around = {cleaned(w) for w in words[max(0, place - CONTEXT): place] + words[place + 1: place + 1 + CONTEXT]}
        score = model.weight[term] + sum(model.context.get(w, 0.0) for w in around)
        if edits:
            score *= 1 - model.misspelled
        if in_quotes(words, place):
            score *= 1 - model.quoted
        total += max(0.0, score)
    return total


def inputs(evidence_: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """What the curve sees of a text: its evidence, evidence a hundred words, and how long it is."""
    return np.column_stack([np.log1p(evidence_), np.minimum(evidence_, 60) / 10,
                            np.log1p(100 * evidence_ / (n_words + 20)), np.log1p(n_words) / 5, np.ones(len(n_words))])


def curve(model: Model, evidence_: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(inputs(evidence_, n_words) @ np.array(model.curve), -30, 30)))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    if model.table is None:
        return np.zeros(len(texts))
    seen = [(evidence(model, hits, words), len(words)) for hits, words in matches(model, texts)]
    return curve(model, np.array([x for x, _ in seen], float), np.array([n for _, n in seen], float))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int, seed: int = 23) -> DataFrame:
    """toxic, text of a bounded number of labelled documents that aren't held out."""
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(F.col("toxic") == k, F.lit(min(1.0, per_label / n))).otherwise(share)
    chosen = marks.where(hash31(F.lit(seed), F.col("doc_id")) < share * F.lit(2.0**31))
    # at most 2 * per_label ids on average, whatever the number of labels: broadcast, so that no text is moved
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies teach once


def lexicon(rows: DataFrame) -> list[dict]:
    """Terms (t) with their toxic documents (docs) and their uses in documents of either label (p, n), counted on Spark.

    Uses in one document count five times at most, so that a line repeated without end doesn't make a term.
    """
    bare = F.transform(word_array(F.col("text")), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    words = rows.select("toxic", F.monotonically_increasing_id().alias("d"), F.explode(bare).alias("w")).where(F.length("w") >= 3)
    stems = [F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in STEM_LENGTHS]
    uses = (words.select("toxic", "d", F.explode(F.array(F.col("w"), *stems)).alias("t")).where(F.col("t").isNotNull())
            .groupBy("t", "d", "toxic").agg(F.least(F.count("*"), F.lit(5)).alias("k")))
    bad = F.col("toxic") == 1
    counts = uses.groupBy("t").agg(F.sum(bad.cast("long")).alias("docs"), F.sum(F.when(bad, F.col("k")).otherwise(0)).alias("p"),
                                   F.sum(F.when(bad, 0).otherwise(F.col("k"))).alias("n"))
    return [r.asDict() for r in counts.where(f"docs >= {LEAST_DOCUMENTS} and p >= n / 50").collect()]


def telling(found: list[dict], words_bad: int, words_good: int, least_docs: float = LEAST_DOCUMENTS) -> dict[str, float]:
    """Terms and their log odds: those that say most come first, and what is a part of one already taken is left out."""
    scored_ = []
    for r in found:
        odds = ((r["p"] + 0.5) / (words_bad + 1)) / ((r["n"] + 0.5) / (words_good + 1))
        least = least_docs * (3 if r["t"].endswith("*") else 1)
        if odds >= LEAST_ODDS and r["docs"] >= least:
            says = r["p"] * math.log(odds) * (1.0 if r["t"].endswith("*") else 1.15)
            scored_.append((-says, r["t"], math.log(odds)))
    chosen: dict[str, float] = {}
    parts: set[str] = set()
    for _, term, weight in sorted(scored_):
        word = term.rstrip("*")
        covered = any(word[:k] + "*" in chosen for k in range(min(STEM_LENGTHS), len(word) + 1))
        if covered or (term.endswith("*") and word in parts):
            continue
        chosen[term] = weight
        parts |= {word[:k] for k in range(min(STEM_LENGTHS), len(word) + 1)}
    return chosen


def fitted(docs: DataFrame, labels: DataFrame, per_label: int = FIT_ROWS_PER_LABEL) -> Model:
    """Lexicon, context weights and the logistic curve. What reaches the driver is bounded by ``per_label`` documents."""
    rows = checkpointed(training_rows(docs, labels, per_label))
    n = {r["toxic"]: (r["d"], r["w"]) for r in rows.groupBy("toxic").agg(
        F.count("*").alias("d"), F.sum(word_count(F.col("text"))).alias("w")).collect()}
    bad, good = n.get(1, (0, 0)), tuple(map(sum, zip(*[v for k, v in n.items() if k != 1], strict=True))) or (0, 0)
    if not bad[0] or not good[0]:
        return Model()
    chosen = telling(lexicon(rows), bad[1], good[1], max(LEAST_DOCUMENTS, LEAST_SHARE * bad[0]))
    model = Model(list(chosen), list(chosen.values()))
    if not chosen:
        return Model()
    model.table = automaton(model.terms, [math.exp(w) >= FUZZY_ODDS for w in model.weight])
    return calibrated(model, rows, bad[0], good[0])


def calibrated(model: Model, rows: DataFrame, bad: int, good: int) -> Model:
    """Context words around terms in documents of either label, quotation and spelling, then slope and bias.

    The tasks send, for each training document with a match, its label and what stands around its matches: a bounded
    number of documents, and numbers in place of texts.
    """
    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            texts = b["text"].fillna("").tolist()
            for toxic, (hits, words) in zip(b["toxic"], matches(model, texts), strict=True):
                near = Counter()
                for place, _, _ in hits:
                    near.update({cleaned(w) for w in words[max(0, place - CONTEXT): place] + words[place + 1: place + 1 + CONTEXT]})
                out.append((int(toxic == 1), len(hits), sum(in_quotes(words, h[0]) for h in hits), sum(h[2] > 0 for h in hits),
                            [w for w, _ in near.most_common() if w]))
            yield pd.DataFrame(out, columns=["toxic", "hits", "quoted", "edited", "near"])

    seen = checkpointed(rows.mapInPandas(around, "toxic int, hits int, quoted int, edited int, near array<string>"))
    matched = seen.where("hits > 0")
    r = matched.agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == t, F.col(c).cast("double"))), F.lit(0.0)).alias(f"{c}{t}")
                      for c in ("hits", "quoted", "edited") for t in (0, 1)]).first()
    for c, name in (("quoted", "quoted"), ("edited", "misspelled")):
        harmless = (r[f"{c}0"] + 0.5) / (r["hits0"] + 1) if r["hits0"] >= 20 else 0.0
        abusive = (r[f"{c}1"] + 0.5) / (r["hits1"] + 1)
        setattr(model, name, max(0.0, min(0.95, 1 - abusive / harmless)) if harmless else 0.0)
    near = (matched.select("toxic", F.explode("near").alias("w")).groupBy("w")
            .agg(F.sum(F.col("toxic")).alias("p"), F.sum(1 - F.col("toxic")).alias("n")).where("n >= 10"))
    docs = {t: matched.where(f"toxic = {t}").count() for t in (0, 1)}
    for w in near.collect():
        odds = math.log(((w["p"] + 0.5) / (docs[1] + 1)) / ((w["n"] + 0.5) / (docs[0] + 1)))
        if odds < -1.5:
            model.context[w["w"]] = odds

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen_ = [(evidence(model, hits, words), len(words)) for hits, words in matches(model, b["text"].fillna("").tolist())]
            yield pd.DataFrame({"y": (b["toxic"] == 1).astype(float), "x": [x for x, _ in seen_], "n": [float(n) for _, n in seen_]})

    numbers = rows.mapInPandas(weighed, "y double, x double, n double").toPandas()  # three numbers a training document
    model.curve = tuple(logistic(inputs(numbers["x"].to_numpy(), numbers["n"].to_numpy()), numbers["y"].to_numpy()))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        d = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= np.clip(d, -1, 1)
        if np.abs(d).max() < 1e-9:
            break
    return w


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_terms and spans (place of a word, term, edits) for each row of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("").tolist()
            size, at = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size > 4_000_000 or i == len(texts) - 1:
                    part = texts[at: i + 1]
                    hits = [h for h, _ in matches(model, part)] if model.table else [[] for _ in part]
                    yield pd.DataFrame({"doc_id": b["doc_id"].iloc[at: i + 1].array, "score": scores(model, part),
                                        "n_terms": [len(h) for h in hits],
                                        "spans": [[{"word": p, "term": model.terms[t], "edits": e} for p, t, e in h] for h in hits]})
                    size, at = 0, i + 1

    return docs.select("doc_id", "text").mapInPandas(
        rows, f"doc_id {kind}, score double, n_terms int, spans array<struct<word: int, term: string, edits: int>>")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document with its toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fitted(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms")


__all__ = ["Automaton", "Model", "automaton", "fitted", "op3_toxicity", "scored", "scores"]
