"""Quality rules: a learned decision list over text statistics (DataFrame functions only).

Sequential covering: a rule is a conjunction of thresholds that is grown condition by condition on two thirds of the
labelled rows, cut back on the other third, and kept if it is precise there; the rows it covers are taken out and the
next rule is grown. The list becomes one ordered Spark conditional expression.

Defined results: a null or blank text has no words and fails the base rule; without labels of both kinds there are no
learned rules; a label whose document is missing, or is null, is not used; a document that has several labels counts as bad
if one of them is; repeated rows are judged one by one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareflow.llm.common import GAP, hash31, table
from fareflow.scale import checkpointed

SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8
#: Labelled rows that are used to learn, chosen by hash; all rows are judged.
FIT_ROWS = 500_000
CUTS = 64
LEAST_PRECISION = 0.97
MOST_CONDITIONS = 4
MOST_RULES = 24


def base_statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """``docs`` (doc_id, text, and the columns ``carried``) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what features need.

    All are expressions over the row's own text; the text itself is dropped. Repeated windows are looked for only where
    two windows of a text are equal: their starts are sorted with the window, and words that the marked starts cover
    are counted from the distances between starts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    gap_free = F.length("__t") - F.length(F.regexp_replace("__t", r"[^\x20\x09-\x0D]+", ""))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\u000b\f\r"))) > 0)
    split = docs.select("doc_id", *carried, text.alias("__t")).select(
        "doc_id", *carried, "__t", F.filter(F.split("__t", GAP), lambda w: w != "").alias("__w"), lines.alias("__l"))
    n = F.size("__w")
    keys = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice(F.col("__w"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id", *carried, n.cast("long").alias("n_words"), gap_free.cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace("__t", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("__t", r"[^0-9]+", "")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("__t", r"[^!?]+", "")).cast("long").alias("n_marks"),
        keys.alias("__k"))
    sorted_ = F.array_sort(F.arrays_zip(F.col("__k").alias("h"), F.sequence(F.lit(1), F.size("__k")).alias("i")))
    again = F.when(F.size("__k") > F.size(F.array_distinct("__k")), sorted_)
    marked = counted.withColumn("__s", again).drop("__k")
    last = F.size("__s")
    starts = F.array_sort(F.filter(F.transform("__s", lambda x, j: F.when(
        ((j > 0) & (F.get("__s", j - 1)["h"] == x["h"])) | ((j < last - 1) & (F.get("__s", j + 1)["h"] == x["h"])),
        x["i"])), lambda i: i.isNotNull()))
    covered = F.aggregate(
        "__starts", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(i - a["at"], F.lit(WINDOW))).alias("n"), i.alias("at")),
        lambda a: a["n"])
    return (marked.withColumn("__starts", starts).drop("__s")
            .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__starts"))


def features() -> dict[str, Column]:
    """What rules are made of: shares that don't depend on the length of a text, and the length itself."""
    def share(top: str, below: str) -> Column:
        return F.when(F.col(below) > 0, F.col(top) / F.col(below)).otherwise(0.0)

    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": share("word_chars", "n_words"), "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"), "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"), "marks_per_word": share("n_marks", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    cut: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= self.cut if self.at_least else of[self.feature] < self.cut


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self, of: dict[str, Column]) -> Column:
        held = F.lit(True)
        for c in self.conditions:
            held = held & c.column(of)
        return held

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>=' if c.at_least else '<'} {c.cut:.6g}" for c in self.conditions)


def rejects(rules: list[Rule], of: dict[str, Column] | None = None) -> Column:
    """The ordered list as one conditional expression: the number of the first rule that rejects, or null."""
    of = of or features()
    if not rules:
        return F.lit(None).cast("int")
    chain = F.when(rules[0].column(of), 1)
    for i, r in enumerate(rules[1:], 2):
        chain = chain.when(r.column(of), i)
    return chain


def learn(statistics: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, seed: int = 5) -> list[Rule]:
    """Rules for quality 0. ``statistics``: of all documents; ``labels``: doc_id, quality. The driver sees counts only."""
    named = features()
    marks = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    total = marks.count()
    if total > fit_rows:
        marks = marks.where(hash31(F.lit(seed), F.col("doc_id")) < int(2**31 * fit_rows / total))
    known = checkpointed(statistics.where(~base_failed()).join(marks, "doc_id").select(
        (F.col("quality") == 0).alias("bad"), (hash31(F.lit(seed + 1), F.col("doc_id")) % 3 > 0).alias("grows"),
        *[c.alias(n) for n, c in named.items()]))
    points = [i / CUTS for i in range(1, CUTS)]
    edges: dict[str, set[float]] = {n: set() for n in named}
    for r in known.groupBy("bad").agg(*[F.percentile_approx(n, points, 10_000).alias(n) for n in named]).collect():
        for n in named:
            edges[n] |= {float(v) for v in r[n] or ()}
    cuts = {n: sorted(v) for n, v in edges.items()}
    bins = F.array(*[bin_of(F.col(n), cuts[n]) for n in named])
    rows = checkpointed(known.select("bad", "grows", bins.alias("bins")))
    names, rules, open_ = list(named), [], rows
    for _ in range(MOST_RULES):
        rule = grown(open_, names, cuts)
        if rule is None:
            break
        rules.append(rule)
        open_ = open_.where(~in_bins(rule.conditions, names, cuts))
    return rules


def bin_of(value: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts a value reaches."""
    edges = F.array(*[F.lit(c) for c in cuts]).cast("array<double>")
    return F.size(F.filter(edges, lambda c: c <= value))


def in_bins(conditions, names: list[str], cuts: dict[str, list[float]]) -> Column:
    """Conditions over the numbered cuts of a row."""
    held = F.lit(True)
    for c in conditions:
        bin_, edge = F.get("bins", F.lit(names.index(c.feature))), cuts[c.feature].index(c.cut) + 1
        held = held & (bin_ >= edge if c.at_least else bin_ < edge)
    return held


def grown(rows: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> Rule | None:
    """Grow a rule on the growing rows, cut it back on the others; none if it isn't precise there."""
    chosen: list[Condition] = []
    while len(chosen) < MOST_CONDITIONS:
        sums = (rows.where(F.col("grows") & in_bins(chosen, names, cuts)).select("bad", F.posexplode("bins").alias("f", "b"))
                .groupBy("f", "b").agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count("*").alias("n")).collect())
        if not sums:
            break
        best, gain = None, 0.0
        for f, name in enumerate(names):
            own = {r["b"]: (r["p"], r["n"]) for r in sums if r["f"] == f}
            p_all, n_all = sum(p for p, _ in own.values()), sum(n for _, n in own.values())
            if not p_all or p_all == n_all:
                continue
            bits = math.log2(p_all / n_all)
            p_low = n_low = 0
            for b, cut in enumerate(cuts[name]):
                p, n = own.get(b, (0, 0))
                p_low, n_low = p_low + p, n_low + n
                for at_least, p, n in ((True, p_all - p_low, n_all - n_low), (False, p_low, n_low)):
                    if p and (g := p * (math.log2((p + 0.1) / (n + 0.2)) - bits)) > gain:
                        best, gain = Condition(name, at_least, cut), g
        if best is None:
            break
        chosen.append(best)
    if not chosen:
        return None
    held = [in_bins(chosen[:k + 1], names, cuts) for k in range(len(chosen))]
    r = rows.where(~F.col("grows")).agg(*[x for k, h in enumerate(held) for x in (
        F.coalesce(F.sum(h.cast("long")), F.lit(0)).alias(f"n{k}"),
        F.coalesce(F.sum((h & F.col("bad")).cast("long")), F.lit(0)).alias(f"p{k}"))]).first()
    scored = [((2 * r[f"p{k}"] - r[f"n{k}"]) / max(r[f"n{k}"], 1), r[f"p{k}"], -k) for k in range(len(chosen)) if r[f"n{k}"]]
    if not scored:
        return None
    k = -max(scored)[2]
    p, n = r[f"p{k}"], r[f"n{k}"]
    if p < 3 or (p + 1) / (n + 2) < LEAST_PRECISION * min(1.0, n / (n + 2.0) + 1e-9) or p / n < LEAST_PRECISION:
        return None
    return Rule(tuple(chosen[:k + 1]), p / n, n)


def judged(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """``statistics`` with base_failed, rule (the first that rejects, or null) and kept."""
    return (statistics.withColumn("base_failed", base_failed()).withColumn("rule", rejects(rules))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its statistics and the verdict of the rules that its labels teach."""
    statistics = checkpointed(base_statistics(table(spark, sf_dir, "documents").select("doc_id", "text")))
    rules = learn(statistics, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged(statistics, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the learned rules keep, each by its own verdict: a row's columns go with its statistics."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    statistics = checkpointed(base_statistics(rows, "__row"))
    rules = learn(statistics.drop("__row"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged(statistics, rules).where("kept").select("__row.*")
