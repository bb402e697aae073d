"""Statistics against brute force in numpy/pandas, published tables and pyspark.ml."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from fareflow.functions import pvalues
from fareflow.operators import association as a
from fareflow.operators import evaluation as ev
from fareflow.operators import profile, rank_stats
from fareflow.operators.features import add_calendar
from fareflow.scale import exact_quantiles, running_totals, value_counts_long
from fareflow.sources.tables import bookings


def test_tails_match_tables():
    assert pvalues.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert pvalues.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert pvalues.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert pvalues.t_two_sided(1.959963984540054, 1e9) == pytest.approx(0.05, abs=1e-9)
    # tea tasting: two-sided 0.4857142857
    assert pvalues.fisher_two_sided(3, 1, 1, 3) == pytest.approx(34 / 70, abs=1e-12)


def test_fisher_equals_enumeration():
    rng = np.random.default_rng(1)
    for a_, b, c, d in rng.integers(0, 12, (40, 4)).tolist():
        n = a_ + b + c + d
        if n == 0:
            continue
        r1, c1 = a_ + b, a_ + c
        p = {k: math.comb(r1, k) * math.comb(n - r1, c1 - k) / math.comb(n, c1) for k in range(max(0, r1 + c1 - n), min(r1, c1) + 1)}
        want = sum(v for v in p.values() if v <= p[a_] * (1 + 1e-7))
        assert pvalues.fisher_two_sided(a_, b, c, d) == pytest.approx(want, abs=1e-10)


def test_fisher_far_from_the_mode():
    def exact(a, b, c, d):
        r1, c1, n = a + b, a + c, a + b + c + d
        ways = [math.comb(r1, k) * math.comb(n - r1, c1 - k) for k in range(max(0, r1 + c1 - n), min(r1, c1) + 1)]
        own = math.comb(r1, a) * math.comb(n - r1, c1 - a)
        return float(Fraction(sum(w for w in ways if w <= own), math.comb(n, c1)))

    for cells in ((51, 0, 0, 10_000), (0, 10_000, 51, 0), (60, 2, 1, 9_000), (400, 100, 100, 400)):
        assert pvalues.fisher_two_sided(*cells) == pytest.approx(exact(*cells), rel=1e-7)


def test_fisher_large_counts():
    p = pvalues.fisher_two_sided(500_000_100, 499_999_900, 499_999_900, 500_000_100)
    z = (500_000_100 - 5e8) / math.sqrt(2e9 / 16)
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-2)


def test_chi_square_equals_ml(spark, sf):
    df = add_calendar(bookings(spark, sf, "date", "is_cancelled"))
    ours = a.nominal_stats(df, "weekday", p_value=True).first()
    packed = VectorAssembler(inputCols=["weekday"], outputCol="v").transform(df)
    ml = ChiSquareTest.test(packed, "v", "is_cancelled").first()
    assert ours.p_value == pytest.approx(ml.pValues[0], abs=1e-9) and ours.dof == ml.degreesOfFreedom[0]


def test_yates_two_by_two(spark):
    df = spark.createDataFrame([("a", 1)] * 10 + [("a", 0)] * 20 + [("b", 1)] * 30 + [("b", 0)] * 5, "x string, y int")
    o = np.array([[10, 20], [30, 5]])
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    want = ((np.abs(o - e) - np.minimum(0.5, np.abs(o - e))) ** 2 / e).sum()
    assert a.cramers_v(df, "x", "y").first().chi2 == pytest.approx(want)


def test_missing_cells_count(spark):
    df = spark.createDataFrame([("a", "u")] * 4 + [("b", "v")] * 3 + [("c", "w")] * 5 + [("c", "v")], "x string, y string")
    o = pd.crosstab(df.toPandas().x, df.toPandas().y).to_numpy()
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert a.cramers_v(df, "x", "y").first().chi2 == pytest.approx(((o - e) ** 2 / e).sum())


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    n = 400
    y = rng.integers(0, 2, n)
    x = np.round(rng.normal(size=n) + y, 1)
    z = rng.normal(size=n) + 0.5 * x
    return pd.DataFrame({"x": x, "z": z, "y": y, "p": np.round(1 / (1 + np.exp(-z)), 3)})


def test_moments_equal_pandas(spark, sample):
    got = {r.column: r for r in profile.column_stats(spark.createDataFrame(sample), ["x", "z"]).collect()}
    for c in ("x", "z"):
        s = sample[c]
        assert (got[c].std, got[c].skew, got[c].kurtosis) == pytest.approx((s.std(), s.skew(), s.kurt()), rel=1e-9)


def test_quantiles_equal_numpy(spark, sample):
    probs = [0, 0.1, 0.25, 0.5, 0.9, 1]
    q = exact_quantiles(value_counts_long(spark.createDataFrame(sample), ["x", "z"]), probs)
    got = {(r.feature, r.q): r.value for r in q.collect()}
    for c in ("x", "z"):
        for p in probs:
            assert got[c, p] == pytest.approx(np.quantile(sample[c], p), rel=1e-12)


@pytest.mark.parametrize("slices", [1, 3, 50])
def test_running_totals_any_slicing(spark, slices):
    df = spark.createDataFrame([(g, i, i % 3) for g in "ab" for i in range(40)], "g string, i int, n int")
    for r in running_totals(df, "i", ["n"], ["g"], slices).collect():
        assert r.n_before == sum(k % 3 for k in range(r.i)) and r.n_total == sum(k % 3 for k in range(40))


def test_spearman_equals_pandas(spark, sample):
    rho = rank_stats.spearman(spark.createDataFrame(sample), "x", "z", p_value=True).first()
    want = sample.x.rank().corr(sample.z.rank())
    assert rho.rho == pytest.approx(want) and 0 <= rho.p_value <= 1
    assert rank_stats.spearman_trend(spark.createDataFrame(sample), "x", "z").first().rho == pytest.approx(want)


def test_correlations_equal_pandas(spark, sample):
    df = spark.createDataFrame(sample)
    want = sample[["x", "z", "y"]].corr()
    for complete in (True, False):
        for r in a.correlation_pairs(df, ["x", "z", "y"], complete).collect():
            assert r.r == pytest.approx(want.loc[r.feature_a, r.feature_b])


def test_correlation_skips_nulls_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 5.0), (4.0, 4.0), (None, 9.0)], "a double, b double")
    assert a.correlation_pairs(df, ["a", "b"]).first().r == pytest.approx(df.toPandas().corr().loc["a", "b"])


def test_vif_equals_least_squares(spark, sample):
    x = sample[["x", "z", "y"]].to_numpy(dtype=float)
    for r in a.variance_inflation(spark.createDataFrame(sample), ["x", "z", "y"]).collect():
        i = ["x", "z", "y"].index(r.feature)
        rest = np.delete(x, i, axis=1)
        fit = rest @ np.linalg.lstsq(rest, x[:, i], rcond=None)[0]
        assert r.vif == pytest.approx((x[:, i] @ x[:, i]) / ((x[:, i] - fit) @ (x[:, i] - fit)), rel=1e-8)


def test_vif_of_dependent_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7)) for i in range(1, 30)], "a double, b double, c double")
    got = {r.feature: r.vif for r in a.variance_inflation(df, ["a", "b", "c"]).collect()}
    assert math.isinf(got["a"]) and math.isinf(got["b"]) and math.isfinite(got["c"])


def _digamma(x):
    total = 0.0
    while x < 6:
        total -= 1 / x
        x += 1
    f = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def _knn_mi(x, y, k):
    """All pairs, by definition: radius to the k-th same-class point, then points of any class inside it."""
    a_, b, c = [], [], []
    for i in range(len(x)):
        same = np.sort(np.abs(np.delete(x[y == y[i]], np.flatnonzero(np.flatnonzero(y == y[i]) == i)) - x[i]))
        kk = min(k, len(same))
        r = same[kk - 1]
        copies = (x[y == y[i]] == x[i]).sum()
        a_.append(_digamma(copies if r == 0 else kk))
        b.append(_digamma((y == y[i]).sum()))
        c.append(_digamma((np.abs(x - x[i]) <= 0).sum() if r == 0 else (np.abs(x - x[i]) < r - 1e-9 * r).sum()))
    return max(0.0, _digamma(len(x)) + np.mean(a_) - np.mean(b) - np.mean(c))


@pytest.mark.parametrize("partitions", ["1", "8", "37"])
def test_knn_information_equals_brute_force(spark, sample, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(sample[["x", "z", "y"]])
        got = {r.feature: r.mutual_information for r in rank_stats.knn_mutual_information(df, ["x", "z"], "y").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for c in ("x", "z"):
        assert got[c] == pytest.approx(_knn_mi(sample[c].to_numpy(), sample.y.to_numpy(), 5), abs=1e-6)


def test_digamma(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (2,), (10,)], "x int").select(rank_stats.digamma(F.col("x"))).collect()]
    assert got == pytest.approx([-0.5772156649, 0.4227843351, 2.2517525891], abs=1e-8)


def test_sweep_equals_brute_force(spark, sample):
    got = {r.step: r for r in ev.threshold_sweep(spark.createDataFrame(sample), "y", "p").collect()}
    y, p = sample.y.to_numpy(), sample.p.to_numpy()
    assert len(got) == 80
    for i, t in enumerate(np.arange(0.1, 0.9, 0.01)):
        assert got[i].threshold == t
        hit = p >= t
        assert (got[i].tp, got[i].fp) == ((hit & (y == 1)).sum(), (hit & (y == 0)).sum())
    best = ev.best_threshold(ev.threshold_sweep(spark.createDataFrame(sample), "y", "p")).first()
    assert best.best_f_beta == max(r.f_beta for r in got.values())
    assert best.best_threshold == min(r.threshold for r in got.values() if r.f_beta == best.best_f_beta)


def test_score_on_a_threshold(spark):
    """Scores equal to grid values: most grid doubles lie just below the nominal value."""
    grid = [float(t) for t in np.arange(0.1, 0.9, 0.01)]
    scores = grid + [round(0.1 + i / 100, 2) for i in range(80)] + [0.0, 0.0999, 0.9, 1.0]
    df = spark.createDataFrame([(1, s) for s in scores], "y int, p double")
    got = {r.step: r.tp for r in ev.threshold_sweep(df, "y", "p").collect()}
    assert [got[i] for i in range(80)] == [sum(s >= t for s in scores) for t in grid]


def test_scores_close_to_the_threshold_count_as_they_are(spark):
    """Scores that differ in the fifth decimal stay apart, in the counts and in the areas."""
    df = spark.createDataFrame([(0, 0.44996), (1, 0.449961), (1, 0.46), (0, 0.2)], "y int, p double")
    m = ev.evaluate(df, "y", "p", 0.45).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (1, 0, 1, 2) and m.roc_auc == pytest.approx(1.0)


def test_areas(spark, sample):
    df = spark.createDataFrame(sample).withColumn("p", F.col("p").cast("double"))
    exact = ev.evaluate(df, "y", "p", 0.5).first()
    judge = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", metricName="areaUnderROC", numBins=0)
    assert exact.roc_auc == pytest.approx(judge.evaluate(df), abs=1e-9)
    assert exact.tp + exact.fp + exact.fn + exact.tn == len(sample)
    order = sample.sort_values("p", ascending=False)
    step, last, tp, n = 0.0, 0.0, 0, 0
    for _, g in order.groupby("p", sort=False):
        tp, n = tp + g.y.sum(), n + len(g)
        recall = tp / sample.y.sum()
        step, last = step + (recall - last) * tp / n, recall
    assert exact.pr_auc == pytest.approx(step)


@pytest.mark.parametrize("scores", [[0.5] * 6, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]])
def test_areas_degenerate(spark, scores):
    df = spark.createDataFrame(list(zip([0, 1, 0, 1, 0, 1], scores, strict=True)), "y int, p double")
    m = ev.evaluate(df, "y", "p", 0.5).first()
    assert m.roc_auc == pytest.approx(0.5 if len(set(scores)) == 1 else 6 / 9)


def test_cramers_in_range(spark, sf):
    m = a.cramers_matrix(bookings(spark, sf, "vehicle_type", "drop_location", "is_cancelled"), ["vehicle_type", "drop_location", "is_cancelled"])
    got = {(r.feature_a, r.feature_b): r.cramers_v for r in m.collect()}
    assert len(got) == 9 and all(0 <= v <= 1 for v in got.values())
    assert all(got[x, y] == got[y, x] for x, y in got)
