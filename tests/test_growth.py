"""Plans and figures that must not grow faster than the input."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from fareflow.operators import counts
from fareflow.operators import features as ft
from fareflow.operators import rank_stats
from fareflow.plans import reports as rp
from fareflow.sources.tables import bookings


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hourly_builds_each_time_once(spark, sf):
    """The null-hour filter is not pushed below the parsing, where the time text was built again for each mention."""
    plan = optimized(rp.hourly(ft.add_temporal(bookings(spark, sf, "date", "time", "is_cancelled"))))
    assert plan.count("lpad(") == 3


def test_group_rate_drops_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", None), (None, "a", 1), (2, None, 1), (None, None, 0), (2, "b", None)],
                               "k int, g string, is_cancelled int")
    assert sorted(map(tuple, counts.group_rate(df, ["k", "g"]).collect())) == [(1, "a", 1, 1, 1.0), (2, "b", 0, 0, None)]
    assert sorted(map(tuple, counts.group_rate(df, ["k"]).collect())) == [(1, 1, 1, 1.0), (2, 1, 1, 1.0)]


def test_hourly_rows_with_bad_times(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), "07:10:00", 1), (date(2024, 1, 1), "07:59:59", 0), (None, "08:00:00", 1),
                                (date(2024, 1, 1), "24:00:00", 1), (date(2024, 1, 1), None, 1)],
                               "date date, time string, is_cancelled int")
    assert [tuple(r) for r in rp.hourly(ft.add_temporal(df)).collect()] == [(7, 2, 50.0)]


def test_logistic_fits_on_collapsed_rows(spark, monkeypatch):
    """Equal rows are fitted once, with the result of Spark's scaler and regression on every row."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from fareflow.plans import models as m

    df = spark.range(3000).select(
        (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), F.lit(2.0).alias("c"),
        ((F.col("id") * 7 % 11) < 3 + F.col("id") % 5).cast("int").alias("is_cancelled"))
    features, fitted = ["a", "b", "c"], []
    stage = m.balanced_weights
    monkeypatch.setattr(m, "balanced_weights", lambda *p, **k: fitted.append(p[0]) or stage(*p, **k))
    got = m.fit_logistic(df, features).stages[-1]
    assert fitted[0].count() <= 30
    plain = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw_features"),
                             StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
                             m.logistic_stage(3000)]).fit(stage(df))
    assert got.coefficients.toArray() == pytest.approx(plain.stages[-1].coefficients.toArray(), abs=1e-5)  # both stop at 1e-6
    assert got.intercept == pytest.approx(plain.stages[-1].intercept, abs=1e-5)  # both stop at 1e-6


def test_feature_mi_reads_the_rows_once(spark, tmp_path):
    """Spans and bins come from one table of value counts, with the figures of the two-pass form."""
    df = spark.range(900).select(
        F.when(F.col("id") % 10 != 0, F.col("id") % 37 / 10.0).alias("a"), (F.col("id") % 7).cast("int").alias("b"),
        F.lit(None).cast("double").alias("c"),
        F.when(F.col("id") % 11 != 0, (F.col("id") % 3 == 0).cast("int")).alias("is_cancelled"))
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert "parquet" in optimized(df)
    assert "parquet" not in optimized(rp.feature_mi(df, ["a", "b"]))
    two = {r[0]: r[1] for r in rank_stats.binned_mutual_information(df, ["a", "b", "c"]).collect()}
    one = {r[0]: r[1] for r in rank_stats.binned_mutual_information(df, ["a", "b", "c"], few_values=True).collect()}
    assert set(one) == {"a", "b"} and one == pytest.approx(two, abs=1e-12)


@pytest.mark.parametrize("subsample", [1.0, 0.7])
def test_stopped_boosting_grows_no_needless_rounds(spark, monkeypatch, subsample):
    """A fit that stops among its first rounds is the one cut from all rounds; one that does not is grown in full."""
    from fareflow.plans import boosting
    from fareflow.plans import models as m

    h = F.abs(F.hash("id", F.lit(1))) % 1000
    df = spark.range(1500).select((F.abs(F.hash("id", F.lit(2))) % 100 / 100.0).alias("a"),
                                  (F.abs(F.hash("id", F.lit(3))) % 6).cast("double").alias("b"), "id", h.alias("h"))
    df = df.withColumn("is_cancelled", (F.col("h") < 200 + 400 * (F.col("a") > 0.6).cast("int")).cast("int"))
    train, val, features = df.where("id < 1000"), df.where("id >= 1000"), ["a", "b"]
    more = {"depth": 3, "subsample": subsample, "seed": 7}
    whole = m.fit_boosting(train, features=features, rounds=30, **more)
    cut, _, keep = boosting.early_stopped(whole, val, "pr_area", 3, features)
    grown, fit = [], m.fit_boosting
    monkeypatch.setattr(m, "fit_boosting", lambda *p, **k: grown.append(k["rounds"]) or fit(*p, **k))
    for first in (keep + 3, keep + 2):
        grown.clear()
        got = m.fit_stopped(train, val, "pr_area", features, 30, first, 3, **more)
        assert grown == ([first] if first == keep + 3 else [first, 30])
        assert got.stages[-1].toDebugString.split("\n")[1:] == cut.stages[-1].toDebugString.split("\n")[1:]
