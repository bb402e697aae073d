"""Files, the fitted chain, models, streaming and the shape of the plans."""

import pytest
from pyspark.sql import functions as F

from fareflow.catalog import all_queries
from fareflow.catalog.features import CHAIN_INPUT, chain_features
from fareflow.operators import cleaning
from fareflow.plans import chain, models, reports
from fareflow.plans.chain import BookingFeaturesModel, residual_nulls, silver, train_val
from fareflow.schemas import FEATURES, TARGET
from fareflow.sources import files
from fareflow.sources.tables import STATUS_MAP, TRAIN_END, VAL_END, bookings, raw_bookings
from fareflow.streaming.jobs import needs_retrain, score_stream

KEY = ["booking_id", "date", "time"]


def test_csv_to_clean_round_trip(spark, sf, tmp_path):
    raw = raw_bookings(spark, sf)
    raw.write.option("quote", '"').option("escape", '"').csv(str(tmp_path / "raw"), header=True)
    back = files.read_raw_csv(spark, str(tmp_path / "raw"))
    assert len(back.columns) == 21
    assert back.select("Booking ID").first()[0].startswith('"')
    files.write_clean(cleaning.clean(back, STATUS_MAP), str(tmp_path / "clean"))
    clean = files.read_table(spark, str(tmp_path / "clean"))
    assert clean.exceptAll(cleaning.clean(raw, STATUS_MAP)).count() == 0 and clean.count() == raw.count()


def test_split_table_prunes(spark, sf, tmp_path):
    df = bookings(spark, sf, "date", "is_cancelled", "split")
    files.write_by_split(df, str(tmp_path / "s"))
    back = files.read_table(spark, str(tmp_path / "s"))
    assert back.count() == df.count()
    train = back.where("split = 'train'")
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().executedPlan().toString()
    assert train.count() == df.where("split = 'train'").count()


@pytest.fixture(scope="module")
def fitted(spark, sf):
    return chain_features(spark, sf)


def test_chain_columns(fitted):
    s = silver(fitted[0], "booking_id")
    assert s.columns == ["booking_id", *FEATURES, TARGET, "split"]


def test_no_leak_from_val_and_test(spark, sf, fitted):
    df = bookings(spark, sf, *CHAIN_INPUT)
    after = F.col("date") > F.lit(TRAIN_END).cast("date")
    bent = df.withColumns({"avg_vtat": F.when(after, 19.9).otherwise(F.col("avg_vtat")),
                           "is_cancelled": F.when(after, 1).otherwise(F.col("is_cancelled")),
                           "pickup_location": F.when(after, F.lit("1")).otherwise(F.col("pickup_location"))})
    _, other = chain.run_chain(bent, TRAIN_END, VAL_END)
    assert other.state.exceptAll(fitted[1].state).count() == 0 == fitted[1].state.exceptAll(other.state).count()


def test_state_is_small_and_reloads(spark, sf, fitted, tmp_path):
    features, model = fitted
    assert model.state.where("artifact = 'pickup_encoding'").count() <= 12
    model.save(str(tmp_path / "state"))
    again = BookingFeaturesModel.load(spark, str(tmp_path / "state"))
    df = bookings(spark, sf, *CHAIN_INPUT).withColumn("split", F.lit("x"))
    a, b = silver(model.transform(df), *KEY), silver(again.transform(df), *KEY)
    assert a.exceptAll(b).count() == 0 and a.count() == df.count()
    assert model.top_locations("pickup").count() == 10


def test_shuffled_lookup_gives_the_same(spark, sf, fitted):
    """Over the broadcast limit the same joins run by shuffle."""
    df = bookings(spark, sf, *CHAIN_INPUT).withColumn("split", F.lit("x"))
    big = BookingFeaturesModel(fitted[1].state)
    big._broadcast = False
    assert silver(big.transform(df), *KEY).exceptAll(silver(fitted[1].transform(df), *KEY)).count() == 0


def test_splits_partition_the_input(spark, sf, fitted):
    n = {r.split: r["count"] for r in fitted[0].groupBy("split").count().collect()}
    assert set(n) == {"train", "val", "test"} and sum(n.values()) == bookings(spark, sf, "date").count()
    assert train_val(fitted[0]).count() == n["train"] + n["val"]
    assert residual_nulls(fitted[0]).count() == len(FEATURES)


@pytest.fixture(scope="module")
def signal(spark):
    """Planted signal: waiting time above 12 cancels, with a few flips."""
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("booking_id"),
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(100)) / 5.0).alias(c) for i, c in enumerate(FEATURES)])
    flip = F.pmod(F.xxhash64("booking_id", F.lit(99)), F.lit(20)) == 0
    y = (F.col("avg_vtat_imputed") > 12).cast("int")
    part = F.pmod(F.col("booking_id").cast("int"), F.lit(5))
    return df.withColumns({TARGET: F.when(flip, 1 - y).otherwise(y),
                           "split": F.when(part < 3, "train").when(part == 3, "val").otherwise("test")}).cache()


FITS = {
    "logistic": lambda t, v: models.fit_logistic(t, max_iter=50),
    "forest": lambda t, v: models.fit_forest(t, trees=10, depth=5),
    "boosting": lambda t, v: models.fit_boosting(t, v, rounds=8, depth=3),
}


@pytest.mark.parametrize("kind", sorted(FITS))
def test_models_beat_the_dummy(spark, signal, kind, tmp_path):
    train, val = signal.where("split = 'train'"), signal.where("split = 'val'")
    model = FITS[kind](train, val)
    rows = {r.split: r for r in models.tuned_evaluation(model, signal, kind).collect()}
    assert rows["test"].f2 > 0.8 and rows["val"].roc_auc > 0.85
    top = models.importances(spark, model, kind, top=10)
    assert top.where("rank_order = 1").first().feature == "avg_vtat_imputed" and top.count() == 10
    again = models.score(FITS[kind](train, val), val).agg(F.sum(models.PROB)).first()[0]
    assert again == pytest.approx(models.score(model, val).agg(F.sum(models.PROB)).first()[0], rel=1e-9)
    metrics = models.tuned_evaluation(model, signal, kind, ("test",))
    models.save_artifact(model, metrics, str(tmp_path / kind))
    loaded, table = models.load_artifact(spark, str(tmp_path / kind))
    assert table.first().feature_names == FEATURES
    assert models.score(loaded, val).agg(F.sum(models.PROB)).first()[0] == pytest.approx(again, rel=1e-9)


def test_cross_validation_and_grid(spark, signal):
    cv = models.cross_validate(signal, ["booking_id"], 0.45, folds=3, max_iter=15)
    got = {r.metric: r for r in cv.collect()}
    assert set(got) == {"f2", "f1", "precision", "recall", "roc_auc"} and got["roc_auc"].mean > 0.8
    results, best = models.grid_search(signal, ["booking_id"], cs=(0.001, 1), folds=2, max_iter=15)
    assert results.count() == 4 and results.where("rank = 1").count() >= 1 and best is not None


def test_folds_are_stratified(signal):
    folded = models.stratified_folds(signal, ["booking_id"])
    sizes = {}
    for row in folded.groupBy(TARGET, "fold").count().collect():
        sizes.setdefault(row[TARGET], []).append(row["count"])
    assert all(len(n) == 5 and max(n) - min(n) <= 1 for n in sizes.values())
    assert sum(map(sum, sizes.values())) == signal.count() and set(folded.columns) == {*signal.columns, "fold"}


def test_reports_are_complete(spark, sf, fitted, tmp_path):
    from fareflow.catalog.evaluations import confusion_days, model_scores
    from fareflow.catalog.evaluations import test_metrics as metrics_of
    imp = spark.createDataFrame([("alpha", "hour", 0.1, 1)], "model_name string, feature string, importance double, rank_order int")
    tables = reports.data_reports(fitted[0]) | reports.model_reports(
        metrics_of(spark, sf), model_scores(spark, sf), imp, *confusion_days(spark, sf), "alpha", "y", "p")
    assert len(tables) == 17
    files.write_reports(tables, str(tmp_path))
    assert all(df.count() for df in files.read_reports(spark, str(tmp_path), list(tables)).values())


def test_streaming_scores_equal_batch(spark, sf, fitted, signal, tmp_path):
    model = FITS["logistic"](signal.where("split = 'train'"), None)
    source = bookings(spark, sf, *CHAIN_INPUT).withColumn("split", F.lit("live")).where("avg_vtat is not null")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    scored = score_stream(stream, fitted[1].transform, lambda df: models.score(model, silver(df, *KEY)))
    q = (scored.select(*KEY, models.PROB).writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    q.awaitTermination()
    live = spark.read.parquet(str(tmp_path / "out"))
    batch = models.score(model, silver(fitted[1].transform(source), *KEY))
    assert live.count() == batch.count()
    assert live.agg(F.sum(models.PROB)).first()[0] == pytest.approx(batch.agg(F.sum(models.PROB)).first()[0], rel=1e-9)


def test_retrain_rule(spark):
    df = spark.createDataFrame([(0.7, 0.9), (0.67, 0.9), (0.7, 0.8)], "f2 double, recall double")
    assert [r[0] for r in df.select(needs_retrain("f2", "recall")).collect()] == [0, 1, 1]


# -- plans ---------------------------------------------------------------------------------------------

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


NO_PYTHON = ["ingest_clean", "feat_temporal", "feat_chain", "eval_metrics", "eval_threshold_sweep", "assoc_nominal", "assoc_cramers_matrix",
             "dup_rows", "report_dataset_overview", "profile_columns", "pivot_spread"]


@pytest.mark.parametrize("name", NO_PYTHON)
def test_plans_stay_in_the_jvm(spark, sf, name):
    plan = plan_of(all_queries()[name](spark, sf))
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_lineitem_operators_have_no_join(spark, sf):
    plan = plan_of(bookings(spark, sf, "date", "avg_vtat", "is_cancelled"))
    assert "Join" not in plan and "l_partkey" not in plan and "l_comment" not in plan


def test_hot_rows_are_not_shuffled(spark, sf):
    plan = plan_of(all_queries()["dup_rows"](spark, sf))
    assert "BroadcastHashJoin" in plan and "Union" in plan
