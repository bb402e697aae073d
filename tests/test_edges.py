"""Hand-written edge frames for null handling, bin borders and degenerate tables."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from fareflow.functions.columns import binned, booking_timestamp, equal_width_bin
from fareflow.operators import association as a
from fareflow.operators import cleaning, counts, duplicates, profile, series
from fareflow.operators import evaluation as ev
from fareflow.operators import features as ft
from fareflow.plans.chain import BookingFeatures
from fareflow.schemas import CLEAN_BOOKINGS, RAW_BOOKINGS, check_contract
from fareflow.sources.tables import bookings

VTAT = [None, 0.0, 0.1, 2.9, 2.95, 5.0, 5.1, 10.0, 11.9, 15.0, 15.1, 20.0, 20.1]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_vtat_bucket_borders(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VTAT)], "i int, x double").withColumns(ft.vtat_buckets(F.col("x")))
    got = rows(df.orderBy("i"), "vtat_bucket", "is_high_vtat")
    assert got == [(None, 0), (None, 0), (0.0, 0), (0.0, 0), (0.0, 0), (0.0, 0), (1.0, 0), (1.0, 0), (2.0, 0), (2.0, 1),
                   (3.0, 1), (3.0, 1), (None, 1)]


def test_vtat_zone_borders_and_flags(spark):
    df = ft.add_vtat_zone(spark.createDataFrame([(i, v) for i, v in enumerate(VTAT)], "i int, avg_vtat double")).orderBy("i")
    assert [r[0] for r in rows(df, "vtat_zone")] == [
        None, "instant", "instant", "instant", "short", "short", "normal", "normal", "normal", "dip", "timeout", "timeout", None]
    # an unknown comparison is 0; 15.0 is not a timeout
    assert [r[0] for r in rows(df, "is_timeout")] == [0] * 10 + [1, 1, 1]
    assert [r[0] for r in rows(df, "is_long_wait")] == [0] * 9 + [1] * 4
    assert [r[0] for r in rows(df, "is_instant_arrival")] == [0, 1, 1, 1] + [0] * 9


def test_named_zone_gaps(spark):
    df = spark.createDataFrame([(2.95,), (1.9,), (3.0,), (20.0,)], "avg_vtat double").select(ft.named_zone().alias("z"))
    assert [r.z for r in df.collect()] == [None, None, "Low", "Guaranteed-cancel"]


def test_binned_lowest(spark):
    df = spark.createDataFrame([(0.0,)], "x double")
    assert df.select(binned("x", [0, 1], ["a"])).first()[0] is None
    assert df.select(binned("x", [0, 1], ["a"], include_lowest=True)).first()[0] == "a"


def test_histogram_top_edge(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.1,), (None,)], "x double")
    assert [r[0] for r in df.select(equal_width_bin("x", 0, 10, 5)).collect()] == [0, 4, None, None]


def test_timestamp_parsing(spark):
    df = spark.createDataFrame(
        [(date(2024, 2, 29), "23:59:59"), (date(2024, 1, 1), "24:00:00"), (date(2024, 1, 1), "7:5:1"), (None, "01:00:00"),
         (date(2024, 1, 1), None)], "date date, time string")
    out = [r[0] for r in df.select(booking_timestamp().cast("string")).collect()]
    assert out == ["2024-02-29 23:59:59", None, None, None, None]
    t = ft.add_temporal(df)
    assert rows(t, "hour", "dayofweek", "month", "day")[0] == (23, 3, 2, 29)
    assert rows(t, "hour", "dayofweek", "month", "day", "is_weekend", "hour_sin")[1:] == [(None, None, None, None, 0, None)] * 4


def test_temporal_windows(spark):
    df = spark.createDataFrame([(date(2024, 1, 6), f"{h:02d}:00:00") for h in range(24)], "date date, time string")
    t = ft.add_hour_flags(ft.add_temporal(df)).orderBy("hour")
    on = lambda c: [h for h, v in rows(t, "hour", c) if v]
    assert on("is_morning_rush") == [7, 8, 9, 10] and on("is_evening_rush") == [17, 18, 19, 20, 21]
    assert on("is_late_night") == [0, 1, 2, 3, 4, 5, 23]
    assert on("is_night") == [0, 1, 2, 3, 4, 5, 22, 23]
    assert on("is_business") == list(range(9, 18)) and on("is_rush") == [7, 8, 9, 17, 18, 19]
    assert on("is_weekend") == list(range(24))


def test_status_outside_mapping(spark):
    df = spark.createDataFrame([("Completed",), ("No Driver Found",), ("Other",), (None,)], "booking_status string")
    assert rows(cleaning.map_target(df), "is_cancelled") == [(0,), (1,), (None,), (None,)]


def test_snake_case(spark):
    df = spark.createDataFrame([(1, 2, 3)], [" Booking ID", "Avg-VTAT (min)", "Driver  Ratings"])
    assert cleaning.snake_case_names(df).columns == ["booking_id", "avg_vtat_min", "driver_ratings"]


def test_clean_raw_row(spark):
    values = ["2024-13-01", "10:00:00", '"CNR1"', "Completed", '"CID2"', "Auto", "A", "B", 2.9000001, float("nan")] + [None] * 11
    raw = spark.createDataFrame([tuple(values)], RAW_BOOKINGS)
    row = cleaning.clean(raw).first()
    assert (row.date, row.booking_id, row.customer_id, row.avg_vtat, row.avg_ctat, row.is_cancelled) == (None, "CNR1", "CID2", 2.9, None, 0)


def test_contract_breaks(spark):
    with pytest.raises(ValueError, match="avg_vtat"):
        check_contract(spark.createDataFrame([("x",)], "avg_vtat string"), CLEAN_BOOKINGS)


def test_null_keys_and_targets(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1), ("b", None)], "k string, is_cancelled int")
    assert sorted(rows(counts.group_rate(df, ["k"]), "k", "cancelled", "total", "cancel_rate")) == [
        ("a", 1, 1, 1.0), ("b", 0, 0, None)]
    assert counts.value_counts(df, "k").count() == 2 and counts.value_counts(df, "k", keep_null=True).count() == 3


def test_duplicates_treat_null_as_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("b", 4), ("b", 5), ("b", 6)], "k string, v int")
    assert sorted(r.v for r in duplicates.duplicated_rows(df, ["k"]).collect()) == [1, 2, 4, 5, 6]
    assert sorted(r.v for r in duplicates.duplicated_rows(df, ["k"], times=3).collect()) == [4, 5, 6]
    assert duplicates.duplicate_count(df, ["k"]).first()[0] == 3
    flagged = duplicates.with_key_multiplicity(df, ["k"])
    assert {r.v: (r.n_rows, r.is_duplicated) for r in flagged.collect()} == {
        1: (2, 1), 2: (2, 1), 3: (1, 0), 4: (3, 1), 5: (3, 1), 6: (3, 1)}


def test_hot_key_is_whole(spark):
    """A key with a third of the rows, and copies of one row, come back complete."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("v"))
    kept = duplicates.duplicated_rows(df, ["k"])
    assert kept.count() == 3000 and kept.select("k").distinct().count() == 1
    assert duplicates.with_key_multiplicity(df, ["k"]).count() == 9000


def test_id_parts(spark):
    df = duplicates.id_parts(spark.createDataFrame([("CNR12",), ("99",), (None,)], "id string"), "id")
    assert rows(df, "id_length", "letters", "digits") == [(5, "CNR", "12"), (2, None, None), (None, None, None)]


def test_missing_days(spark):
    df = spark.createDataFrame([(date(2024, 12, 29),), (date(2024, 12, 30),), (None,)], "date date")
    assert rows(series.missing_days(df, "2024-12-29", "2024-12-31"), "date") == [(date(2024, 12, 31),)]


def test_rolling_needs_full_window(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)], "i int, v double")
    odd = rows(series.rolling_series(df, "i", "v", (3, 4)).orderBy("i"), "rolling_3", "rolling_4")
    assert [r[0] for r in odd] == [None, 1, 2, 3, 4, 5, 6, 7, None]
    assert [r[1] for r in odd] == [None, None, 1.5, 2.5, 3.5, 4.5, 5.5, 6.5, None]


def test_two_by_two_zero_cell(spark):
    df = spark.createDataFrame([(1, 0)] * 3 + [(0, 1)] * 2 + [(0, 0)] * 4, "f int, is_cancelled int")
    r = a.binary_vs_binary(df, ["f"], p_value=True).first()
    assert (r.odds_ratio, r.ci_low, r.ci_high) == (0.0, None, None) and r.phi < 0
    flipped = df.select((1 - F.col("f")).alias("f"), "is_cancelled")
    assert math.isinf(a.binary_vs_binary(flipped, ["f"]).first().odds_ratio)


def test_one_level_category(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1)], "k string, is_cancelled int")
    assert a.cramers_v(df, "k", "is_cancelled").first().cramers_v == 0.0


def test_constant_column(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "x double, is_cancelled int")
    assert a.target_correlations(df, ["x"]).first().correlation is None
    s = profile.column_stats(df, ["x"]).first()
    assert s.variance == 0.0 and s.skew is None and s.kurtosis is None


def test_single_class_metrics(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.9)], "y int, p double")
    m = ev.evaluate(df, "y", "p", 0.5).first()
    assert (m.precision, m.recall, m.f2, m.f1) == (0.0, 0.0, 0.0, 0.0)
    best = ev.best_threshold(ev.threshold_sweep(df, "y", "p")).first()
    assert (best.best_threshold, best.best_f_beta) == (0.5, 0.0)


def _clean(spark, data):
    return spark.createDataFrame(data, "date date, time string, vehicle_type string, pickup_location string, "
                                       "drop_location string, avg_vtat double, is_cancelled int")


def test_chain_unseen_and_null(spark):
    d = date(2024, 1, 1)
    train = _clean(spark, [(d, "08:00:00", "Auto", "P", "D", 4.0, 0), (d, "08:00:00", "Auto", "P", "D", 8.0, 1),
                           (d, "08:00:00", "Bike", "Q", None, None, 1), (d, "08:00:00", None, None, "D", 12.0, 0)])
    model = BookingFeatures().fit(train)
    new = _clean(spark, [(d, "08:00:00", "Auto", "P", "D", None, 0), (d, "08:00:00", "Bike", "Z", "Z", None, 0),
                         (d, "08:00:00", "Jet", None, None, None, 0), (d, "08:00:00", None, "P", "D", None, 0)])
    out = model.transform(new).select("vehicle_type", "avg_vtat_imputed", "vehicle_type_encoded", "pickup_encoded", "drop_encoded")
    got = {r.vehicle_type: r for r in out.collect()}
    # vehicle median, overall median for a vehicle without one, for an unseen one and for NULL
    assert [got[v].avg_vtat_imputed for v in ("Auto", "Bike", "Jet", None)] == [6.0, 8.0, 8.0, 8.0]
    assert [got[v].vehicle_type_encoded for v in ("Auto", "Bike", "Jet", None)] == [0, 1, -1, 2]
    known, other = (1 + 10 * 0.5) / 12, (0 + 10 * 0.5) / 11
    assert got["Auto"].pickup_encoded == pytest.approx(known)
    assert got["Bike"].pickup_encoded == pytest.approx(other) == got["Jet"].pickup_encoded
    # 'Other' of drop was seen once in training, as NULL
    assert got["Bike"].drop_encoded == pytest.approx((1 + 10 * 0.5) / 11)


def test_top_n_ties_by_name(spark):
    df = spark.createDataFrame([(k,) for k in "ccbbaad"], "key string").groupBy("key").agg(F.count("*").alias("n_rows"))
    assert sorted(r.key for r in ft.top_locations(df, 2).collect()) == ["a", "b"]


def test_global_mean_when_no_other(spark):
    """Nothing was grouped in training: an unseen location takes the overall mean."""
    d = date(2024, 1, 1)
    train = _clean(spark, [(d, "08:00:00", "Auto", "P", "D", 4.0, 0), (d, "08:00:00", "Auto", "P", "D", 8.0, 1), (d, "08:00:00", "Auto", "P", "D", 8.0, 1)])
    out = BookingFeatures().fit(train).transform(_clean(spark, [(d, "08:00:00", "Auto", "new", "D", 1.0, 0)])).first()
    assert out.pickup_encoded == pytest.approx(2 / 3)


def test_temporal_split_edges(spark):
    df = spark.createDataFrame([(date(2024, 9, 30),), (date(2024, 10, 1),), (date(2024, 11, 30),), (date(2024, 12, 1),), (None,)], "date date")
    assert [r[0] for r in df.select(counts.temporal_split("date")).collect()] == ["train", "val", "val", "test", None]


def test_pivot_counts_values_outside_the_list(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("a", None, 1), ("a", "z", 1)], "r string, c string, is_cancelled int")
    row = a.pivot_rates(df, "r", "c", ["x", "y"]).first()
    assert (row.x, row.y, row.n_unlisted) == (1.0, 0.0, 2)


def test_a_row_without_a_date_has_no_split(spark, tmp_path):
    spark.sql("select cast(null as timestamp) l_shipdate, 'R' l_returnflag union all select timestamp '1999-01-01', 'A'").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    assert {r.split for r in bookings(spark, str(tmp_path), "split").collect()} == {None, "train"}
