"""Bookings, scored rows and time-of-day rows read from the star-schema test tables.

``bookings`` joins only the tables that the asked columns need: lineitem alone serves most operators,
so their plans have no join at all. Every lineitem row has exactly one order and one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fareflow.operators.counts import temporal_split

TRAIN_END = "2000-02-29"
VAL_END = "2000-12-31"
STATUS_MAP = {"R": 1, "A": 0, "N": 0}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _date() -> Column:
    return F.to_date("l_shipdate")


def _cancelled() -> Column:
    return F.when(F.col("l_returnflag") == "R", 1).otherwise(0)


def _seconds() -> Column:
    """Derived time of day; the data has none."""
    return (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729 + F.col("l_partkey") * 31) % 86400


def _time() -> Column:
    s = _seconds()
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor((s % 3600) / 60)), F.lit(":"), two(s % 60))


def _score(a: int, b: int, lift: int) -> Column:
    """Deterministic score in [0, 1) on a 0.01 grid that leans towards the positive class."""
    base = (F.col("l_orderkey") * a + F.col("l_linenumber") * b) % 100
    return F.round((base + lift * _cancelled()) / F.lit(100.0 + lift), 2)


def _split() -> Column:
    return temporal_split(_date(), TRAIN_END, VAL_END)


FROM_LINEITEM = {
    "booking_id": lambda: F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")),
    "date": _date,
    "time": _time,
    "pickup_location": lambda: F.col("l_suppkey").cast("string"),
    "avg_vtat": lambda: F.when(F.col("l_discount") != 0.0, F.round(F.col("l_quantity") * 2 / 5, 1)),
    "avg_ctat": lambda: F.when(F.col("l_returnflag") != "R", F.col("l_tax") * 100),
    "booking_value": lambda: F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")),
    "ride_distance": lambda: F.when(F.col("l_returnflag") != "R", F.col("l_quantity")),
    "payment_method": lambda: F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")),
    "status": lambda: F.col("l_returnflag"),
    "is_cancelled": _cancelled,
    "split": _split,
    "score": lambda: _score(7, 13, 30),
    "score_b": lambda: _score(11, 17, 15),
    "score_c": lambda: _score(3, 29, 10),
    "y": _cancelled,
}
FROM_ORDERS = {"customer_id": lambda: F.col("o_custkey").cast("string"),
               "vehicle_type": lambda: F.col("o_orderpriority")}
FROM_PART = {"drop_location": lambda: F.col("p_brand")}
BOOKING_COLUMNS = ["date", "time", "booking_id", "customer_id", "vehicle_type", "pickup_location",
                   "drop_location", "avg_vtat", "is_cancelled"]


def bookings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    wanted = list(columns) or BOOKING_COLUMNS
    df = table(spark, sf_dir, "lineitem")
    if any(c in FROM_ORDERS for c in wanted):
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        df = df.join(orders, df["l_orderkey"] == orders["o_orderkey"])
    if any(c in FROM_PART for c in wanted):
        part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
        df = df.join(part, df["l_partkey"] == part["p_partkey"])
    rules = FROM_LINEITEM | FROM_ORDERS | FROM_PART
    return df.select(*[rules[c]().alias(c) for c in wanted])


def raw_bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 21-column raw layout, with quoted ids, built from the tables."""
    df = bookings(spark, sf_dir, "date", "time", "booking_id", "status", "customer_id", "vehicle_type",
                  "pickup_location", "drop_location", "avg_vtat", "avg_ctat", "booking_value",
                  "ride_distance", "payment_method", "is_cancelled")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    cancelled = F.col("is_cancelled") == 1
    flag = F.when(cancelled, F.lit(1.0))
    reason = F.when(cancelled, F.lit("reason"))
    return df.select(
        F.date_format("date", "yyyy-MM-dd").alias("Date"), F.col("time").alias("Time"),
        quoted("booking_id").alias("Booking ID"), F.col("status").alias("Booking Status"),
        quoted("customer_id").alias("Customer ID"), F.col("vehicle_type").alias("Vehicle Type"),
        F.col("pickup_location").alias("Pickup Location"), F.col("drop_location").alias("Drop Location"),
        F.col("avg_vtat").alias("Avg VTAT"), F.col("avg_ctat").alias("Avg CTAT"),
        flag.alias("Cancelled Rides by Customer"), reason.alias("Reason for cancelling by Customer"),
        flag.alias("Cancelled Rides by Driver"), reason.alias("Driver Cancellation Reason"),
        flag.alias("Incomplete Rides"), reason.alias("Incomplete Rides Reason"),
        F.col("booking_value").alias("Booking Value"), F.col("ride_distance").alias("Ride Distance"),
        F.lit(None).cast("double").alias("Driver Ratings"), F.lit(None).cast("double").alias("Customer Rating"),
        F.col("payment_method").alias("Payment Method"),
    )


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a real time of day: error events play the cancelled bookings."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", F.to_date("ts").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"),
        (F.col("user_id") % 7).cast("string").alias("category"), "value",
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_cancelled"),
    )
