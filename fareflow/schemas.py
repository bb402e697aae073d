"""Fixed table layouts and the contract check used at layer boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Raw file layout (header names as delivered).
RAW_BOOKINGS = T.StructType([
    T.StructField("Date", T.StringType()),
    T.StructField("Time", T.StringType()),
    T.StructField("Booking ID", T.StringType()),
    T.StructField("Booking Status", T.StringType()),
    T.StructField("Customer ID", T.StringType()),
    T.StructField("Vehicle Type", T.StringType()),
    T.StructField("Pickup Location", T.StringType()),
    T.StructField("Drop Location", T.StringType()),
    T.StructField("Avg VTAT", T.DoubleType()),
    T.StructField("Avg CTAT", T.DoubleType()),
    T.StructField("Cancelled Rides by Customer", T.DoubleType()),
    T.StructField("Reason for cancelling by Customer", T.StringType()),
    T.StructField("Cancelled Rides by Driver", T.DoubleType()),
    T.StructField("Driver Cancellation Reason", T.StringType()),
    T.StructField("Incomplete Rides", T.DoubleType()),
    T.StructField("Incomplete Rides Reason", T.StringType()),
    T.StructField("Booking Value", T.DoubleType()),
    T.StructField("Ride Distance", T.DoubleType()),
    T.StructField("Driver Ratings", T.DoubleType()),
    T.StructField("Customer Rating", T.DoubleType()),
    T.StructField("Payment Method", T.StringType()),
])

CLEAN_BOOKINGS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("time", T.StringType()),
    T.StructField("booking_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("vehicle_type", T.StringType()),
    T.StructField("pickup_location", T.StringType()),
    T.StructField("drop_location", T.StringType()),
    T.StructField("avg_vtat", T.DoubleType()),
    T.StructField("avg_ctat", T.DoubleType()),
    T.StructField("booking_value", T.DoubleType()),
    T.StructField("ride_distance", T.DoubleType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("is_cancelled", T.IntegerType()),
])

# Target mapping of the booking status.
STATUS_TARGET = {
    "Completed": 0,
    "Incomplete": 0,
    "Cancelled by Driver": 1,
    "Cancelled by Customer": 1,
    "No Driver Found": 1,
}

# Columns that are only known after the ride.
LEAKAGE_COLUMNS = [
    "cancelled_rides_by_customer",
    "reason_for_cancelling_by_customer",
    "cancelled_rides_by_driver",
    "driver_cancellation_reason",
    "incomplete_rides",
    "incomplete_rides_reason",
    "driver_ratings",
    "customer_rating",
]
LATE_LEAKAGE_COLUMNS = ["avg_ctat", "booking_value", "ride_distance", "payment_method"]

# Model features in order.
FEATURES = [
    "avg_vtat_imputed", "vtat_bucket", "is_high_vtat",
    "pickup_encoded", "drop_encoded",
    "vehicle_type_encoded",
    "hour", "dayofweek", "month", "is_weekend", "is_peak_hour", "is_late_night",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos",
]
TARGET = "is_cancelled"


def check_contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fail early when names or types differ; returns the columns in contract order."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    problems = [
        f"{f.name}: expected {f.dataType.simpleString()}, found "
        f"{actual[f.name].simpleString() if f.name in actual else 'nothing'}"
        for f in schema.fields if actual.get(f.name) != f.dataType
    ]
    if problems:
        raise ValueError("schema contract broken: " + "; ".join(problems))
    return df.select(*[f.name for f in schema.fields])
