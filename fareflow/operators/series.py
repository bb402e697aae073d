"""Time series: daily and per-minute rates, rolling means, calendar gaps.

The windows below order whole series without a partition key. They run on grouped rows only: one per
calendar day, or at most 1,440 per day of minutes, whatever the size of the bookings table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fareflow.functions.columns import equal_width_bin, minute_of_day, ratio
from fareflow.operators.counts import group_rate
from fareflow.scale import totals_of


def centred_mean(value: str, order: str, width: int) -> Column:
    """Rolling mean over ``width`` rows around the row; NULL until the window is full."""
    ahead = (width - 1) // 2
    w = Window.orderBy(order).rowsBetween(ahead - width + 1, ahead)
    return F.when(F.count(value).over(w) == width, F.avg(value).over(w))


def rolling_series(series: DataFrame, order: str, value: str, windows: tuple[int, ...]) -> DataFrame:
    """The series with rolling means and the overall mean of the plotted value."""
    overall = totals_of(series, mean=F.avg(value))["mean"]
    return series.withColumns(
        {f"rolling_{w}": centred_mean(value, order, w) for w in windows} | {"overall_mean": overall}
    )


def daily_rates(df: DataFrame, date: str = "date", target: str = "is_cancelled") -> DataFrame:
    return group_rate(df, [date], target).withColumns({
        "weekday": F.weekday(date),
        "is_weekend": (F.weekday(date) >= 5).cast("int"),
        "date_ordinal": F.datediff(F.col(date), F.lit("0001-01-01").cast("date")) + 1,
    })


def minute_rates(df: DataFrame, time: str = "time", target: str = "is_cancelled") -> DataFrame:
    """Rate per minute of day with its dense position in the series."""
    per = group_rate(df.withColumn("minute_of_day", minute_of_day(time)), ["minute_of_day"], target)
    return per.withColumn("minute_ordinal", F.row_number().over(Window.orderBy("minute_of_day")) - 1)


def minute_span(df: DataFrame, time: str = "time") -> DataFrame:
    m = df.select(minute_of_day(time).alias("m"))
    return m.agg(F.min("m").alias("first_minute"), F.max("m").alias("last_minute"), F.count("m").alias("n"))


def date_range(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("date"))


def missing_days(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Days of the calendar without any row."""
    seen = df.select(F.col(date).alias("date")).where(F.col(date).isNotNull()).distinct()
    return date_range(df.sparkSession, start, end).join(seen, "date", "left_anti")


def histogram(df: DataFrame, column: str, low: float | None, high: float | None, bins: int,
              by: tuple[str, ...] = ()) -> DataFrame:
    """Equal-width histogram with density per group. Edges default to the data range."""
    if low is None or high is None:
        span = totals_of(df, low=F.min(column), high=F.max(column))
        lo, hi = span["low"].cast("double"), span["high"].cast("double")
    else:
        lo, hi = F.lit(float(low)), F.lit(float(high))
    counted = (
        df.select(*by, equal_width_bin(F.col(column).cast("double"), lo, hi, bins).alias("bin"))
        .where(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    )
    # at most ``bins`` rows per group
    total = F.sum("n").over(Window.partitionBy(*by)) if by else totals_of(counted, n=F.sum("n"))["n"]
    width = (hi - lo) / bins
    return counted.select(*by, "bin", (lo + F.col("bin") * width).alias("bin_low"), "n",
                          ratio("n", total * width).alias("density"))
