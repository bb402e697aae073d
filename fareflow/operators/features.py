"""Feature groups. Fitted groups have a ``fit_*`` that aggregates the training rows to a small table and
a ``transform`` that looks the table up; nothing of the transformed rows enters the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareflow.functions.columns import binned, booking_timestamp, cyclic, flag, minute_of_day, ratio, zoned
from fareflow.scale import checkpointed, fits_broadcast, lookup_join, running_totals, totals_of

# Bin edges, labels and hour sets.
VTAT_EDGES, VTAT_BUCKETS = [0, 5, 10, 15, 20], [0.0, 1.0, 2.0, 3.0]
HIGH_VTAT = 15
ZONE_EDGES = [0, 2.9, 5.0, 11.9, 15.0, 20.0]
ZONE_LABELS = ["instant", "short", "normal", "dip", "timeout"]
VTAT_ZONES = [
    (2.0, 2.9, "Zero-cancel"), (3.0, 5.0, "Low"), (5.1, 11.9, "Baseline"),
    (12.0, 15.0, "Dip"), (15.1, 20.0, "Guaranteed-cancel"),
]
NIGHT_HOURS = [0, 1, 2, 3, 4, 5, 22, 23]
BUSINESS_HOURS = [9, 10, 11, 12, 13, 14, 15, 16, 17]
RUSH_HOURS = [7, 8, 9, 17, 18, 19]
DEFAULT_RATE = 0.32
OTHER = "Other"
TOP_N, SMOOTHING = 10, 10


# -- stateless groups ---------------------------------------------------------------------------------

def add_temporal(df: DataFrame, date: str = "date", time: str = "time") -> DataFrame:
    """Clock, calendar, rush and cyclic features of the booking time; all NULL when the time is invalid.

    The parts are read from the date and the minute of day, so the timestamp itself is built only when a
    later step selects it.
    """
    df = df.withColumns({"booking_ts": booking_timestamp(date, time), "__minute": minute_of_day(time)})
    known = F.when(F.col("__minute").isNotNull(), F.col(date))
    hour_of = F.when(F.col(date).isNotNull(), F.floor(F.col("__minute") / 60).cast("int"))
    df = df.withColumns({
        "hour": hour_of, "dayofweek": F.weekday(known), "month": F.month(known), "day": F.day(known),
    }).drop("__minute")
    hour = F.col("hour")
    morning, evening = hour.between(7, 10), hour.between(17, 21)
    hour_sin, hour_cos = cyclic("hour", 24)
    dow_sin, dow_cos = cyclic("dayofweek", 7)
    month_sin, month_cos = cyclic("month", 12)
    return df.withColumns({
        "is_weekend": flag(F.col("dayofweek") >= 5),
        "is_morning_rush": flag(morning),
        "is_evening_rush": flag(evening),
        "is_peak_hour": flag(morning | evening),
        "is_late_night": flag((hour >= 23) | (hour <= 5)),
        "hour_sin": hour_sin, "hour_cos": hour_cos,
        "dow_sin": dow_sin, "dow_cos": dow_cos,
        "month_sin": month_sin, "month_cos": month_cos,
    })


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    return df.withColumns({
        "weekday": F.weekday(d), "month": F.month(d), "day_of_month": F.day(d),
        "week_of_year": F.weekofyear(d), "quarter": F.quarter(d),
    })


def add_hour_flags(df: DataFrame, hour: str = "hour") -> DataFrame:
    h = F.col(hour)
    return df.withColumns({
        "is_night": flag(h.isin(NIGHT_HOURS)),
        "is_business": flag(h.isin(BUSINESS_HOURS)),
        "is_rush": flag(h.isin(RUSH_HOURS)),
    })


def add_vtat_zone(df: DataFrame, vtat: str = "avg_vtat") -> DataFrame:
    x = F.col(vtat)
    return df.withColumns({
        "vtat_zone": binned(x, ZONE_EDGES, ZONE_LABELS, include_lowest=True),
        "is_instant_arrival": flag(x <= 2.9),
        "is_timeout": flag(x > 15.0),
        "is_long_wait": flag(x > 11.9),
    })


def named_zone(vtat: str = "avg_vtat") -> Column:
    return zoned(vtat, VTAT_ZONES)


def add_vtat_missing(df: DataFrame, vtat: str = "avg_vtat") -> DataFrame:
    return df.withColumn("vtat_missing", F.isnull(vtat).cast("int"))


def vtat_buckets(imputed: Column) -> dict[str, Column]:
    return {
        "vtat_bucket": binned(imputed, VTAT_EDGES, VTAT_BUCKETS),
        "is_high_vtat": flag(imputed >= HIGH_VTAT),
    }


# -- waiting time -------------------------------------------------------------------------------------

def weighted_median(value: str, n: str) -> Column:
    """Interpolated median of distinct values with counts."""
    return F.expr(f"percentile({value}, 0.5, {n})")


def fit_vtat(train: DataFrame, by: str = "vehicle_type", vtat: str = "avg_vtat") -> DataFrame:
    """Median per vehicle plus the overall median under a NULL key.

    Waiting time has one decimal and a natural ceiling, so counting distinct values first leaves a few
    hundred rows per vehicle before any median is taken.
    """
    counts = (train.where(F.col(vtat).isNotNull()).groupBy(by, vtat).agg(F.count("*").alias("n")))
    per = counts.where(F.col(by).isNotNull()).groupBy(by).agg(weighted_median(vtat, "n").alias("median_vtat"))
    overall = counts.groupBy(vtat).agg(F.sum("n").alias("n")).agg(
        F.lit(None).cast("string").alias(by), weighted_median(vtat, "n").alias("median_vtat"))
    return per.unionByName(overall)


def add_vtat(df: DataFrame, medians: DataFrame, by: str = "vehicle_type", vtat: str = "avg_vtat",
             broadcast: bool | None = None) -> DataFrame:
    """Impute by vehicle median (overall train median for unseen vehicles), bucket, high flag."""
    known = medians.where(F.col(by).isNotNull())
    overall = totals_of(medians.where(F.col(by).isNull()), m=F.max("median_vtat"))["m"]
    imputed = F.coalesce(F.col(vtat), F.col("median_vtat"), overall)
    df = lookup_join(df, known, by, broadcast=broadcast).withColumn("avg_vtat_imputed", imputed)
    return df.drop("median_vtat").withColumns(vtat_buckets(F.col("avg_vtat_imputed")))


def global_median(df: DataFrame, vtat: str = "avg_vtat") -> float | None:
    counts = df.where(F.col(vtat).isNotNull()).groupBy(vtat).agg(F.count("*").alias("n"))
    return counts.agg(weighted_median(vtat, "n").alias("m")).first()["m"]


def add_vtat_global(df: DataFrame, vtat: str = "avg_vtat") -> DataFrame:
    """Imputation with the overall median of the same rows (used before correlations).

    The median is one number and is fitted at once: as a nested query it would be planned again in every
    expression built on the imputed column.
    """
    return df.withColumn("avg_vtat_imputed", F.coalesce(F.col(vtat), F.lit(global_median(df, vtat)).cast("double")))


# -- locations ----------------------------------------------------------------------------------------

def location_counts(train: DataFrame, column: str, target: str = "is_cancelled") -> DataFrame:
    return train.groupBy(F.col(column).alias("key")).agg(
        F.count("*").alias("n_rows"), F.count(target).alias("n"), F.sum(target).alias("pos"))


def top_locations(counts: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """The ``top_n`` most frequent non-null keys; ties are broken by key."""
    return (counts.where(F.col("key").isNotNull()).orderBy(F.col("n_rows").desc(), F.col("key").asc())
            .limit(top_n).select("key"))


def grouped_location(df: DataFrame, column: str, top: DataFrame) -> DataFrame:
    """``{column}_grouped``: the location when it is in the top list, else 'Other' (also for NULL)."""
    named = top.select(F.col("key").alias(column), F.col("key").alias(f"{column}_grouped"))
    return df.join(F.broadcast(named), column, "left").withColumn(  # top_n rows
        f"{column}_grouped", F.coalesce(F.col(f"{column}_grouped"), F.lit(OTHER)))


def fit_target_encoding(counts: DataFrame, smoothing: float = SMOOTHING, *carry: str) -> DataFrame:
    """Smoothed mean per key and the global mean under a NULL key, from (key, n, pos) counts."""
    t = totals_of(counts, n=F.sum("n"), pos=F.sum("pos"))
    overall = ratio(t["pos"], t["n"])
    smoothed = (F.coalesce(F.col("pos"), F.lit(0)) + smoothing * overall) / (F.col("n") + smoothing)
    keys = counts.where(F.col("key").isNotNull()).select("key", smoothed.alias("encoded"), *carry)
    whole = counts.agg(F.lit(None).cast("string").alias("key"), ratio(F.sum("pos"), F.sum("n")).alias("encoded"),
                       *[F.lit(None).cast(counts.schema[c].dataType).alias(c) for c in carry])
    return keys.unionByName(whole)


def add_target_encoding(df: DataFrame, column: str, out: str, encoding: DataFrame,
                        broadcast: bool | None = None) -> DataFrame:
    """Encoded mean of the key; the global mean for unseen or null keys."""
    overall = totals_of(encoding.where(F.col("key").isNull()), e=F.max("encoded"))["e"]
    known = encoding.where(F.col("key").isNotNull()).select(F.col("key").alias(column), F.col("encoded").alias(out))
    return lookup_join(df, known, column, broadcast=broadcast).withColumn(
        out, F.coalesce(F.col(out), overall, F.lit(DEFAULT_RATE)))


def fit_grouped_encoding(counts: DataFrame, top_n: int = TOP_N, smoothing: float = SMOOTHING) -> DataFrame:
    """Top list and target encoding in one table of at most ``top_n`` + 2 rows: key, is_top, encoded."""
    top = top_locations(counts, top_n).withColumn("is_top", F.lit(1))
    merged = counts.join(F.broadcast(top), "key", "left").groupBy(
        F.when(F.col("is_top") == 1, F.col("key")).otherwise(OTHER).alias("key")
    ).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("is_top").alias("is_top"))
    return fit_target_encoding(merged, smoothing, "is_top")


def add_grouped_encoding(df: DataFrame, column: str, out: str, fitted: DataFrame) -> DataFrame:
    """Group and encode in one lookup of at most ``top_n`` rows; every other key shares one value."""
    top = fitted.where(F.col("is_top") == 1).select(F.col("key").alias(column), F.col("encoded").alias(out))
    rest = totals_of(
        fitted, other=F.max(F.when(F.col("key") == OTHER, F.col("encoded"))),
        overall=F.max(F.when(F.col("key").isNull(), F.col("encoded"))))
    return df.join(F.broadcast(top), column, "left").withColumn(
        out, F.coalesce(F.col(out), rest["other"], rest["overall"], F.lit(DEFAULT_RATE)))


# -- vehicles -----------------------------------------------------------------------------------------

def label_codes(labels: DataFrame, column: str) -> DataFrame:
    """Position of each distinct label in sorted order; a list over the broadcast limit is ranked by slices."""
    if fits_broadcast(labels):
        return labels.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias("code"))
    ranked = running_totals(labels.withColumn("one", F.lit(1)), column, ["one"])
    return ranked.select(column, F.col("one_before").cast("int").alias("code"))


def fit_labels(train: DataFrame, column: str = "vehicle_type") -> DataFrame:
    """Codes of the training labels; NULL is the label 'nan'."""
    return label_codes(checkpointed(distinct_labels(train, column)), column)


def distinct_labels(train: DataFrame, column: str = "vehicle_type") -> DataFrame:
    return train.select(F.coalesce(F.col(column), F.lit("nan")).alias(column)).distinct()


def add_label_code(df: DataFrame, labels: DataFrame, column: str = "vehicle_type",
                   out: str = "vehicle_type_encoded", broadcast: bool | None = None) -> DataFrame:
    """Code of the label, -1 when it was not seen in training."""
    key = "__label"
    table = labels.select(F.col(column).alias(key), F.col("code").alias(out))
    df = df.withColumn(key, F.coalesce(F.col(column), F.lit("nan")))
    return lookup_join(df, table, key, broadcast=broadcast).drop(key).withColumn(
        out, F.coalesce(F.col(out), F.lit(-1)))
