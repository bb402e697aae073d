"""The feature chain as an Estimator / Model pair: fit on training rows, apply to any rows.

``fit`` scans the training rows once: grouping sets count (vehicle, waiting time), (pickup) and (drop)
together. Medians, top lists, target means and label codes are all derived from those counts, and the
fitted state is one small table (artifact, key, value, is_top).
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareflow.operators.counts import temporal_split
from fareflow.operators.features import (
    add_grouped_encoding, add_temporal, distinct_labels, fit_grouped_encoding, label_codes, vtat_buckets,
    weighted_median,
)
from fareflow.operators.profile import missing_summary
from fareflow.scale import checkpointed, fits_broadcast, lookup_join, spread, totals_of
from fareflow.schemas import FEATURES, LATE_LEAKAGE_COLUMNS, TARGET

STATE_COLUMNS = ["artifact", "key", "value", "is_top"]


def _fit_counts(train: DataFrame) -> DataFrame:
    keys = ["vehicle_type", "avg_vtat", "pickup_location", "drop_location"]
    sets = [["vehicle_type", "avg_vtat"], ["pickup_location"], ["drop_location"]]
    counts = train.select(*keys, TARGET).groupingSets(sets, *keys).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n_rows"), F.count(TARGET).alias("n"),
        F.sum(TARGET).alias("pos"))
    # one bit per key, set when the key is absent from the grouping set
    kind = F.when(F.col("gid") == 0b0011, "vehicle").when(F.col("gid") == 0b1101, "pickup").otherwise("drop")
    return counts.withColumn("kind", kind)


def _fit_state(train: DataFrame) -> DataFrame:
    counts = checkpointed(_fit_counts(train))
    vehicle = counts.where(F.col("kind") == "vehicle")
    measured = vehicle.where(F.col("avg_vtat").isNotNull())
    medians = (measured.where(F.col("vehicle_type").isNotNull()).groupBy("vehicle_type")
               .agg(weighted_median("avg_vtat", "n_rows").alias("value")))
    overall = measured.groupBy("avg_vtat").agg(F.sum("n_rows").alias("n_rows")).agg(
        F.lit(None).cast("string").alias("vehicle_type"), weighted_median("avg_vtat", "n_rows").alias("value"))
    none = F.lit(None).cast("int")
    parts = [
        medians.unionByName(overall).select(
            F.lit("vtat_median").alias("artifact"), F.col("vehicle_type").alias("key"), "value", none.alias("is_top")),
        label_codes(distinct_labels(vehicle), "vehicle_type").select(
            F.lit("vehicle_code").alias("artifact"), F.col("vehicle_type").alias("key"),
            F.col("code").cast("double").alias("value"), none.alias("is_top")),
    ]
    for kind in ("pickup", "drop"):
        keyed = counts.where(F.col("kind") == kind).select(
            F.col(f"{kind}_location").alias("key"), "n_rows", "n", "pos")
        parts.append(fit_grouped_encoding(keyed).select(
            F.lit(f"{kind}_encoding").alias("artifact"), "key", F.col("encoded").alias("value"), "is_top"))
    state = parts[0]
    for p in parts[1:]:
        state = state.unionByName(p)
    return checkpointed(state.select(*STATE_COLUMNS))


class BookingFeatures(Estimator):
    """Learns medians, top locations, target means and label codes from training rows."""

    def _fit(self, dataset: DataFrame) -> BookingFeaturesModel:
        return BookingFeaturesModel(_fit_state(dataset))


class BookingFeaturesModel(Model):
    def __init__(self, state: DataFrame | None = None):
        super().__init__()
        self.state = state
        self._broadcast = fits_broadcast(state) if state is not None else None

    def _part(self, artifact: str) -> DataFrame:
        return self.state.where(F.col("artifact") == artifact)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        df = add_temporal(dataset.drop(*LATE_LEAKAGE_COLUMNS))
        codes, medians = self._part("vehicle_code"), self._part("vtat_median")
        overall = totals_of(medians.where(F.col("key").isNull()), m=F.max("value"))["m"]
        vehicles = codes.select(F.col("key").alias("__label"), F.col("value").cast("int").alias("vehicle_type_encoded")).join(
            F.broadcast(medians.select(F.col("key").alias("__label"), F.col("value").alias("__median")))
            if self._broadcast else medians.select(F.col("key").alias("__label"), F.col("value").alias("__median")),
            "__label", "left")
        df = df.withColumn("__label", F.coalesce("vehicle_type", F.lit("nan")))
        df = lookup_join(df, vehicles, "__label", broadcast=self._broadcast)
        df = df.withColumns({
            "vehicle_type_encoded": F.coalesce("vehicle_type_encoded", F.lit(-1)),
            "avg_vtat_imputed": F.coalesce("avg_vtat", "__median", overall),
        }).drop("__label", "__median")
        df = df.withColumns(vtat_buckets(F.col("avg_vtat_imputed")))
        for kind in ("pickup", "drop"):
            fitted = self._part(f"{kind}_encoding").select("key", "is_top", F.col("value").alias("encoded"))
            df = add_grouped_encoding(df, f"{kind}_location", f"{kind}_encoded", fitted)
        return df

    def top_locations(self, kind: str) -> DataFrame:
        return self._part(f"{kind}_encoding").where(F.col("is_top") == 1).select("key")

    def save(self, path: str) -> None:
        self.state.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BookingFeaturesModel:
        return BookingFeaturesModel(spark.read.parquet(path))


def silver(features: DataFrame, *keep: str) -> DataFrame:
    """Ordered model features, target and split."""
    return features.select(*keep, *FEATURES, TARGET, "split")


def materialised_silver(features: DataFrame, *keep: str) -> DataFrame:
    """Silver rows written once to the checkpoint folder: model fits read them many times."""
    return spread(checkpointed(silver(features, *keep)))


def run_chain(clean: DataFrame, train_end: str = "2024-09-30", val_end: str = "2024-11-30") -> tuple[DataFrame, BookingFeaturesModel]:
    """Split by date, fit on train, transform everything."""
    df = clean.withColumn("split", temporal_split("date", train_end, val_end))
    model = BookingFeatures().fit(df.where(F.col("split") == "train"))
    return model.transform(df), model


def residual_nulls(features: DataFrame) -> DataFrame:
    """Null counts left in the feature matrix."""
    return missing_summary(features, FEATURES, only_missing=False)


def train_val(features: DataFrame) -> DataFrame:
    """Training and validation rows together: a filter on the one table, no union of files."""
    return features.where(F.col("split").isin("train", "val"))
