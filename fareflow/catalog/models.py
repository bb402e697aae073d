"""Queries that fit models on the silver features, plus monitoring. Every model has the reference's size: logistic models,
folds and grid; a forest of 200 trees of depth 15 (grown in parts); boosters of 200 rounds of depth 6 that stop on the
validation PR area or average precision with 20 rounds of patience."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fareflow.catalog.features import chain_features
from fareflow.catalog.sql import BL, FT, q, r
from fareflow.functions.columns import rounded
from fareflow.plans import boosting, dashboard
from fareflow.plans import models as m
from fareflow.plans.chain import materialised_silver, silver, train_val
from fareflow.scale import ensure_checkpoint_dir
from fareflow.schemas import FEATURES, TARGET
from fareflow.sources.tables import bookings, table
from fareflow.streaming.jobs import drift_table, windowed_rates

KEY = ["booking_id", "date", "time"]
#: The second booster differs by row sampling and seed.
_B = {"subsample": 0.8, "seed": 7}


def silver_frame(spark, sf):
    """Silver features with their identity columns, every row: a wait outside the buckets gets a bucket of its own."""
    features, _ = chain_features(spark, sf)
    return silver(m.with_every_bucket(features), *KEY)


def silver_rows(spark, sf):
    """The same rows written once, for fits and scores that read them many times."""
    features, _ = chain_features(spark, sf)
    return materialised_silver(m.with_every_bucket(features), *KEY)


def _train(df):
    return df.where("split = 'train'")


def _val(df):
    return df.where("split = 'val'")


def _logistic(df):
    return m.fit_logistic(_train(df))


def _forest(df):
    """200 trees of depth 15, grown in parts saved to the shared folder."""
    folder = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/forest-{uuid.uuid4().hex}"
    return m.fit_forest_parts(_train(df), folder)


def _boosting(df, metric="pr_area", **more):
    """Boosting A stops on the validation PR area, B on average precision; both with 20 rounds of patience."""
    return m.fit_stopped(_train(df), _val(df), metric, depth=boosting.DEPTH, rate=boosting.RATE, **more)


def ml_gbt_rounds(spark, sf):
    """Validation PR area and average precision after every round of both boosters, and the round each keeps."""
    df = silver_rows(spark, sf)

    def grown(name, metric, more):
        fitted = m.fit_boosting(_train(df), rounds=boosting.ROUNDS, depth=boosting.DEPTH, rate=boosting.RATE, **more)
        _, rounds, _ = boosting.early_stopped(fitted, _val(df), metric)
        return rounds.withColumns({"model_name": F.lit(name), "metric": F.lit(metric)})

    parts = m.side_by_side(spark, [partial(grown, "Boosting A", "pr_area", {}),
                                   partial(grown, "Boosting B", "average_precision", _B)], 2)
    return parts[0].unionByName(parts[1]).select("model_name", "metric", "round", "pr_area", "average_precision",
                                                 "best_round")


def ml_logreg(spark, sf):
    df = silver_rows(spark, sf)
    return m.tuned_evaluation(_logistic(df), df, "Logistic Regression")


def ml_coefficients(spark, sf):
    return m.coefficients(spark, _logistic(silver_frame(spark, sf)))


def ml_rf(spark, sf):
    df = silver_rows(spark, sf)
    return m.tuned_evaluation(_forest(df), df, "Random Forest")


def ml_gbt_a(spark, sf):
    df = silver_rows(spark, sf)
    return m.tuned_evaluation(_boosting(df), df, "Boosting A")


def ml_gbt_b(spark, sf):
    df = silver_rows(spark, sf)
    return m.tuned_evaluation(_boosting(df, "average_precision", **_B), df, "Boosting B")


def ml_cv(spark, sf):
    return m.cross_validate(train_val(silver_rows(spark, sf)), KEY, 0.45)


def ml_grid(spark, sf):
    results, _ = m.grid_search(_train(silver_frame(spark, sf)), KEY)
    return results


def ml_scores(spark, sf):
    df = silver_frame(spark, sf)  # training rows are read once, then test rows once
    return m.score(_logistic(df), df.where("split = 'test'")).select(*KEY, TARGET, m.PROB)


def ml_importance(spark, sf):
    df = silver_rows(spark, sf)
    fits = {"Random Forest": partial(_forest, df), "Logistic Regression": partial(_logistic, df),
            "Boosting A": partial(_boosting, df), "Boosting B": partial(_boosting, df, "average_precision", **_B)}
    fitted = dict(zip(fits, m.side_by_side(spark, [*fits.values()], len(fits)), strict=True))
    parts = [m.importances(spark, fitted[name], name, top=10)
             for name in ("Logistic Regression", "Random Forest", "Boosting A", "Boosting B")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dash_importance(spark, sf):
    return dashboard.panel(spark, "importance_ranking", {"model_feature_importance": ml_importance(spark, sf)})


def ml_standardise(spark, sf):
    """All model features of all rows, by the means and deviations of the training rows."""
    df = silver_rows(spark, sf)
    packed = VectorAssembler(inputCols=FEATURES, outputCol="v").transform(df)
    scaled = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(_train(packed)).transform(packed)
    z = vector_to_array("z")
    return scaled.select("booking_id", "split", *[rounded(z[i], 5).alias(f"z_{c}") for i, c in enumerate(FEATURES)])


def drift(spark, sf):
    d = drift_table(bookings(spark, sf, "avg_vtat", "split"))
    return d.withColumn("psi", rounded("psi", 8))


def stream_hourly_rates(spark, sf):
    """The events file as a stream; windows are emitted once the watermark has passed them."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"),
                         (F.col("event_type") == "error").cast("int").alias("is_cancelled"))
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (windowed_rates(rows).writeStream.outputMode("append").format("parquet")
             .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "cancelled", "total",
                      rounded("cancel_rate").alias("cancel_rate"))


_BIN = ("case when avg_vtat > 0 and avg_vtat <= 5 then 0 when avg_vtat <= 10 then 1 when avg_vtat <= 15 then 2 "
        "when avg_vtat <= 20 then 3 else -1 end")

QUERIES = {
    "ml_logreg": (ml_logreg, None),
    "ml_coefficients": (ml_coefficients, None),
    "ml_rf": (ml_rf, None),
    "ml_gbt_a": (ml_gbt_a, None),
    "ml_gbt_b": (ml_gbt_b, None),
    "ml_gbt_rounds": (ml_gbt_rounds, None),
    "ml_cv": (ml_cv, None),
    "ml_grid": (ml_grid, None),
    "ml_scores": (ml_scores, None),
    "ml_importance": (ml_importance, None),
    "report_model_feature_importance": (ml_importance, None),
    "dash_importance_ranking": (dash_importance, None),
    "ml_standardise": (ml_standardise, q(f"""
        , fm as (select booking_id, split, {", ".join(f"coalesce({c}, -1) as {c}" if c == "vtat_bucket" else c for c in FEATURES)} from ft),
        s as (select {", ".join(f"avg({c}) as a_{c}, stddev_samp({c}) as d_{c}" for c in FEATURES)} from fm where split = 'train')
        select booking_id, split, {", ".join(f"{r(f'({c} - a_{c}) / d_{c}', 5)} as z_{c}" for c in FEATURES)}
        from fm cross join s""", FT)),
    "drift_psi": (drift, q(f"""
        , c as (select split, {_BIN} as b, count(*) as n from bk group by 1, 2),
        s as (select split, sum(n) as size from c group by 1),
        g as (select split, size, b, coalesce((select n from c where c.split = s.split and c.b = x.b), 0.5) / size as p,
              coalesce((select n from c where c.split = 'train' and c.b = x.b), 0.5) / (select size from s where split = 'train') as q
              from s cross join (select distinct b from c) x)
        select split, {r("sum((p - q) * ln(p / q))", 8)} as psi, (sum((p - q) * ln(p / q)) > 0.2)::int as is_drifted
        from g group by split""", BL)),
    "stream_hourly_rates": (stream_hourly_rates, f"""
        select date_trunc('hour', ts) as window_start, count(*) filter (where event_type = 'error') as cancelled, count(*) as total,
               {r("count(*) filter (where event_type = 'error') / count(*)")} as cancel_rate from events group by 1
        having date_trunc('hour', any_value(ts)) + interval 1 hour <= (select max(ts) from events) - interval 10 minute"""),
}
