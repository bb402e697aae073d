"""A forest grown in parts equals the average of its parts, tree by tree."""

import random
import threading

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from fareflow.plans import models as m
from fareflow.scale import ensure_checkpoint_dir

FEATURES = ["a", "b", "c"]


def test_forest_parts_average_their_trees(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.random(), float(rng.randint(0, 4)), rng.gauss(0, 1), 0) for i in range(600)]
    rows = [(i, a, b, c, int(rng.random() < 0.2 + 0.5 * (a > 0.7))) for i, a, b, c, _ in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, is_cancelled int")
    folder = f"{ensure_checkpoint_dir(spark)}/forest-test-{rng.random()}"
    forest = m.fit_forest_parts(df, folder, FEATURES, trees=7, depth=4, part_trees=3)
    parts = [PipelineModel.load(f"{folder}/part-{p}") for p in range(3)]
    sizes = [len(p.stages[-1].trees) for p in parts]
    assert sizes == [3, 3, 1] and len(forest.stages[-1].trees) == 7 and forest.stages[-1].getNumTrees == 7

    def probs(model):
        return np.array([r[0] for r in model.transform(df).orderBy("id").select(vector_to_array("probability")[1]).collect()])

    mean = sum(k * probs(p) for k, p in zip(sizes, parts)) / 7
    assert probs(forest) == pytest.approx(mean, abs=1e-12)
    imp = sum(k * p.stages[-1].featureImportances.toArray() for k, p in zip(sizes, parts))
    assert forest.stages[-1].featureImportances.toArray() == pytest.approx(imp / imp.sum(), abs=1e-12)
    forest.write().overwrite().save(str(tmp_path / "whole"))
    again = PipelineModel.load(str(tmp_path / "whole"))
    assert probs(again) == pytest.approx(probs(forest), abs=1e-15)


def test_kept_node_ids_give_the_same_trees(spark):
    """The forest keeps each row's node and has the trees of one that walks every row from the root."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier

    rng = random.Random(8)
    df = spark.createDataFrame([(rng.random(), float(rng.randint(0, 4)), rng.gauss(0, 1), int(rng.random() < 0.3))
                                for _ in range(900)], "a double, b double, c double, is_cancelled int").repartition(3).cache()
    got = m.fit_forest(df, FEATURES, trees=6, depth=9).stages[-1]
    assert got.getCacheNodeIds()
    stage = RandomForestClassifier(featuresCol="raw_features", labelCol="is_cancelled", weightCol=m.WEIGHT, numTrees=6, maxDepth=9,
                                   minInstancesPerNode=5, seed=m.SEED)
    plain = Pipeline(stages=[m._assembler(FEATURES), stage]).fit(m.balanced_weights(df)).stages[-1]
    assert got.toDebugString.splitlines()[1:] == plain.toDebugString.splitlines()[1:]


def test_importance_fits_run_side_by_side(spark, monkeypatch):
    """All four models of the importance tables are fitted at once: each waits for the others."""
    from fareflow.catalog import models as queries

    four = threading.Barrier(4, timeout=60)

    def fit(name):
        def waiting(*args, **more):
            four.wait()
            return name, more.get("seed")
        return waiting

    monkeypatch.setattr(queries, "silver_rows", lambda spark, sf: None)
    for name in ("_logistic", "_forest", "_boosting"):
        monkeypatch.setattr(queries, name, fit(name))
    monkeypatch.setattr(m, "importances", lambda spark, model, name, top: spark.createDataFrame(
        [(name, *model)], "model_name string, fit string, seed int"))
    assert [tuple(r) for r in queries.ml_importance(spark, "").collect()] == [
        ("Logistic Regression", "_logistic", None), ("Random Forest", "_forest", None),
        ("Boosting A", "_boosting", None), ("Boosting B", "_boosting", 7)]


def test_tuned_evaluation_scores_each_row_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i % 10 / 10, int(i % 3 == 0), ["train", "val", "test"][i % 3 if i % 2 else i % 4 % 3]) for i in range(240)],
                               "p double, is_cancelled int, split string").cache()
    seen = spark.sparkContext.accumulator(0)

    def scored(p):
        seen.add(1)
        return p

    monkeypatch.setattr(m, "score", lambda model, rows: rows.withColumn(m.PROB, F.udf(scored, "double").asNondeterministic()("p")))
    rows = m.tuned_evaluation(None, df, "x").collect()
    assert sorted(r["split"] for r in rows) == ["test", "val"]
    assert seen.value == df.where("split <> 'train'").count()


def test_large_grid_fits_one_at_a_time(spark, monkeypatch):
    """Above the bound on rows a grid has one fit's copy of the rows, kept as parquet; the results are the same."""
    asked = []
    search = m.CrossValidator
    monkeypatch.setattr(m, "CrossValidator", lambda **more: asked.append(more["parallelism"]) or search(**more))
    rng = random.Random(5)
    df = spark.createDataFrame([(i, float(a := rng.randint(0, 5)), float(rng.randint(0, 3)), int(rng.random() < 0.1 + a / 8))
                                for i in range(600)], "id long, a double, b double, is_cancelled int")
    some = dict(cs=[0.1, 1], penalties=["l2"], folds=2, max_iter=20, features=["a", "b"])
    small = [tuple(r) for r in m.grid_search(df, ["id"], **some)[0].orderBy("c").collect()]
    files = []
    write = m.written
    monkeypatch.setattr(m, "written", lambda rows: files.append(write(rows)) or files[-1])
    monkeypatch.setattr(m, "GRID_ROWS", 10)
    large = [tuple(r) for r in m.grid_search(df, ["id"], **some)[0].orderBy("c").collect()]
    assert asked == [4, 1] and all(f.endswith(".parquet") for f in files[0].inputFiles())
    for a, b in zip(small, large, strict=True):
        assert a == pytest.approx(b, abs=1e-6)


def test_fits_run_side_by_side(spark, monkeypatch):
    """Two parts of a forest, and both boosters of the table of rounds, are grown at once: each waits for the other."""
    from fareflow.catalog import models as queries

    pair = threading.Barrier(2, timeout=60)

    def waiting(fit):
        def each(*args, **more):
            pair.wait()
            return fit(*args, **more)
        return each

    df = spark.createDataFrame([(float(i % 7), float(i % 3), i % 5 % 2, "train" if i % 4 else "val") for i in range(200)],
                               "a double, b double, is_cancelled int, split string")
    monkeypatch.setattr(m, "fit_forest", waiting(m.fit_forest))
    folder = f"{ensure_checkpoint_dir(spark)}/forest-pair-{random.random()}"
    forest = m.fit_forest_parts(df, folder, ["a", "b"], trees=4, depth=2, part_trees=2)
    assert len(forest.stages[-1].trees) == 4
    monkeypatch.setattr(queries, "silver_rows", lambda spark, sf: df)
    monkeypatch.setattr(m, "fit_boosting", waiting(lambda train, **more: more))
    monkeypatch.setattr(queries.boosting, "early_stopped", lambda fitted, val, metric: (None, spark.createDataFrame(
        [(1, 0.5, 0.5, fitted.get("seed", 0))], "round int, pr_area double, average_precision double, best_round int"), 1))
    got = sorted(tuple(r) for r in queries.ml_gbt_rounds(spark, "").select("model_name", "metric", "best_round").collect())
    assert got == [("Boosting A", "pr_area", 0), ("Boosting B", "average_precision", 7)]
