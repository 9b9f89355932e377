import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from sitehazard.operators import forecast, forest
from sitehazard.operators.skew import Series

NAMES = ["a", "b", "c", "d"]


def rows(number=3000):
    r = random.Random(5)
    for i in range(number):
        a, b, c = r.random() * 100, float(r.randrange(24)), float(r.randrange(2))
        d = 0.0 if i % 3 else r.gauss(0, 1)
        yield a, b, c, d, a * 0.3 + (b > 11) * 20 * c + r.random() * 5, i, i


def frame(spark, path, number=3000):
    schema = "a double, b double, c double, d double, y double, location_id long, timestamp long"
    spark.createDataFrame(list(rows(number)), schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def fitted(df, work, **settings):
    mean, number = df.agg(F.avg("y"), F.count("*")).first()
    return forest.fit(df, NAMES, "y", number, mean, work, lambda binned: binned, **settings)


def sparks(df, **settings):
    grown = RandomForestRegressor(featuresCol="inputs", labelCol="y", predictionCol="predicted", **settings)
    return Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="inputs"), grown]).fit(df)


def test_trees_are_those_of_sparks_forest(spark, tmp_path):
    df = frame(spark, str(tmp_path / "in"))
    settings = {"numTrees": 3, "maxDepth": 6, "seed": 42, "featureSubsetStrategy": "all", "bootstrap": False}
    own, theirs = fitted(df, str(tmp_path / "work"), **settings), sparks(df, **settings)
    assert own.stages[1].totalNumNodes == theirs.stages[1].totalNumNodes > 3 * 60
    assert own.stages[1].numFeatures == 4 and own.stages[1].getNumTrees == 3 and own.stages[1].getMaxDepth() == 6
    both = own.transform(df).select("location_id", "predicted").join(
        theirs.transform(df).select("location_id", F.col("predicted").alias("theirs")), "location_id"
    )
    assert both.count() == 3000 and both.where("abs(predicted - theirs) > 1e-9").count() == 0
    shares = zip(own.stages[1].featureImportances.toArray(), theirs.stages[1].featureImportances.toArray(), strict=True)
    assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-9) for x, y in shares)


def test_drawn_trees_are_as_good_as_sparks(spark, tmp_path):
    """Trees differ by their Poisson sample of about as many rows as there are."""
    df = frame(spark, str(tmp_path / "in"))
    settings = {"numTrees": 17, "maxDepth": 5, "seed": 42, "featureSubsetStrategy": "all"}
    own = fitted(df, str(tmp_path / "work"), **settings)
    again = fitted(df, str(tmp_path / "again"), **settings)
    theirs = sparks(df, **settings)

    def error(model):
        return model.transform(df).agg(F.sqrt(F.avg((F.col("y") - F.col("predicted")) ** 2))).first()[0]

    assert math.isclose(error(own), error(theirs), rel_tol=0.02)
    drawn = spark.read.parquet(str(tmp_path / "work" / "forest-y" / "data")).where("nodeData.id = 0")
    counts = [r[0] for r in drawn.select("nodeData.rawCount").collect()]
    assert len(counts) == 17 and len(set(counts)) > 10 and all(abs(n - 3000) < 5 * math.sqrt(3000) for n in counts)
    assert own.stages[1].toDebugString.split("\n", 1)[1] == again.stages[1].toDebugString.split("\n", 1)[1]


def test_predictions_are_those_of_the_model(spark, tmp_path):
    df = frame(spark, str(tmp_path / "in"), 500)
    for number, model in enumerate((
        fitted(df, str(tmp_path / "work"), numTrees=5, maxDepth=4, seed=1, featureSubsetStrategy="all"),
        sparks(df, numTrees=7, maxDepth=8, seed=1),
        sparks(df.withColumn("y", F.lit(3.0)), numTrees=2, maxDepth=3, seed=1),
    )):
        cases = df.unionByName(df.limit(1).withColumn("a", F.lit(float("inf"))))
        value = forest.predicted(spark, model, {name: F.col(name) for name in NAMES})
        both = model.transform(cases).withColumn("own", value)
        assert both.where("own = predicted").count() == 501, number


def test_blocks_give_one_tree(tmp_path, monkeypatch):
    """Sums over many blocks, and those of a larger child by what its sibling leaves, are those of one block."""
    data = np.array([r[:5] for r in rows(4000)])
    thresholds = [forest.split_points(data[:, i], 31) for i in range(4)]
    bins = np.stack([np.searchsorted(t, data[:, i]) for i, t in enumerate(thresholds)], axis=1).astype(np.uint8)

    def batches():
        for start in range(0, 4000, 70):
            some = bins[start : start + 70]
            packed = pa.array([row.tobytes() for row in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(data[start : start + 70, 4]), packed], ["label", "bins"])

    grown = []
    for size in (1 << 16, 200):
        monkeypatch.setattr(forest, "BLOCK", size)
        (folder := tmp_path / str(size)).mkdir()
        blocks = forest._Blocks(str(folder), 4, batches(), 20.0)
        assert len(blocks) == (1 if size > 4000 else 20)
        for _ in range(2):  # a second tree starts from all rows again
            blocks.draw(1, 0, False)
            grown.append(forest._tree(blocks, thresholds, 7, 20.0))
        blocks.close()
    first, *others = grown
    plain = [(n["id"], n["rawCount"], n["leftChild"], n["rightChild"], n["split"]) for n in first]
    for other in others:
        assert [(n["id"], n["rawCount"], n["leftChild"], n["rightChild"], n["split"]) for n in other] == plain
        assert all(math.isclose(x["prediction"], y["prediction"], abs_tol=1e-9) for x, y in zip(first, other, strict=True))
    assert first[0]["rawCount"] == 4000 and math.isclose(first[0]["prediction"], data[:, 4].mean())
    for node in first:
        if node["leftChild"] >= 0:
            assert node["rawCount"] == first[node["leftChild"]]["rawCount"] + first[node["rightChild"]]["rawCount"]


def test_split_points():
    assert forest.split_points(np.array([3.0, 1.0, 1.0, 2.0]), 31).tolist() == [1.5, 2.5]
    assert forest.split_points(np.array([4.0, 4.0]), 31).tolist() == []
    assert forest.split_points(np.arange(8.0), 3).tolist() == [1.5, 3.5, 5.5]
    assert forest.split_points(np.array([0.0] * 90 + list(range(1, 11))), 3).tolist() == [0.5, 1.5, 2.5]


def test_training_takes_no_job_a_level(spark, tmp_path, monkeypatch):
    """Deeper trees are passes of the same tasks over their own files, not jobs that send sums of all nodes."""
    start = dt.datetime(2024, 1, 1)
    risk = spark.createDataFrame(
        [(p, start + dt.timedelta(hours=h), float(h * p % 50), float(h % 7), float(p)) for p in range(8) for h in range(60)],
        "location_id long, timestamp timestamp_ntz, risk_score double, temperature double, wind_speed double",
    )
    jobs = []
    for depth in (2, 8):
        monkeypatch.setattr(forecast, "FOREST", {**forecast.FOREST, "maxDepth": depth, "numTrees": 4})
        spark.sparkContext.setJobGroup(f"forest-{depth}", "training")
        models, _ = forecast.train(risk, Series("location_id", "timestamp"), str(tmp_path / str(depth)))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{depth}")))
        assert set(models) == set(forecast.HORIZONS)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] > 0
