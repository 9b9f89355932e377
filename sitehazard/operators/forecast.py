"""Six- and twelve-hour risk forecasts with a random forest per horizon."""

from __future__ import annotations

import math
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from sitehazard.config import DEFAULT_SIZING, FOREST, HORIZONS, MIN_TRAINING_ROWS, TEST_PERCENT
from sitehazard.operators import forest
from sitehazard.operators.series import horizon_labels
from sitehazard.operators.skew import Series

# The model's inputs, in order.
INPUTS = [
    "hazard_count_10km", "hazard_count_50km", "hazard_count_100km",
    "nearest_hazard_distance_km", "wind_alignment_score",
    "temperature", "humidity", "wind_speed", "precipitation", "pressure", "uv_index",
    "hour", "day_of_week", "weekend",
    "temp_1h_change", "temp_3h_change", "wind_1h_change",
]


PRIME = 1_000_003


def _filled(df: DataFrame) -> dict[str, Column]:
    return {
        name: F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
        if name in df.columns
        else F.lit(0.0)
        for name in INPUTS
    }


def model_inputs(df: DataFrame) -> DataFrame:
    """Every input as a number: absent columns and missing values are 0.

    That makes an unknown nearest distance read as 0 km.
    """
    return df.withColumns(_filled(df))


def labelled(risk: DataFrame, series: Series, direction: str = "lead") -> DataFrame:
    scored = risk.where(F.col("risk_score").isNotNull())
    return horizon_labels(scored, series, "risk_score", HORIZONS, direction)


def errors(pairs: DataFrame, actual: str, predicted: str, digits: int = 3) -> DataFrame:
    """Mean absolute error, root mean squared error and R², nulls left out, in one row.

    R² uses sums around the overall mean, so one pass is enough.
    """
    y, p = F.col(actual), F.col(predicted)
    gap = y - p
    spread = F.count("*") * F.var_pop(y)
    return pairs.dropna(subset=[actual, predicted]).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.abs(gap)), digits).alias("mae"),
        F.round(F.sqrt(F.avg(gap * gap)), digits).alias("rmse"),
        F.round(F.when(spread > 0, 1 - F.sum(gap * gap) / spread), digits).alias("r2"),
    )


def is_test_row(percent: int = TEST_PERCENT):
    """A fixed share of rows by arithmetic on their key, the same on every re-run.

    Location and second are spread over the rest classes of a prime. A row without a key is no test row.
    """
    place = f"pmod(location_id, {PRIME}) * 7919"
    second = f"pmod(unix_seconds(CAST(timestamp AS timestamp)), {PRIME}) * 104729"
    dealt = F.expr(f"({place} + {second} + {FOREST['seed']}) % {PRIME} % 100")
    return F.coalesce(dealt < percent, F.lit(False))


def dealt_evenly(rows: DataFrame, number: int, limit: int = DEFAULT_SIZING.rows_per_task) -> DataFrame:
    """So many rows over all tasks that can run at once, or more if these would have too many each.

    Place and order depend on the rows alone, so files of them are alike and a re-run draws the same samples.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(number / limit))
    return rows.repartition(tasks, "location_id", "timestamp").sortWithinPartitions(*rows.columns)


def train(risk: DataFrame, series: Series, work: str, direction: str = "lead"):
    """Fit one forest per horizon. Returns ({target: model}, metrics table or None).

    The metrics are those of the test rows; ``mean_mae`` is the error of always predicting the
    training rows' mean, which a model should stay below.

    The labelled inputs are written under ``work`` once, since a forest reads them many times.
    Under ten scored rows there is nothing to train; a target with under ten labels is left out.
    """
    spark = risk.sparkSession
    columns = ["location_id", "timestamp", "risk_score", *HORIZONS, *INPUTS]
    prepared = labelled(risk, series, direction).transform(model_inputs).select(*columns)
    prepared.write.mode("overwrite").parquet(f"{work}/training")
    rows = spark.read.parquet(f"{work}/training")
    sizes = rows.agg(F.count("*").alias("n"), *[F.count(t).alias(t) for t in HORIZONS]).first()
    models: dict[str, PipelineModel] = {}
    metrics: DataFrame | None = None
    if sizes["n"] < MIN_TRAINING_ROWS:
        return models, metrics
    for target in HORIZONS:
        if sizes[target] < MIN_TRAINING_ROWS:
            continue
        known = rows.where(F.col(target).isNotNull())
        trained = known.where(~is_test_row())
        number, mean = trained.agg(F.count("*"), F.avg(target)).first()
        settled = partial(dealt_evenly, number=number)
        models[target] = forest.fit(trained, INPUTS, target, number, mean, work, settled, **FOREST)
        tested = known.where(is_test_row())
        scored = tested.withColumn("predicted", forest.predicted(spark, models[target], _filled(tested)))
        scored = scored.withColumn("mean", F.lit(mean).cast("double"))
        by_mean = errors(scored, target, "mean").select(F.col("mae").alias("mean_mae"))
        quality = errors(scored, target, "predicted").join(by_mean).select(
            F.lit(target).alias("target"),
            "mae",
            "rmse",
            "r2",
            "mean_mae",
            (F.lit(sizes[target]) - F.col("n")).alias("n_train"),
            F.col("n").alias("n_test"),
        )
        metrics = quality if metrics is None else metrics.unionByName(quality)
    return models, metrics


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for target, model in models.items():
        model.write().overwrite().save(f"{path}/{target}")


def load_models(path: str, targets: list[str] | None = None) -> dict[str, PipelineModel]:
    return {t: PipelineModel.load(f"{path}/{t}") for t in targets or list(HORIZONS)}


def predict(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Add ``predicted_<target>``, rounded to 1 place, to every row."""
    inputs = _filled(df)
    found = {f"predicted_{t}": F.round(forest.predicted(df.sparkSession, m, inputs), 1) for t, m in models.items()}
    return df.select(*df.columns, *[value.alias(name) for name, value in found.items()])
