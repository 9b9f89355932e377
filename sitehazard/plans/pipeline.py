"""The whole job: feeds in, scored and explained rows out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from sitehazard.config import DEFAULT_RULES, DEFAULT_SIZING, FORECAST_LIMIT, RiskRules, Sizing
from sitehazard.functions.scoring import with_risk
from sitehazard.operators.explain import explain, with_explanation
from sitehazard.operators.features import feature_table, risk_table
from sitehazard.operators.forecast import predict
from sitehazard.operators.skew import hot_keys, join_few
from sitehazard.schemas import align_to_table
from sitehazard.sources.tables import LAYOUT, latest_snapshot, newest_rows, read_table, store

SNAPSHOT_COLUMNS = ["snapshot", "location_bucket", "location_hash"]


@dataclass(frozen=True)
class Inputs:
    """The five feeds as raw tables; see ``sources.feeds`` for landing them."""

    locations: DataFrame
    hazards: DataFrame
    quakes: DataFrame
    weather: DataFrame
    air: DataFrame


def fact_table(
    inputs: Inputs,
    models: dict[str, PipelineModel] | None = None,
    rules: RiskRules = DEFAULT_RULES,
    sizing: Sizing = DEFAULT_SIZING,
    timestamps: str = "timestamp_ntz",
    profile: DataFrame | None = None,
) -> DataFrame:
    """Scored, predicted and explained rows in the stored table's schema.

    A stored ``profile`` of the locations takes the place of the hazards and quakes.
    """
    risk = risk_table(
        inputs.locations,
        inputs.hazards,
        inputs.quakes,
        inputs.weather,
        inputs.air,
        rules=rules,
        sizing=sizing,
        profile=profile,
    )
    forecast = predict(risk, models) if models else risk
    return _explained(forecast, timestamps)


def _explained(scored: DataFrame, timestamps: str = "timestamp_ntz", keep: Sequence[str] = ()) -> DataFrame:
    return align_to_table(with_explanation(scored), "fact_environment_risk", timestamps, keep)


def refresh(
    inputs: Inputs,
    path: str,
    snapshot: int,
    models: dict[str, PipelineModel] | None = None,
    sizing: Sizing = DEFAULT_SIZING,
    profile: DataFrame | None = None,
) -> None:
    """Recompute the given locations and store them as one snapshot.

    Readers take each location's newest snapshot, so locations not given keep their rows, and
    running the same snapshot again changes nothing. The stored facts feed the explanations,
    so they are computed once. Scores and texts follow from a row's features, which alone are
    moved to the stored layout.
    """
    rows = feature_table(
        inputs.locations,
        inputs.hazards,
        inputs.quakes,
        inputs.weather,
        inputs.air,
        sizing=sizing,
        profile=profile,
    )
    if models:  # these read scored rows
        rows = predict(with_risk(rows), models)
    names = inputs.locations.select("location_id", "location_name")
    hot = hot_keys(inputs.weather, "location_id", sizing.rows_per_task)
    named = join_few(rows, names, ["location_id"], hot, "left")

    def finish(laid: DataFrame) -> DataFrame:
        return _explained(laid if models else with_risk(laid), keep=["location_name", *LAYOUT])

    store(named, f"{path}/fact_environment_risk", snapshot, finish=finish)
    stored = read_table(rows.sparkSession, f"{path}/fact_environment_risk/snapshot={snapshot}")
    store(explain(stored), f"{path}/explanations", snapshot, name=None)
    newest = newest_rows(stored, "location_id", "timestamp", FORECAST_LIMIT, sizing.rows_per_task)
    store(newest.drop(*SNAPSHOT_COLUMNS), f"{path}/newest", snapshot, name=None)


def purge(spark: SparkSession, path: str) -> list[int]:
    """Delete the snapshots in which no location has its newest rows; gives their numbers.

    One row per snapshot reaches the driver. Readers that have planned a read of a deleted
    snapshot must plan again.
    """
    facts = f"{path}/fact_environment_risk"
    held = read_table(spark, facts).select("location_id", "snapshot").distinct()
    newest = held.groupBy("location_id").agg(F.max("snapshot").alias("snapshot"))
    old = held.select("snapshot").distinct().join(newest, "snapshot", "left_anti")
    numbers = sorted(row["snapshot"] for row in old.toLocalIterator())
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for number in numbers:
        for table in (f"{path}/explanations", f"{path}/newest", facts):
            folder = hadoop.Path(f"{table}/snapshot={number}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return numbers


def refreshed(spark: SparkSession, path: str, sizing: Sizing = DEFAULT_SIZING) -> DataFrame:
    """The current facts: each location's newest snapshot."""
    table = read_table(spark, f"{path}/fact_environment_risk")
    hot = hot_keys(table, "location_id", sizing.rows_per_task)
    return latest_snapshot(table, "location_id", hot=hot).drop(*SNAPSHOT_COLUMNS)


def served(spark: SparkSession, path: str) -> DataFrame:
    """Each location's newest rows, at most ``FORECAST_LIMIT``, without reading the facts.

    A location is always replaced whole, so its newest rows lie in its newest snapshot.
    """
    return latest_snapshot(read_table(spark, f"{path}/newest"), "location_id").drop("snapshot")
