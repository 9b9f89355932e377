"""Incremental jobs over newly landed files, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from sitehazard.config import DEFAULT_RULES, DEFAULT_SIZING, RiskRules, Sizing
from sitehazard.functions.scoring import with_risk
from sitehazard.operators.changes import changed_spots, reached
from sitehazard.operators.cleaning import keep_last
from sitehazard.operators.features import hazards_and_quakes, location_profile
from sitehazard.plans.pipeline import Inputs, purge, refresh
from sitehazard.session import settle
from sitehazard.sources.tables import exists, latest_per

#: Feeds that arrive, as named in ``Inputs``.
FEEDS = ("hazards", "quakes", "weather", "air")
#: Feeds with a location, kept in so many folders a batch, and the columns that folders stand for.
BY_LOCATION, BUCKETS = ("weather", "air"), 32
ADDED = ["batch", "location_bucket"]


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str = "seq"
) -> StreamingQuery:
    """Append every micro-batch, reduced to its last row per key, as its own folder.

    A batch that is run again after a failure overwrites its own folder, so nothing doubles,
    and no row has to be held as streaming state. ``upserted`` reads the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        keep_last(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _run(stream, checkpoint, write)


def upserted(spark: SparkSession, path: str, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row per key over all batches so far."""
    return keep_last(spark.read.parquet(path).drop("batch"), keys, order)


def compact(spark: SparkSession, path: str, target: str, keys: list[str], order: str = "seq") -> None:
    """Rewrite the batches so far as one; the stream goes on in the old folder or a new one."""
    upserted(spark, path, keys, order).write.mode("overwrite").parquet(f"{target}/batch=-1")


def score(
    stream: DataFrame, path: str, checkpoint: str, rules: RiskRules = DEFAULT_RULES
) -> StreamingQuery:
    """Score feature rows as they arrive; stateless, written once each by the file sink."""
    return (
        with_risk(stream, rules)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def refresh_on_arrival(
    stream: DataFrame,
    arrivals: Callable[[DataFrame], dict[str, DataFrame]],
    locations: DataFrame,
    path: str,
    checkpoint: str,
    sizing: Sizing = DEFAULT_SIZING,
) -> StreamingQuery:
    """Keep the facts of all locations up to date with what arrives.

    ``arrivals`` turns the arrived rows into raw rows of the ``FEEDS``. They are kept by batch
    beside the facts, as are the locations' spatial profiles. What a batch changes is followed:

    * Its hazards, against earlier versions of the same events, and its quakes give the changed
      spots. Only locations that these reach get a new profile.
    * Only locations whose profile differs from the one before, or with new weather or air
      quality, are recomputed, from their own weather and air quality so far and their profile. Those are kept
      by a hash of the location, so that only the folders of such locations are read.

    Each recomputed location is replaced whole, as the snapshot of the batch's number, and
    snapshots that no location needs any more are deleted. A batch that is run again reads what
    came before it only, and overwrites what it wrote.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        arrived = arrivals(batch)
        for name, rows in arrived.items():
            _keep(rows, name, f"{path}/raw/{name}/batch={number}")
        kinds = {name: rows.schema for name, rows in arrived.items()}
        new = {name: _kept(spark, path, name, kinds[name]).where(F.col("batch") == number) for name in FEEDS}
        so_far = {name: _kept(spark, path, name, kinds[name]).where(F.col("batch") <= number) for name in FEEDS}
        altered = _profiled(spark, path, number, locations, new, so_far, sizing)
        touched = new["weather"].select("location_id").unionByName(new["air"].select("location_id"))
        touched = settle(touched.unionByName(altered).distinct(), "touched")
        if not touched.isEmpty():
            wanted = locations.join(touched, "location_id", "left_semi")
            profile = stored_profiles(spark, path, number + 1).join(touched, "location_id", "left_semi")
            # At most ``BUCKETS`` numbers; the folders of the others aren't read.
            buckets = [r[0] for r in touched.select(_bucket()).distinct().collect()]
            for name in BY_LOCATION:
                there = so_far[name].where(F.col("location_bucket").isin(buckets))
                so_far[name] = there.join(touched, "location_id", "left_semi")
            inputs = {name: so_far[name].drop(*ADDED) for name in FEEDS}
            refresh(Inputs(wanted, **inputs), path, number, sizing=sizing, profile=profile)
        purge(spark, path)

    return _run(stream, checkpoint, run)


def _bucket() -> Column:
    number = F.xxhash64(F.col("location_id").cast("string"))
    return F.pmod(number, F.lit(BUCKETS)).cast("int").alias("location_bucket")


def _keep(rows: DataFrame, name: str, path: str) -> None:
    """Store a batch's rows of a feed; those of locations in folders by a hash of the location."""
    if name in BY_LOCATION:
        bucketed = rows.select("*", _bucket()).hint("rebalance", "location_bucket")
        bucketed.write.mode("overwrite").partitionBy("location_bucket").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(path)


def _kept(spark: SparkSession, path: str, name: str, kind: StructType) -> DataFrame:
    """All stored rows of a feed with ``batch`` and, by location, ``location_bucket``, from folder names."""
    folders = ADDED if name in BY_LOCATION else ADDED[:1]
    fields = [*kind.fields, *(StructField(c, IntegerType()) for c in folders)]
    return spark.read.schema(StructType(fields)).parquet(f"{path}/raw/{name}")


def stored_profiles(spark: SparkSession, path: str, number: int) -> DataFrame:
    """Each location's newest profile from the batches before one with the number."""
    stored = spark.read.parquet(f"{path}/profiles").where(F.col("batch") < number)
    return latest_per(stored, "location_id", "batch").drop("batch")


def _profiled(
    spark: SparkSession,
    path: str,
    number: int,
    locations: DataFrame,
    new: dict[str, DataFrame],
    so_far: dict[str, DataFrame],
    sizing: Sizing,
) -> DataFrame:
    """Store the profiles that the batch can change; ids of those that it did."""
    target = f"{path}/profiles/batch={number}"
    ids = locations.select("location_id")
    if not exists(spark, f"{path}/profiles") or stored_profiles(spark, path, number).isEmpty():
        first = location_profile(locations, so_far["hazards"], so_far["quakes"], sizing=sizing)
        first.write.mode("overwrite").parquet(target)
        return ids
    before = settle(stored_profiles(spark, path, number), "profiles-before")
    stale = ids.join(before, "location_id", "left_anti")
    if not (new["hazards"].isEmpty() and new["quakes"].isEmpty()):
        older = so_far["hazards"].where(F.col("batch") < number)
        arrived = new["hazards"].select(F.col("event_id").alias("arrived_id")).distinct()
        older = older.join(arrived, F.expr("event_id <=> arrived_id"), "left_semi")
        changed = changed_spots(
            hazards_and_quakes(older, new["quakes"].where("false")),
            hazards_and_quakes(older.unionByName(new["hazards"]), new["quakes"]),
        )
        changed = settle(changed, "changed")
        if not changed.isEmpty():
            stale = stale.unionByName(reached(before, changed, sizing=sizing))
    stale = settle(stale.distinct(), "stale")
    if stale.isEmpty():
        return ids.where("false")
    again = locations.join(stale, "location_id", "left_semi")
    profiles = location_profile(again, so_far["hazards"], so_far["quakes"], sizing=sizing)
    profiles.write.mode("overwrite").parquet(target)
    written = spark.read.parquet(target)
    return written.exceptAll(before.select(written.columns)).select("location_id")
