"""Cleaning and validation of the feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from sitehazard.config import WEATHER_DEFAULTS

HAZARD_COLUMNS = ["event_id", "category", "title", "latitude", "longitude", "event_timestamp"]
WEATHER_COLUMNS = ["forecast_timestamp", "temperature", "humidity", "wind_speed"]


def has_columns(df: DataFrame, required: list[str]) -> bool:
    return all(name in df.columns for name in required)


def keep_last(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last row of every key by ``order``; null keys count as one key.

    The rank filter runs before the shuffle as well, so a key with very many copies sends one
    row per input task.
    """
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def parse_timestamps(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text becomes a timestamp, unreadable text null; absent or typed columns are left."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parsed = {c: F.try_to_timestamp(F.col(c)) for c in columns if c in text}
    return df.withColumns(parsed) if parsed else df


def fill_missing(df: DataFrame, values: dict[str, float] | None = None) -> DataFrame:
    """Defaults for null and NaN in the columns present."""
    values = WEATHER_DEFAULTS if values is None else values
    present = {name: value for name, value in values.items() if name in df.columns}
    return df.fillna(present) if present else df


def valid_coordinate(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def valid_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.where(valid_coordinate(F.col(lat), F.col(lon)))


def valid_timestamps(df: DataFrame, ts: str) -> DataFrame:
    return parse_timestamps(df, [ts]).where(F.col(ts).isNotNull())


def clean_hazards(df: DataFrame, order: str = "seq") -> DataFrame:
    """Last version of each event, readable times, coordinates on the globe.

    A table without the required columns passes unchanged.
    """
    if not has_columns(df, HAZARD_COLUMNS):
        return df
    return (
        df.transform(keep_last, ["event_id"], order)
        .transform(parse_timestamps, ["event_timestamp", "ingestion_ts"])
        .transform(valid_coordinates)
    )


def clean_weather(df: DataFrame, order: str = "seq", key: str = "location_id") -> DataFrame:
    """Last row per location and forecast time, gaps filled, times readable.

    Copies are found on the time as it was delivered, before parsing.
    """
    if not has_columns(df, WEATHER_COLUMNS):
        return df
    keys = [c for c in (key, "forecast_timestamp") if c in df.columns]
    return (
        df.transform(keep_last, keys, order)
        .transform(parse_timestamps, ["forecast_timestamp"])
        .transform(fill_missing)
        .transform(valid_timestamps, "forecast_timestamp")
    )


def active_hazards(df: DataFrame) -> DataFrame:
    return df.where(F.col("status").isin("open", "unknown"))


def open_hazard_feed(df: DataFrame, limit: int) -> DataFrame:
    """The feed request: open events, newest first, up to its page size."""
    return (
        df.where(F.col("status") == "open")
        .orderBy(F.col("event_timestamp").desc(), F.col("event_id"))
        .limit(limit)
    )


def hazard_quality(df: DataFrame, order: str = "seq") -> DataFrame:
    """How many rows each cleaning step drops, in one row."""
    ok = valid_coordinate(F.col("latitude"), F.col("longitude"))
    # Per key first, so the versions of an event meet as partial counts only.
    per_key = df.groupBy("event_id").agg(
        F.count("*").alias("rows"),
        F.max_by(F.coalesce(ok, F.lit(False)), order).alias("ok"),
    )
    total, keys, kept = F.sum("rows"), F.count("*"), F.count_if("ok")
    return per_key.agg(
        F.coalesce(total, F.lit(0)).alias("rows_in"),
        F.coalesce(total - keys, F.lit(0)).alias("duplicate_rows"),
        (keys - kept).alias("invalid_coordinate_rows"),
        kept.alias("rows_out"),
    )


def score_quality(df: DataFrame) -> DataFrame:
    """Scores inside and outside 0 to 100."""
    ok = F.col("risk_score").between(0, 100)
    return df.agg(
        F.count_if(ok).alias("valid_scores"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid_scores"),
    )
