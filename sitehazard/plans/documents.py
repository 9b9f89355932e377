"""Landed weather documents to weather rows: opened, flattened, put on an hourly grid, completed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from sitehazard.config import DEFAULT_SIZING, Sizing
from sitehazard.operators.cleaning import keep_last
from sitehazard.operators.series import HOUR_US, hourly_grid
from sitehazard.operators.skew import bring_together, dealt, hot_keys, join_few, measure_series, micros, parts_for
from sitehazard.session import settle
from sitehazard.sources import feeds
from sitehazard.sources.tables import enrich

NUMBERS = [
    "temperature", "humidity", "wind_speed", "wind_gust", "wind_direction", "precipitation",
    "pressure", "uv_index",
]
TEXTS = ["condition_text"]


@dataclass(frozen=True)
class Weather:
    """Weather rows in the raw table's shape with ``seq``, and the documents that weren't read."""

    rows: DataFrame
    rejected: DataFrame


def weather(
    forecasts: DataFrame,
    currents: DataFrame,
    locations: DataFrame,
    sizing: Sizing = DEFAULT_SIZING,
) -> Weather:
    """Hourly weather of every location from its landed forecasts, else its current conditions.

    Both tables have location_id, seq and document (JSON text). Of readings of one location for one
    time, the one with the highest ``seq`` counts. Documents that can't be read are given back as
    rejected, with the reason, and take no part; a location whose forecasts are empty or all
    rejected has its newest current conditions as its one row, at their own time.
    """
    place = locations.select("location_id", "latitude", "longitude")

    def opened(landed: DataFrame, feed: str) -> tuple[DataFrame, DataFrame]:
        good, bad = feeds.opened(landed.select("location_id", "seq", "document"), feed)
        hot = hot_keys(landed, "location_id", sizing.rows_per_task)
        return join_few(good, place, ["location_id"], hot), bad

    forecast, bad_forecasts = opened(forecasts, "forecast")
    current, bad_currents = opened(currents, "current")
    keep = ["location_id", "seq"]
    readings = keep_last(feeds.flatten_forecast(forecast, keep), ["location_id", "forecast_timestamp"])
    # Opened once: the measures and the grid read the files.
    readings = settle(readings, "readings")
    series = measure_series(readings, "location_id", "forecast_timestamp", sizing.rows_per_task)
    # The grid's hours are what the tasks sort from here on, not the readings.
    at = micros(F.col("forecast_timestamp"))
    spans = readings.groupBy("location_id").agg(((F.max(at) - F.min(at)) / HOUR_US + 1).alias("hours"))
    hours = int(spans.agg(F.sum("hours")).first()[0] or 0)
    series = replace(series, parts=parts_for(hours, sizing.rows_per_task))
    hourly = hourly_grid(bring_together(readings, series), series, NUMBERS, TEXTS)
    newest = keep_last(feeds.flatten_current(current, keep), ["location_id"]).drop("seq")
    rows = feeds.fall_back_to_current(hourly, dealt(newest, series))
    # Rows of one location differ in time, which orders them.
    numbered = rows.withColumn("seq", F.unix_seconds(F.col("forecast_timestamp").cast("timestamp")))
    rejected = bad_forecasts.withColumn("feed", F.lit("forecast")).unionByName(
        bad_currents.withColumn("feed", F.lit("current"))
    )
    return Weather(enrich(numbered), rejected)
