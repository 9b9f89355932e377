"""Landed feed documents: their shapes, reading them, flattening them to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitehazard.functions.solar import uv_index
from sitehazard.functions.text import air_label, title_case

# Field names of the delivered documents.

HAZARD_DOCUMENT = """
    events array<struct<
        id: string, title: string, status: string,
        categories: array<struct<title: string>>,
        geometry: array<struct<date: string, coordinates: array<double>>>>>"""

_READING = """
    dt: bigint,
    main: struct<temp: double, humidity: double, pressure: double>,
    weather: array<struct<description: string>>,
    wind: struct<speed: double, gust: double, deg: double>"""

FORECAST_DOCUMENT = f"""
    list array<struct<{_READING},
        rain: struct<`3h`: double>, snow: struct<`3h`: double>>>"""

CURRENT_DOCUMENT = """
    dt bigint,
    main struct<temp: double, humidity: double, pressure: double>,
    weather array<struct<description: string>>,
    wind struct<speed: double, gust: double, deg: double>"""

GASES = ("co", "no", "no2", "o3", "so2", "pm2_5", "pm10", "nh3")

AIR_DOCUMENT = f"""
    list array<struct<dt: bigint, main: struct<aqi: int>,
        components: struct<{', '.join(f'{gas}: double' for gas in GASES)}>>>"""

QUAKE_DOCUMENT = """
    features array<struct<
        id: string,
        properties: struct<title: string, mag: double, time: bigint>,
        geometry: struct<coordinates: array<double>>>>"""

DOCUMENTS = {
    "hazards": HAZARD_DOCUMENT,
    "forecast": FORECAST_DOCUMENT,
    "current": CURRENT_DOCUMENT,
    "air": AIR_DOCUMENT,
    "quakes": QUAKE_DOCUMENT,
}


def read_documents(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """Landed documents, one per line, with the feed's explicit schema."""
    return spark.read.schema(DOCUMENTS[feed]).json(path)


def parse_documents(df: DataFrame, feed: str, text: str = "document") -> DataFrame:
    """Documents held as JSON text in a column; the other columns stay."""
    rest = [c for c in df.columns if c != text]
    parsed = df.withColumn("_doc", F.from_json(F.col(text), DOCUMENTS[feed]))
    return parsed.select(*rest, "_doc.*")


def opened(landed: DataFrame, feed: str, text: str = "document") -> tuple[DataFrame, DataFrame]:
    """Landed documents parsed, and those that can't be, with ``reason``; the other columns stay.

    A document is rejected whole if it is missing, isn't JSON, or has a value of another type than
    the feed's. Absent fields are no fault.
    """
    rest = [c for c in landed.columns if c != text]
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"}
    parsed = landed.withColumn("_doc", F.from_json(text, f"{DOCUMENTS[feed]}, _unread string", settings))
    missing = F.coalesce(F.trim(F.col(text)), F.lit("")) == ""
    unread = F.col("_doc._unread").isNotNull() | F.col("_doc").isNull()
    reason = F.when(missing, "missing").when(unread, "malformed")
    judged = parsed.withColumn("_reason", reason)
    good = judged.where("_reason IS NULL").select(*rest, "_doc.*").drop("_unread")
    bad = judged.where("_reason IS NOT NULL").select(*rest, text, F.col("_reason").alias("reason"))
    return good, bad


# Documents are opened with ``explode_outer`` and a filter: a plain ``explode`` makes the
# optimizer test the array for being empty below it, which would parse every document twice.


def _or(value: Column, default: object) -> Column:
    return F.coalesce(value, F.lit(default))


def flatten_hazards(documents: DataFrame, keep: list[str] = []) -> DataFrame:
    """First category, last geometry; events without a two-number position are left out."""
    event = F.col("event")
    last = F.try_element_at(event["geometry"], F.lit(-1))
    return (
        documents.select(*keep, F.explode_outer("events").alias("event"))
        .select(*keep, "event", last.alias("place"))
        .where(F.size("place.coordinates") == 2)
        .select(
            *keep,
            event["id"].alias("event_id"),
            _or(F.get(event["categories"], 0)["title"], "Unknown").alias("category"),
            _or(event["title"], "").alias("title"),
            F.lit("open").alias("status"),
            F.try_to_timestamp(F.col("place.date")).alias("event_timestamp"),
            F.get("place.coordinates", 1).alias("latitude"),
            F.get("place.coordinates", 0).alias("longitude"),
        )
    )


def _weather_columns(reading, rain: Column, ts: Column) -> list[Column]:
    sky = F.get(reading("weather"), 0)["description"]
    return [
        ts.alias("forecast_timestamp"),
        reading("main")["temp"].alias("temperature"),
        reading("main")["humidity"].alias("humidity"),
        reading("wind")["speed"].alias("wind_speed"),
        _or(reading("wind")["gust"], 0.0).alias("wind_gust"),
        _or(reading("wind")["deg"], 0.0).alias("wind_direction"),
        rain.alias("precipitation"),
        reading("main")["pressure"].alias("pressure"),
        uv_index(F.col("latitude"), F.col("longitude"), ts).alias("uv_index"),
        _or(title_case(sky), "Clear").alias("condition_text"),
    ]


def flatten_forecast(documents: DataFrame, keep: list[str] = ["location_id"]) -> DataFrame:
    """The delivered readings of every location, before they are put on an hourly grid.

    Needs the location's ``latitude`` and ``longitude`` beside the document for the UV index.
    """
    exploded = documents.select(
        *keep, "latitude", "longitude", F.explode_outer("list").alias("reading")
    ).where("reading is not null")
    reading = lambda name: F.col("reading")[name]
    wet = _or(reading("rain")["3h"], 0.0) + _or(reading("snow")["3h"], 0.0)
    return exploded.select(
        *keep, *_weather_columns(reading, wet, F.timestamp_seconds(reading("dt")))
    )


def flatten_current(documents: DataFrame, keep: list[str] = ["location_id"]) -> DataFrame:
    """Current conditions as one weather row, without precipitation."""
    return documents.select(
        *keep, *_weather_columns(F.col, F.lit(0.0), F.timestamp_seconds(F.col("dt")))
    )


def fall_back_to_current(
    forecast: DataFrame, current: DataFrame, key: str = "location_id"
) -> DataFrame:
    """Current conditions stand in for locations whose forecast came back empty."""
    have = forecast.select(key).distinct()
    return forecast.unionByName(current.join(have, key, "left_anti"))


def flatten_air(documents: DataFrame, keep: list[str] = ["location_id"]) -> DataFrame:
    index = F.col("reading.main.aqi")
    readings = documents.select(*keep, F.explode_outer("list").alias("reading"))
    return readings.where("reading is not null").select(
        *keep,
        F.timestamp_seconds("reading.dt").alias("timestamp"),
        index.alias("aqi"),
        air_label(index).alias("aqi_label"),
        *[_or(F.col(f"reading.components.{gas}"), 0.0).alias(gas) for gas in GASES],
    )


def flatten_quakes(documents: DataFrame, keep: list[str] = []) -> DataFrame:
    """A quake without a magnitude keeps its row; the magnitude filter drops it later."""
    place = F.col("quake.geometry.coordinates")
    quakes = documents.select(*keep, F.explode_outer("features").alias("quake"))
    return quakes.where("quake is not null").select(
        *keep,
        _or(F.col("quake.id"), "").alias("id"),
        _or(F.col("quake.properties.title"), "Earthquake").alias("title"),
        F.col("quake.properties.mag").alias("magnitude"),
        _or(F.get(place, 2), 0.0).alias("depth_km"),
        F.get(place, 1).alias("latitude"),
        F.get(place, 0).alias("longitude"),
        F.timestamp_millis("quake.properties.time").alias("timestamp"),
        F.lit("open").alias("status"),
        F.lit("Earthquakes").alias("category"),
    )
