"""What a dashboard or API asks of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitehazard.config import DEFAULT_SIZING, FORECAST_LIMIT, PLACE_LIMIT, Sizing
from sitehazard.functions.text import risk_colour, risk_mark
from sitehazard.operators.skew import hot_keys, join_few
from sitehazard.sources.tables import latest_per


def current_risk(risk: DataFrame) -> DataFrame:
    """The furthest hour of every location."""
    return latest_per(risk, "location_id", "timestamp")


def risk_card(risk: DataFrame) -> DataFrame:
    """The current row with its colour and mark, missing parts named."""
    parts = [c for c in risk.columns if c.startswith("component_")]
    counts = [c for c in risk.columns if c.startswith("hazard_count_")]
    score = F.coalesce("risk_score", F.lit(0.0))
    band = F.coalesce("risk_band", F.lit("Unknown"))
    return current_risk(risk).select(
        "location_id",
        F.round(score, 1).alias("score"),
        band.alias("band"),
        F.coalesce("recommendation", F.lit("Check conditions")).alias("recommendation"),
        risk_colour(score).alias("color"),
        risk_mark(band).alias("emoji"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.when(~F.isnan("nearest_hazard_distance_km"), F.col("nearest_hazard_distance_km"))
        .alias("nearest_hazard_distance_km"),
        F.coalesce("nearest_hazard_type", F.lit("None")).alias("nearest_hazard_type"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in parts],
    )


def latest_weather(weather: DataFrame) -> DataFrame:
    return latest_per(weather, "location_id", "forecast_timestamp", "seq")


def latest_air_quality(air: DataFrame) -> DataFrame:
    return latest_per(air, "location_id", "timestamp", "seq")


def forecast_series(risk: DataFrame, rows: int = FORECAST_LIMIT) -> DataFrame:
    """The last rows of every location; a reader orders them by time."""
    newest = Window.partitionBy("location_id").orderBy(F.col("timestamp").desc())
    return (
        risk.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= rows).drop("_nth")
    )


def chart_series(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """Chart points in time order, one row each rather than one list per location."""
    return df.select("location_id", ts, *columns).orderBy("location_id", ts)


def forecast_metrics(risk: DataFrame) -> DataFrame:
    """The last forecasts of every location and where they head."""
    six, twelve = F.col("predicted_risk_6h"), F.col("predicted_risk_12h")
    return current_risk(risk).select(
        "location_id",
        F.round(six, 1).alias("risk_6h"),
        F.round(twelve, 1).alias("risk_12h"),
        F.when(twelve > six, "worsening").otherwise("improving").alias("trend"),
    )


def band_histogram(risk: DataFrame) -> DataFrame:
    return risk.groupBy("risk_band").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "risk_band")


def risk_summary(risk: DataFrame) -> DataFrame:
    return risk.agg(
        F.round(F.avg("risk_score"), 1).alias("mean_score"),
        F.round(F.min("risk_score"), 1).alias("min_score"),
        F.round(F.max("risk_score"), 1).alias("max_score"),
    )


def source_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts by source, in one plan."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("source"), "rows")
        for name, df in tables.items()
    ]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


def locations_with_data(locations: DataFrame, risk: DataFrame) -> DataFrame:
    """Which locations have any risk rows."""
    have = risk.select("location_id").distinct().withColumn("has_data", F.lit(True))
    return locations.join(have, "location_id", "left").select(
        "location_id", F.coalesce("has_data", F.lit(False)).alias("has_data")
    )


def requested_locations(requests: DataFrame) -> DataFrame:
    """Requests with numbers for coordinates, and a name made of them where none is given.

    Requests whose coordinates are missing, empty or no numbers are left out.
    """
    made = F.concat_ws(", ", F.col("lat").cast("string"), F.col("lon").cast("string"))
    return (
        requests.withColumns(
            {
                "latitude": F.expr("try_cast(lat AS double)"),
                "longitude": F.expr("try_cast(lon AS double)"),
            }
        )
        .where("latitude is not null and longitude is not null")
        .select(
            *[c for c in requests.columns if c not in ("lat", "lon", "name")],
            F.coalesce(F.when(F.col("name") != "", F.col("name")), made).alias("name"),
            "latitude",
            "longitude",
        )
    )


def _normal(text: Column) -> Column:
    return F.lower(F.trim(text))


def place_lookup(
    requests: DataFrame,
    locations: DataFrame,
    limit: int = PLACE_LIMIT,
    sizing: Sizing = DEFAULT_SIZING,
) -> DataFrame:
    """Up to ``limit`` places per typed text, by the start of their name or city.

    The places are indexed by every prefix that is asked for and cut to ``limit`` there, so a
    popular prefix never pairs its places with its requests. Text under two characters finds
    nothing; the shown name ends at the first comma.
    """
    asked = requests.select(*requests.columns, _normal(F.col("text")).alias("_prefix")).where(
        F.length("_prefix") >= 2
    )
    wanted = asked.select("_prefix").distinct()
    named = locations.select(
        "location_id",
        "latitude",
        "longitude",
        F.concat_ws(", ", "location_name", "city", "country").alias("display_name"),
        F.explode(F.array(_normal(F.col("location_name")), _normal(F.col("city")))).alias("_name"),
    )
    prefixed = (
        named.where(F.length("_name") >= 2)
        .withColumn("_length", F.explode(F.sequence(F.lit(2), F.length("_name"))))
        .withColumn("_prefix", F.substr("_name", F.lit(1), F.col("_length")))
        .join(wanted, "_prefix", "left_semi")
        .dropDuplicates(["_prefix", "location_id"])
    )
    order = Window.partitionBy("_prefix").orderBy("location_id")
    index = (
        prefixed.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select(
            "_prefix",
            "rank",
            "location_id",
            F.substring_index("display_name", ",", 1).alias("place_name"),
            "latitude",
            "longitude",
        )
    )
    hot = hot_keys(asked, "_prefix", sizing.rows_per_task)
    return join_few(asked, index, ["_prefix"], hot).drop("_prefix")
