"""The five feeds, derived from the shared test tables.

Each feed is a list of (column, expression). The expressions stick to what Spark SQL and ANSI
SQL spell alike, so the same text also feeds the SQL checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

DOUBLE = "CAST({} AS DOUBLE)"


def _tenths(number: str) -> str:
    return f"({number})/CAST(10 AS DOUBLE)"


def _hundredths(number: str) -> str:
    return f"({number})/CAST(100 AS DOUBLE)"


@dataclass(frozen=True)
class Feed:
    source: str
    columns: dict[str, str]
    where: str = ""

    def sql(self) -> str:
        chosen = ", ".join(f"{text} AS {name}" for name, text in self.columns.items())
        return f"SELECT {chosen} FROM {self.source}" + (f" WHERE {self.where}" if self.where else "")


CATEGORIES = (
    "Wildfires",
    "Severe Storms",
    "Floods",
    "Volcanoes",
    "Dust and Haze",
    "Landslides",
    "Droughts",
    "Extreme Temperature",
    "Sea and Lake Ice",
)

FEEDS = {
    "locations": Feed(
        "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
        {
            "location_id": "c_custkey",
            "location_name": "concat('Site ', CAST(c_custkey AS STRING))",
            "latitude": "12 + " + _hundredths("(c_custkey*7919)%1200"),
            "longitude": "70 + " + _hundredths("(c_custkey*10007)%1200"),
            "city": "n_name",
            "region": "r_name",
            "country": "'Testland'",
        },
    ),
    "raw_hazards": Feed(
        "events",
        {
            "seq": "event_id",
            "event_id": "concat('EV_', CAST(CAST(FLOOR(event_id/CAST(50 AS DOUBLE)) AS BIGINT) "
            "AS STRING), '_', CAST(event_id%4 AS STRING))",
            "category": "CASE event_id%9 "
            + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATEGORIES))
            + " END",
            "title": "concat('Event ', CAST(event_id AS STRING))",
            "status": "CASE WHEN event_id%10 < 7 THEN 'open' WHEN event_id%10 < 9 THEN 'closed' "
            "ELSE 'unknown' END",
            "event_timestamp": "ts",
            "latitude": "CASE WHEN event_id%97=0 THEN CAST(200 AS DOUBLE) ELSE 12 + "
            + _hundredths("(event_id*6131)%1200")
            + " END",
            "longitude": "CASE WHEN event_id%89=0 THEN NULL ELSE 70 + "
            + _hundredths("(event_id*3571+17)%1200")
            + " END",
        },
        "event_type='error'",
    ),
    "raw_quakes": Feed(
        "events",
        {
            "seq": "event_id",
            "id": "concat(CASE WHEN event_id%11=0 THEN 'mock_eq_' ELSE 'us' END, "
            "CAST(event_id AS STRING))",
            "title": "concat('M', CAST(event_id%50 AS STRING))",
            "magnitude": "2 + " + _tenths("event_id%50"),
            "depth_km": _tenths("event_id%300"),
            "latitude": "12 + " + _hundredths("(event_id*4799)%1200"),
            "longitude": "70 + " + _hundredths("(event_id*5303+5)%1200"),
            "timestamp": "ts",
            "status": "'open'",
            "category": "'Earthquakes'",
        },
        "event_type='purchase'",
    ),
    "raw_weather": Feed(
        "events",
        {
            "location_id": "user_id",
            "seq": "event_id",
            "forecast_timestamp": "ts",
            "temperature": "CASE WHEN event_id%31=0 THEN NULL ELSE 10 + "
            + _tenths("event_id*37%300")
            + " END",
            "humidity": DOUBLE.format("30 + event_id*13%70"),
            "wind_speed": DOUBLE.format("event_id*29%80"),
            "wind_direction": DOUBLE.format("event_id*41%360"),
            "precipitation": _tenths("event_id*17%160"),
            "pressure": DOUBLE.format("990+event_id%40"),
            "uv_index": _tenths("event_id%110"),
            "condition_text": "CASE event_type WHEN 'click' THEN 'Clear Sky' "
            "WHEN 'view' THEN 'Light Rain' ELSE 'Broken Clouds' END",
        },
        "event_type IN ('click','view','purchase')",
    ),
    "raw_air": Feed(
        "events",
        {
            "location_id": "user_id",
            "seq": "event_id",
            "timestamp": "ts",
            "aqi": "CAST(event_id%5+1 AS INT)",
            "co": _tenths("event_id*7%200"),
            "so2": _tenths("event_id*11%400"),
        },
        "event_type='signup'",
    ),
    "bulk_rows": Feed(
        "lineitem",
        {
            "l_orderkey": "l_orderkey",
            "l_linenumber": "l_linenumber",
            "l_partkey": "l_partkey",
            "l_suppkey": "l_suppkey",
            "hazard_types": "CASE l_partkey%5 WHEN 0 THEN '' WHEN 1 THEN 'Wildfires' "
            "WHEN 2 THEN 'Floods, Landslides' WHEN 3 THEN 'Unlisted' ELSE NULL END",
            "nearest_hazard_distance_km": "CASE WHEN l_partkey%7=0 THEN NULL ELSE "
            + _tenths("l_suppkey*37%1500")
            + " END",
            "hazard_count_100km": "l_linenumber - 1",
            "temp_1h_change": _tenths("l_orderkey%200 - 100"),
            "wind_speed": "l_quantity*3/CAST(2 AS DOUBLE)",
            "humidity": DOUBLE.format("40 + l_partkey%60"),
            "precipitation": _tenths("l_orderkey%150"),
            "aqi": "CAST(l_suppkey%6 AS INT)",
            "co": _tenths("l_partkey%200"),
            "so2": _tenths("l_orderkey%400"),
            "max_eq_magnitude": "2 + " + _tenths("l_partkey%50"),
        },
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def feed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived feed over the test tables in a folder."""
    spec = FEEDS[name]
    if name == "locations":
        source = (
            table(spark, folder, "customer")
            .join(table(spark, folder, "nation"), F.expr("c_nationkey = n_nationkey"))
            .join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
        )
    else:
        source = table(spark, folder, spec.source)
    return project(source, name)


def project(source: DataFrame, name: str) -> DataFrame:
    """The feed's rows out of its source table, batch or streaming."""
    spec = FEEDS[name]
    rows = source.where(spec.where) if spec.where else source
    return rows.selectExpr(*[f"{text} AS {name}" for name, text in spec.columns.items()])

