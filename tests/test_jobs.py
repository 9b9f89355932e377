"""Whole jobs: the pipeline, streams, models, the registered queries."""

import json
import os
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from sitehazard.plans.catalog import QUERIES
from sitehazard.plans.oracle import SQL
from sitehazard.config import HORIZONS, Sizing
from sitehazard.operators import features, forecast
from sitehazard.operators.skew import Series, measure_series
from sitehazard.plans import pipeline
from sitehazard.sources import feeds, tables
from sitehazard.sources.derived import feed
from sitehazard.streaming import refresh as streaming

FOLDER = "/root/testdata/sf0.001"
NAMES = ("locations", "raw_hazards", "raw_quakes", "raw_weather", "raw_air")
KEYS = ["location_id", "timestamp"]


@pytest.fixture(scope="module")
def risk(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("risk") / "risk")
    features.risk_table(*[feed(spark, FOLDER, n) for n in NAMES]).write.parquet(path)
    return spark.read.parquet(path)


def same(left, right):
    assert sorted(left.columns) == sorted(right.columns)
    one = sorted(map(str, left.select(sorted(left.columns)).collect()))
    two = sorted(map(str, right.select(sorted(left.columns)).collect()))
    assert one == two


def test_splitting_hot_keys_changes_nothing(spark, risk):
    """The same job with bounds so low that every strategy for large data is taken."""
    small = features.risk_table(
        *[feed(spark, FOLDER, n) for n in NAMES], sizing=Sizing(rows_per_task=20, points_per_cell=2)
    )
    digits = {c: F.round(c, 6) for c, kind in risk.dtypes if kind == "double"}
    same(risk.withColumns(digits), small.withColumns(digits))


def test_scores_are_in_range_and_order_of_input_does_not_matter(spark, risk):
    assert risk.where("risk_score between 0 and 100").count() == risk.count() > 0
    shuffled = features.risk_table(
        *[feed(spark, FOLDER, n).repartition(7, F.rand(3)) for n in NAMES]
    )
    digits = {c: F.round(c, 6) for c, kind in risk.dtypes if kind == "double"}
    same(risk.withColumns(digits), shuffled.withColumns(digits))


def test_no_python_and_no_cross_join_in_the_plan(spark):
    frame = features.risk_table(*[feed(spark, FOLDER, n) for n in NAMES])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "CartesianProduct", "NestedLoop"):
        assert unwanted not in plan
    assert "PushedFilters: [Or" in plan or "PushedFilters: [In(event_type" in plan


def test_feeds_from_documents_run_through_the_pipeline(spark, tmp_path):
    """Landed documents of two locations to stored, explained, scored rows."""
    start = 1704067200
    readings = [
        {"dt": start + 10_800 * i, "main": {"temp": 20.0 + 3 * i, "humidity": 80, "pressure": 1000},
         "weather": [{"description": "light rain"}], "wind": {"speed": 40.0, "deg": 90}}
        for i in range(3)
    ]
    hazard = {"id": "E1", "title": "Fire", "categories": [{"title": "Wildfires"}],
              "geometry": [{"date": "2024-01-01T00:00:00Z", "coordinates": [72.9, 19.1]}]}
    locations = spark.createDataFrame(
        [(1, "Mumbai", 19.076, 72.8777), (2, "Far Away", -40.0, 10.0)],
        "location_id long, location_name string, latitude double, longitude double",
    )

    def documents(kind, docs):
        rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "location_id long, document string")
        return feeds.parse_documents(rows.join(locations, "location_id"), kind)

    seq = F.unix_seconds("forecast_timestamp")
    weather = feeds.flatten_forecast(documents("forecast", [(1, {"list": readings}), (2, {"list": readings})]))
    series = Series("location_id", "forecast_timestamp")
    from sitehazard.operators.series import hourly_grid

    numeric = ["temperature", "humidity", "wind_speed", "wind_gust", "wind_direction", "precipitation", "pressure", "uv_index"]
    hourly = hourly_grid(weather, series, numeric, ["condition_text"]).withColumn("seq", seq)
    assert hourly.count() == 14
    air = feeds.flatten_air(documents("air", [(1, {"list": [{"dt": start, "main": {"aqi": 5}, "components": {"co": 20.0}}]})]))
    quakes = feeds.flatten_quakes(documents("quakes", [(1, {"features": [
        {"id": "us1", "properties": {"title": "M5", "mag": 5.1, "time": start * 1000}, "geometry": {"coordinates": [73.0, 19.0, 1]}}]})]))
    hazards = feeds.flatten_hazards(documents("hazards", [(1, {"events": [hazard]})]))
    inputs = pipeline.Inputs(
        locations,
        hazards.withColumn("seq", F.lit(1)),
        quakes.withColumn("seq", F.lit(1)),
        hourly,
        air.withColumn("seq", F.lit(1)),
    )
    path = str(tmp_path / "tables")
    pipeline.refresh(inputs, path, 1)
    pipeline.refresh(inputs, path, 1)
    facts = pipeline.refreshed(spark, path)
    assert facts.count() == 14
    here = facts.where("location_id = 1").orderBy("timestamp").collect()
    assert (here[0]["hazard_types"], here[0]["hazard_count_100km"]) == ("Earthquakes,Wildfires", 2)
    assert here[0]["max_eq_magnitude"] == 5.1 and here[0]["aqi"] == 5 and here[4]["aqi"] is None
    # 30 wildfire + 25 near + 10 wind + 5 damp + 5 second hazard + 25 + 5 air + 10 quake
    assert here[0]["risk_score"] == 100 and here[6]["risk_score"] == 85
    assert here[0]["explanation_text"].startswith("Avoid outdoor activity today. A wildfires is within 4 km")
    away = facts.where("location_id = 2").first()
    assert away["hazard_count_100km"] == 0 and away["risk_score"] == 15 and away["confidence_score"] == 0.7
    assert tables.read_table(spark, f"{path}/explanations").count() == 14


def test_models(spark, risk, tmp_path):
    series = Series("location_id", "timestamp")
    models, metrics = forecast.train(risk, series, str(tmp_path / "work"))
    assert set(models) == set(HORIZONS)
    rows = {r["target"]: r for r in metrics.collect()}
    for target in HORIZONS:
        assert 0 <= rows[target]["mae"] <= rows[target]["rmse"] < 60
        share = rows[target]["n_test"] / (rows[target]["n_test"] + rows[target]["n_train"])
        assert 0.12 < share < 0.28
        assert rows[target]["mae"] < rows[target]["mean_mae"] and rows[target]["r2"] > 0
    forecast.save_models(models, str(tmp_path / "models"))
    loaded = forecast.load_models(str(tmp_path / "models"))
    predicted = forecast.predict(risk, loaded)
    assert predicted.columns == [*risk.columns, "predicted_risk_6h", "predicted_risk_12h"]
    assert predicted.where("predicted_risk_6h between 0 and 100").count() == risk.count()
    sparse = forecast.predict(risk.select(*KEYS, "temperature"), loaded)
    assert sparse.where("predicted_risk_12h is null").count() == 0
    same(sparse.select("temperature", *KEYS), risk.select("temperature", *KEYS))


def test_test_rows_are_told_by_arithmetic_on_their_key(spark, risk):
    def tested(place, at):
        seconds = int((at - datetime(1970, 1, 1)).total_seconds() // 1)
        return (place % 1000003 * 7919 + seconds % 1000003 * 104729 + 42) % 1000003 % 100 < 20

    rows = risk.select(*KEYS, forecast.is_test_row().alias("t")).collect()
    assert all(r["t"] == tested(r["location_id"], r["timestamp"]) for r in rows)
    odd = spark.createDataFrame([(-5, datetime(1950, 1, 1)), (None, datetime(2024, 1, 1)), (1, None)], "location_id long, timestamp timestamp_ntz")
    first, *others = [r["t"] for r in odd.select(forecast.is_test_row().alias("t")).collect()]
    assert first == tested(-5, datetime(1950, 1, 1)) and others == [False, False]


def test_too_few_rows_train_nothing(spark, risk, tmp_path):
    series = Series("location_id", "timestamp")
    models, metrics = forecast.train(risk.limit(9), series, str(tmp_path / "a"))
    assert models == {} and metrics is None
    one = risk.select("location_id").first()[0]
    few = risk.where(F.col("location_id") == one).orderBy("timestamp").limit(17)
    models, _ = forecast.train(few, series, str(tmp_path / "b"))
    assert set(models) == {"risk_6h"}


def test_error_measures(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "y double, p double")
    assert tuple(forecast.errors(df, "y", "p").first()) == (3, 0.667, 0.816, 0.571)


def test_model_inputs(spark):
    df = spark.createDataFrame([(None, float("nan"))], "temperature double, humidity double")
    row = forecast.model_inputs(df).first()
    assert all(row[name] == 0.0 for name in forecast.INPUTS)


def write_batch(spark, folder, number, rows):
    df = spark.createDataFrame(rows, "event_id string, seq long, title string")
    df.coalesce(1).write.mode("append").parquet(folder)


def test_stream_keeps_the_last_version_over_several_runs(spark, tmp_path):
    landing, path, state = (str(tmp_path / n) for n in ("landing", "rows", "state"))

    def run():
        stream = spark.readStream.schema("event_id string, seq long, title string").parquet(landing)
        streaming.upsert(stream, path, state, ["event_id"]).awaitTermination()
        rows = streaming.upserted(spark, path, ["event_id"]).collect()
        return {r["event_id"]: r["title"] for r in rows}

    write_batch(spark, landing, 0, [("a", 1, "first"), ("a", 3, "third"), ("b", 2, "b")])
    assert run() == {"a": "third", "b": "b"}
    write_batch(spark, landing, 1, [("a", 2, "late second"), ("b", 5, "new b"), ("c", 6, "c")])
    assert run() == {"a": "third", "b": "new b", "c": "c"}
    assert run() == {"a": "third", "b": "new b", "c": "c"}  # nothing new, nothing doubled
    target = str(tmp_path / "compact")
    streaming.compact(spark, path, target, ["event_id"])
    assert streaming.upserted(spark, target, ["event_id"]).count() == 3


ARRIVING = "kind string, id string, seq long, place long, ts timestamp_ntz, lat double, lon double, value double, state string"


def arrivals(batch):
    """Raw feeds out of one table of arrivals."""
    of = {name: batch.where(F.col("kind") == name) for name in streaming.FEEDS}
    time = F.col("ts").alias("timestamp")
    place = [F.col("lat").alias("latitude"), F.col("lon").alias("longitude")]
    return {
        "hazards": of["hazards"].select(
            F.col("id").alias("event_id"), "seq", F.lit("Floods").alias("category"), F.col("id").alias("title"),
            *place, F.col("ts").alias("event_timestamp"), F.col("state").alias("status"),
        ),
        "quakes": of["quakes"].select(
            "id", "seq", F.col("id").alias("title"), F.col("value").alias("magnitude"), F.lit(5.0).alias("depth_km"),
            *place, time, F.lit("open").alias("status"), F.lit("Earthquakes").alias("category"),
        ),
        "weather": of["weather"].select(
            F.col("place").alias("location_id"), "seq", F.col("ts").alias("forecast_timestamp"),
            *[F.col("value").alias(c) for c in ("temperature", "humidity", "wind_speed", "wind_direction", "precipitation", "pressure", "uv_index")],
            F.lit("Clear").alias("condition_text"),
        ),
        "air": of["air"].select(
            F.col("place").alias("location_id"), "seq", time, F.lit(3).alias("aqi"), F.col("value").alias("co"), F.col("value").alias("so2"),
        ),
    }


def weather_of(place, hours, seq=0):
    return [("weather", None, seq + h, place, datetime(2024, 1, 1, h), None, None, 10.0 + h, None) for h in hours]


def hazard_at(name, seq, lat, lon, state="open"):
    return ("hazards", name, seq, None, datetime(2024, 1, 1), lat, lon, None, state)


def test_refresh_recomputes_what_changed_and_no_more(spark, tmp_path):
    """Each step: what arrives, and the locations that it can change."""
    places = {1: (10.0, 10.0), 2: (10.3, 10.0), 3: (13.0, 10.0), 4: (-60.0, 179.99), 5: (-60.0, -179.99), 6: (40.0, -100.0), 7: (None, None)}
    locations = spark.createDataFrame(
        [(i, f"Place {i}", *at) for i, at in places.items()],
        "location_id long, location_name string, latitude double, longitude double",
    )
    everywhere = [row for place in places for row in weather_of(place, range(3))]
    steps = [
        ([*everywhere, hazard_at("a", 1, 10.1, 10.0), hazard_at("b", 1, 10.0, 20.0)], {1, 2, 3, 4, 5, 6, 7}),
        ([hazard_at("c", 2, 10.0, 10.001)], {1, 2}),  # in reach of two
        # In no one's reach, but nearer to the remote ones than any before.
        ([hazard_at("d", 3, 30.0, -100.0)], {4, 5, 6}),
        ([hazard_at("e", 4, -60.5, -179.9)], {4, 5}),  # across the antimeridian
        (weather_of(3, [5], 50), {3}),
        ([("air", None, 1, 2, datetime(2024, 1, 1, 1), None, None, 30.0, None)], {2}),
        ([hazard_at("c", 5, 13.1, 10.0)], {1, 2, 3}),  # moved: gone from two, new to one
        ([hazard_at("d", 6, 30.0, -100.0, "closed")], {6}),  # its nearest is gone
        ([hazard_at("a", 7, 10.1, 10.0)], set()),  # a new version that says the same
        ([hazard_at("x", 8, 95.0, 10.0)], set()),  # not on the globe
        ([hazard_at("b", 9, 10.0, 20.0, "closed")], set()),  # was no one's nearest any more
        ([("quakes", "q", 1, None, datetime(2024, 1, 1), 10.0, 10.2, 6.5, None)], {1, 2}),
        ([("quakes", "weak", 2, None, datetime(2024, 1, 1), 10.0, 10.2, 1.5, None)], set()),
        ([hazard_at(None, 10, 41.0, -100.0)], {6}),
        ([hazard_at(None, 11, 41.0, -101.0)], {6}),  # events without an id are one event
    ]
    landed, path, state = (str(tmp_path / n) for n in ("landed", "tables", "state"))
    schema = spark.createDataFrame([], ARRIVING).schema
    for number, (rows, wanted) in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(schema).parquet(landed)
        streaming.refresh_on_arrival(stream, arrivals, locations, path, state).awaitTermination()
        facts = tables.read_table(spark, f"{path}/fact_environment_risk")
        changed = {r[0] for r in facts.where(F.col("snapshot") == number).select("location_id").distinct().collect()}
        assert changed == wanted, number
    everything = arrivals(spark.read.schema(schema).parquet(landed))
    whole = features.risk_table(locations, *[everything[n] for n in streaming.FEEDS])
    facts = pipeline.refreshed(spark, path)
    columns = [c for c in features.FEATURES if c in facts.columns] + ["risk_score", "risk_band"]
    digits = {c: F.round(c, 6) for c, kind in whole.dtypes if kind == "double" and c in columns}
    same(facts.select(columns).withColumns(digits), whole.select(columns).withColumns(digits))
    same(pipeline.served(spark, path).select(columns), facts.select(columns))
    # A location's arrivals are read from its folder alone.
    kind = arrivals(spark.createDataFrame([], schema))["weather"].schema
    one = streaming._kept(spark, path, "weather", kind).where(F.col("location_bucket").isin([3]))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*location_bucket#\d+ = 3", plan)
    # Snapshots that no location needs are gone, with all that belongs to them.
    kept = {int(n.split("=")[1]) for n in os.listdir(f"{path}/fact_environment_risk") if "=" in n}
    assert kept == {r[0] for r in facts_newest(spark, path)}
    for table in ("explanations", "newest"):
        assert {int(n.split("=")[1]) for n in os.listdir(f"{path}/{table}") if "=" in n} == kept


def facts_newest(spark, path):
    table = tables.read_table(spark, f"{path}/fact_environment_risk")
    return table.groupBy("location_id").agg(F.max("snapshot")).select(F.col("max(snapshot)")).distinct().collect()


def test_purge(spark, tmp_path):
    path = str(tmp_path / "tables")
    for number, ids in ((1, [1, 2]), (2, [2]), (3, [1])):
        for table in ("fact_environment_risk", "explanations", "newest"):
            rows = spark.createDataFrame([(i,) for i in ids], "location_id long")
            rows.write.parquet(f"{path}/{table}/snapshot={number}")
    assert pipeline.purge(spark, path) == [1]
    assert pipeline.purge(spark, path) == []
    for table in ("fact_environment_risk", "explanations", "newest"):
        left = spark.read.parquet(f"{path}/{table}")
        assert sorted(map(tuple, left.select("snapshot", "location_id").collect())) == [(2, 2), (3, 1)]


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["location_id", "timestamp", "risk_score", "risk_band", "recommendation"]
    assert frame.count() > 0


def test_every_sql_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) == set(SQL)


# The whole list is compared by check_queries.py; these run here as well.
@pytest.mark.parametrize(
    "name", ["clean_hazards", "hazard_bands", "asof_air_quality", "hourly_resample", "risk_scores",
             "explanations", "place_lookup", "refresh_stream", "refreshed_risk", "bulk_row_scoring",
             "documents_to_facts", "rejected_documents", "chosen_explanations", "one_location_scan",
             "newest_snapshot", "forecast_quality", "forecast_rows", "stored_components", "target_distance"],
)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from check_queries import TABLES, compare

    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{os.path.join(FOLDER, table)}.parquet'")
    assert compare(queries()[name](spark, FOLDER), connection, oracle_sql()[name]).startswith("ok")


def test_measured_series_cover_both_feeds(spark):
    weather, air = feed(spark, FOLDER, "raw_weather"), feed(spark, FOLDER, "raw_air")
    series = features.weather_series(weather, air, Sizing(rows_per_task=10))
    assert series.cuts is not None and series.hot is not None
    assert measure_series(weather, "location_id", "forecast_timestamp", 10_000).cuts is None


def test_training_rows_are_dealt_evenly(spark):
    """A few files of unlike sizes become as many even tasks as can run, or as many as the rows need."""
    rows = spark.range(4000).select((F.col("id") % 40).alias("location_id"), F.col("id").alias("timestamp")).coalesce(1)
    for limit, least in ((10_000, spark.sparkContext.defaultParallelism), (200, 20)):
        dealt = forecast.dealt_evenly(rows, 4000, limit)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= least and sum(sizes) == 4000 and max(sizes) < 2 * 4000 / len(sizes)
