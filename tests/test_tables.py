import datetime as dt
import re

import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from sitehazard import schemas
from sitehazard.operators import serving
from sitehazard.plans import views
from sitehazard.sources import tables

PLACES = "location_id long, location_name string, latitude double, longitude double, city string, country string"


def places(spark):
    return spark.createDataFrame(
        [
            (1, "New York (City)", 40.7, -74.0, "New York", "USA"),
            (2, "Newport", 51.6, -3.0, "Newport", "UK"),
            (3, "Old Newton", 1.0, 2.0, "Newton", "UK"),
            (4, "Oslo", 59.9, 10.7, "Oslo", "Norway"),
        ],
        PLACES,
    )


def test_store_and_scan_one_location(spark, tmp_path):
    path = str(tmp_path / "places")
    tables.store(places(spark), path, 0)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    one = tables.scan_location(spark, path, "New York (City)")
    assert [r["location_id"] for r in one.collect()] == [1]
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(location_bucket#\d+\), \(location_bucket#\d+ = \d+\)\]", scan)
    assert re.search(r"PushedFilters: \[.*EqualTo\(location_hash,-?\d+\).*EqualTo\(location_slug,new_york_city\)", scan)
    assert tables.scan_location(spark, path, "Nowhere").count() == 0
    assert tables.scan_location(spark, path).count() == 4


def test_files_are_sorted_so_that_row_groups_can_be_skipped(spark, tmp_path):
    path = str(tmp_path / "many")
    rows = spark.range(6000).select("id", F.concat(F.lit("Site "), "id").alias("location_name"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        tables.store(rows, path, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = tables.read_table(spark, path)
    files = stored.inputFiles()
    assert len(files) > 256  # large buckets are split
    for file in files[::7]:
        hashes = parquet.read_table(file.removeprefix("file:"), columns=["location_hash"]).column(0).to_pylist()
        assert hashes == sorted(hashes)
    assert tables.scan_location(spark, path, "Site 4321").first()["id"] == 4321


@pytest.mark.parametrize("names, newest", [([9, 10, 2], 10), (["2024-01-09", "2024-01-10"], "2024-01-10"), (["a b", "a c"], "a c"), ([-3, -7], -3)])
def test_newest_snapshot_reads_its_folder_only(spark, tmp_path, names, newest):
    path = str(tmp_path / "daily")
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], ["i", "snapshot"])
    rows.write.partitionBy("snapshot").parquet(path)
    found = tables.newest_snapshot(spark, path)
    assert [r["i"] for r in found.collect()] == [names.index(newest)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(snapshot#\d+\), \(snapshot#\d+ = ", plan)
    assert found.count() == 1


def test_newest_first(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, d)) for d in (2, 9, 5)] + [(1, None)], "i int, timestamp timestamp")
    assert [r["timestamp"] and r["timestamp"].day for r in tables.newest_first(rows).collect()] == [9, 5, 2, None]


def test_newest_rows(spark):
    rows = spark.createDataFrame([(k, t) for k in (1, 2) for t in range(9 * k)], "k int, t int")
    got = sorted(map(tuple, tables.newest_rows(rows, "k", "t", 3).collect()))
    assert got == [(1, 6), (1, 7), (1, 8), (2, 15), (2, 16), (2, 17)]


def test_newest_rows_stay_where_they_are(spark):
    """Only keys and times are ranked: whole rows are neither moved nor sorted, unless some are tied at the cut."""

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rows = [(k, t, f"{k}-{t}") for k in (1, 2, None) for t in range(3 if k == 1 else 8)]
    few = spark.createDataFrame(rows, "k int, t int, text string")
    for most, left in ((8, 19), (5, 13), (3, 9)):
        newest = tables.newest_rows(few, "k", "t", most)
        assert newest.columns == few.columns and newest.count() == left
        assert not re.search(r"Exchange hashpartitioning|Window|Sort", plan(newest))
    want = [(k, t) for k in (1, 2, None) for t in ((0, 1, 2) if k == 1 else (5, 6, 7))]
    key = lambda row: (row[0] or 0, row[1])
    assert sorted(((r["k"], r["t"]) for r in newest.collect()), key=key) == sorted(want, key=key)
    assert sorted(((r["k"], r["t"]) for r in tables.newest_rows(few, "k", "t", 3, limit=1).collect()), key=key) == sorted(want, key=key)


def test_newest_rows_tied_or_without_time(spark):
    rows = [(1, 9), (1, 7), (1, 7), (1, 7), (2, 4), (2, None), (2, None), (2, None), (3, None), (4, 1), (4, 2)]
    newest = tables.newest_rows(spark.createDataFrame(rows, "k int, t int"), "k", "t", 2)
    got = sorted(((r["k"], r["t"]) for r in newest.collect()), key=lambda row: (row[0], row[1] or 0))
    assert got == [(1, 7), (1, 9), (2, None), (2, 4), (3, None), (4, 1), (4, 2)]


def test_rows_are_finished_after_they_are_laid_out(spark, tmp_path):
    """What ``finish`` adds is stored with the rows, in the same layout as without it."""
    path = str(tmp_path / "places")

    def finish(laid):
        assert "Sort [location_bucket" in laid._jdf.queryExecution().optimizedPlan().toString()
        return laid.withColumn("text", F.concat(F.lit("At "), "location_name"))

    tables.store(places(spark), path, 0, finish=finish)
    stored = tables.read_table(spark, path)
    assert stored.where("text = concat('At ', location_name)").count() == 4
    tables.store(places(spark), path, 1)
    where = ["location_id", "location_slug", "location_hash", "location_bucket"]
    plain = spark.read.parquet(path).where("snapshot = 1").select(*where)
    assert sorted(map(tuple, stored.select(*where).collect())) == sorted(map(tuple, plain.collect()))


def test_storing_a_snapshot_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "places")
    tables.store(places(spark), path, 0)
    tables.store(places(spark).where("location_id < 3"), path, 0)
    assert tables.read_table(spark, path).count() == 2


def test_each_key_reads_its_newest_snapshot(spark, tmp_path):
    path = str(tmp_path / "places")
    tables.store(places(spark), path, 1)
    changed = places(spark).where("location_id = 2").withColumn("city", F.lit("Casnewydd"))
    tables.store(changed, path, 2)
    stored = tables.read_table(spark, path)
    per_key = {r["location_id"]: r["city"] for r in tables.latest_snapshot(stored, "location_id").collect()}
    assert per_key == {1: "New York", 2: "Casnewydd", 3: "Newton", 4: "Oslo"}
    assert [r["location_id"] for r in tables.latest_snapshot(stored).collect()] == [2]


def test_load_replaces_rows_but_not_by_nothing(spark, tmp_path):
    path = str(tmp_path / "weather")
    rows = spark.createDataFrame([(1, 20.0), (2, 21.0)], "location_id long, temperature double")
    assert tables.load(rows, path, "raw_weather") == 2
    assert tables.load(rows.where("location_id = 2"), path, "raw_weather") == 1
    assert tables.load(rows.where("false"), path, "raw_weather") == 0
    stored = tables.read_table(spark, path)
    assert stored.columns == [f.name for f in schemas.table_schema("raw_weather").fields]
    assert not tables.exists(spark, f"{path}.loading")
    row = stored.first()
    assert row["source_name"] == "openweathermap" and row["temperature"] == 21.0
    assert row["ingestion_ts"] is not None and row["wind_gust"] is None


def test_enrich_keeps_an_existing_location(spark):
    df = spark.createDataFrame([(9, 1.0)], "location_id long, x double")
    assert tables.enrich(df).first()["location_id"] == 9
    assert tables.enrich(df.drop("location_id"), "sensor").first()["source_name"] == "sensor"


def test_schemas(spark):
    assert len(schemas.table_schema("fact_environment_risk").fields) == 46
    df = spark.createDataFrame([("3", 5)], "hazard_count_10km string, extra int")
    aligned = schemas.align_to_table(df, "fact_environment_risk")
    assert aligned.schema["hazard_count_10km"].dataType.simpleString() == "int"
    row = aligned.first()
    assert (row["hazard_count_10km"], row["hazard_count_50km"], row["confidence_score"]) == (3, 0, 0.8)
    assert "extra" not in aligned.columns
    migrated = schemas.add_missing_columns(df, "fact_environment_risk")
    assert migrated.columns[:2] == ["hazard_count_10km", "extra"] and migrated.first()["component_air_quality"] == 0


def test_seed_is_inserted_once(spark):
    seed = places(spark).limit(1).withColumn("location_id", F.lit(5).cast("long"))
    once = tables.insert_missing(places(spark), seed)
    assert once.count() == 5 and tables.insert_missing(once, seed).count() == 5


def test_refresh_times(spark, tmp_path):
    path = str(tmp_path / "places")
    tables.store(places(spark), path, 0)
    times = {r["location_slug"]: r for r in tables.last_refresh(spark, path).collect()}
    assert set(times) == {"new_york_city", "newport", "old_newton", "oslo"}
    assert times["oslo"]["formatted"] == times["oslo"]["at"].strftime("%Y-%m-%d %H:%M UTC")


def lookup(spark, *texts, **options):
    requests = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "request int, text string")
    found = {}
    for r in serving.place_lookup(requests, places(spark), **options).collect():
        found.setdefault(r["text"], {})[r["rank"]] = r["place_name"]
    return {k: [v[i] for i in sorted(v)] for k, v in found.items()}


def test_place_lookup(spark):
    got = lookup(spark, " new", "N", "OSLO", "newport", "x", "newton", "nowhere")
    assert got[" new"] == ["New York (City)", "Newport", "Old Newton"]
    assert got["OSLO"] == ["Oslo"] and got["newport"] == ["Newport"] and got["newton"] == ["Old Newton"]
    assert set(got) == {" new", "OSLO", "newport", "newton"}
    assert lookup(spark, "ne", limit=2) == {"ne": ["New York (City)", "Newport"]}


def test_requested_locations(spark):
    rows = [(1, "19.0", "72.5", None), (2, "1", "2", "Here"), (3, None, "2", "x"), (4, "0", "0", "")]
    rows += [(5, "abc", "2", "x"), (6, "", "2", "x"), (7, "1", " ", "x")]
    requests = spark.createDataFrame(rows, "i int, lat string, lon string, name string")
    got = {r["i"]: (r["name"], r["latitude"], r["longitude"]) for r in serving.requested_locations(requests).collect()}
    assert got == {1: ("19.0, 72.5", 19.0, 72.5), 2: ("Here", 1.0, 2.0), 4: ("0, 0", 0.0, 0.0)}


RISK = """location_id long, timestamp timestamp, risk_score double, risk_band string, recommendation string,
    predicted_risk_6h double, predicted_risk_12h double"""


def risk(spark, hours=60):
    start = dt.datetime(2024, 1, 1)
    rows = [
        (place, start + dt.timedelta(hours=h), float(h), "Safe", "Go now", 10.0 * place, 15.04)
        for place in (1, 2)
        for h in range(hours - place)
    ]
    return spark.createDataFrame(rows, RISK)


def test_current_forecast_and_metrics(spark):
    current = {r["location_id"]: r["risk_score"] for r in serving.current_risk(risk(spark)).collect()}
    assert current == {1: 58.0, 2: 57.0}
    last = serving.forecast_series(risk(spark)).groupBy("location_id").agg(F.count("*"), F.min("risk_score"))
    assert sorted(map(tuple, last.collect())) == [(1, 48, 11.0), (2, 48, 10.0)]
    trends = {r["location_id"]: tuple(r)[1:] for r in serving.forecast_metrics(risk(spark)).collect()}
    assert trends == {1: (10.0, 15.0, "worsening"), 2: (20.0, 15.0, "improving")}


def test_views(spark):
    facts = schemas.align_to_table(risk(spark), "fact_environment_risk")
    places_dim = schemas.align_to_table(places(spark), "dim_location")
    events = spark.createDataFrame(
        [("a", "F", "t", "open", None, 1.0, 2.0), ("b", "F", "t", "unknown", None, 1.0, 2.0)],
        schemas.table_schema("raw_hazards"),
    )
    views.register(spark, facts, places_dim, events)
    newest = tables.query(spark, "SELECT * FROM v_current_risk").collect()
    assert [r["location_name"] for r in newest] == ["New York (City)"]
    assert tables.query(spark, "SELECT event_id FROM v_active_hazards").first()["event_id"] == "a"
    times = [r["timestamp"] for r in tables.query(spark, "SELECT * FROM v_risk_trend").collect()]
    assert times == sorted(times) and len(times) == 117


def test_summaries(spark):
    scored = spark.createDataFrame([("Safe", 10.04), ("Safe", 20.0), ("Avoid", 90.0)], "risk_band string, risk_score double")
    assert [tuple(r) for r in serving.band_histogram(scored).collect()] == [("Safe", 2), ("Avoid", 1)]
    assert tuple(serving.risk_summary(scored).first()) == (40.0, 10.0, 90.0)
    counts = serving.source_counts({"a": scored, "b": scored.limit(1)}).collect()
    assert {r["source"]: r["rows"] for r in counts} == {"a": 3, "b": 1}


def test_has_data(spark):
    got = serving.locations_with_data(places(spark), risk(spark)).collect()
    assert {r["location_id"]: r["has_data"] for r in got} == {1: True, 2: True, 3: False, 4: False}


@pytest.mark.parametrize("missing", [True, False])
def test_risk_card_names_missing_parts(spark, missing):
    schema = RISK + ", nearest_hazard_distance_km double, nearest_hazard_type string, hazard_count_10km int, component_trend double"
    row = (1, dt.datetime(2024, 1, 1), None if missing else 75.0, None if missing else "Avoid", None, None, None,
           float("nan") if missing else 3.0, None, None, None)
    card = serving.risk_card(spark.createDataFrame([row], schema)).first()
    assert card["recommendation"] == "Check conditions" and card["nearest_hazard_type"] == "None"
    assert card["hazard_count_10km"] == 0 and card["component_trend"] == 0
    if missing:
        assert (card["score"], card["band"], card["emoji"], card["color"]) == (0.0, "Unknown", "?", "green")
        assert card["nearest_hazard_distance_km"] is None
    else:
        assert (card["score"], card["emoji"], card["color"]) == (75.0, "Avoid", "red")
