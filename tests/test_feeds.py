import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from sitehazard.config import Sizing
from sitehazard.operators import cleaning
from sitehazard.plans import documents as plans
from sitehazard.sources import feeds

HAZARDS = """event_id string, category string, title string, latitude double, longitude double,
    event_timestamp string, status string, seq long"""


def documents(spark, feed, docs, **beside):
    text = [(json.dumps(d), *beside.values()) for d in docs]
    df = spark.createDataFrame(text, ["document", *beside]) if beside else spark.createDataFrame(text, "document string")
    return feeds.parse_documents(df, feed)


def event(**changes):
    """A landslide that moved once, far down the valley."""
    track = [("2022-05-17T09:10:11Z", 11.25, 46.5), ("2022-05-18T06:30:00Z", 11.5, 46.75)]
    full = {
        "status": "closed",
        "id": "slide-7",
        "geometry": [{"date": day, "coordinates": [east, north]} for day, east, north in track],
        "title": "Slope above the road",
        "categories": [{"title": "Landslides"}, {"title": "Floods"}],
    }
    return {k: v for k, v in (full | changes).items() if v is not None}


def test_hazard_document(spark):
    docs = [{"events": [event()]}]
    row = feeds.flatten_hazards(documents(spark, "hazards", docs)).first()
    assert (row["event_id"], row["category"], row["status"]) == ("slide-7", "Landslides", "open")
    assert (row["latitude"], row["longitude"]) == (46.75, 11.5)
    assert row["event_timestamp"] == dt.datetime(2022, 5, 18, 6, 30)


def test_hazards_without_a_position_are_left_out(spark):
    docs = [
        {"events": [event(geometry=[]), event(geometry=None)]},
        {"events": [event(geometry=[{"date": "2024-01-01T00:00:00Z", "coordinates": [1]}])]},
        {"events": [event(geometry=[{"date": "x", "coordinates": [1, 2, 3]}])]},
        {"events": []},
        {},
    ]
    assert feeds.flatten_hazards(documents(spark, "hazards", docs)).count() == 0


def test_hazard_defaults(spark):
    docs = [{"events": [event(title=None, categories=[]), event(categories=None), event(categories=[{}]),
                        event(geometry=[{"coordinates": [1, 2]}])]}]
    rows = feeds.flatten_hazards(documents(spark, "hazards", docs)).collect()
    assert [r["category"] for r in rows] == ["Unknown"] * 3 + ["Landslides"]
    assert rows[0]["title"] == "" and rows[3]["event_timestamp"] is None


def reading(**changes):
    """A squall on the evening of 3 March 2023."""
    full = {
        "dt": 1677866400,
        "wind": {"deg": 285, "speed": 7.75},
        "weather": [{"description": "thunderstorm with hail"}, {"description": "mist"}],
        "main": {"pressure": 987.5, "temp": -3.5, "humidity": 91},
    }
    return full | changes


def test_forecast_document(spark):
    wet = reading(dt=1677877200, rain={"3h": 3.25}, snow={"3h": 0.25}, wind={"speed": 2.0, "gust": 19.5}, weather=[])
    parsed = documents(spark, "forecast", [{"list": [reading(), wet], "cnt": 2}, {"list": []}],
                       location_id=7, latitude=-33.5, longitude=151.25)
    first, second = feeds.flatten_forecast(parsed).orderBy("forecast_timestamp").collect()
    assert first["forecast_timestamp"] == dt.datetime(2023, 3, 3, 18) and first["location_id"] == 7
    assert (first["temperature"], first["humidity"], first["wind_speed"]) == (-3.5, 91.0, 7.75)
    assert (first["wind_direction"], first["wind_gust"], first["precipitation"]) == (285.0, 0.0, 0.0)
    assert first["condition_text"] == "Thunderstorm With Hail"
    assert (second["precipitation"], second["wind_direction"], second["wind_gust"]) == (3.5, 0.0, 19.5)
    assert second["condition_text"] == "Clear" and second["uv_index"] >= 0


def test_current_conditions_stand_in_for_an_empty_forecast(spark):
    schema = {"location_id": 1, "latitude": 0.0, "longitude": 0.0}
    forecast = feeds.flatten_forecast(documents(spark, "forecast", [{"list": [reading()]}], **schema))
    current = documents(spark, "current", [reading(), reading()], **schema)
    numbered = current.withColumn("location_id", F.monotonically_increasing_id() % 2 + 1).dropDuplicates(["location_id"])
    both = feeds.fall_back_to_current(forecast, feeds.flatten_current(numbered))
    rows = {r["location_id"]: r for r in both.collect()}
    assert 1 in rows and rows[1]["precipitation"] == 0.0
    assert both.where("location_id = 1").count() == 1


def test_uv_index_by_hand(spark):
    from sitehazard.functions.solar import uv_index

    def by_hand(lat, lon, at):
        declination = math.radians(23.44 * math.sin(math.radians(284 + at.timetuple().tm_yday) * 360 / 365))
        turn = math.radians(15 * (at.hour + at.minute / 60 + lon / 15 - 12))
        height = math.sin(math.radians(lat)) * math.sin(declination) + math.cos(math.radians(lat)) * math.cos(declination) * math.cos(turn)
        if height <= 0:
            return 0.0
        peak = 12 if abs(lat) < 15 else 10 if abs(lat) < 30 else 7 if abs(lat) < 45 else 4
        return peak * height**1.3

    places = [(0.0, 0.0), (-14.9, 30.0), (20.0, 72.0), (44.0, -70.0), (-60.0, 170.0)]
    times = [dt.datetime(2024, m, 15, h, 30) for m in (1, 6) for h in (0, 6, 12, 18)]
    rows = [(lat, lon, at) for lat, lon in places for at in times]
    df = spark.createDataFrame(rows, "lat double, lon double, at timestamp_ntz")
    out = df.withColumn("uv", uv_index(F.col("lat"), F.col("lon"), F.col("at"))).collect()
    assert any(r["uv"] > 0 for r in out) and any(r["uv"] == 0 for r in out)
    for r in out:
        assert r["uv"] == pytest.approx(by_hand(r["lat"], r["lon"], r["at"]), abs=0.0501)


def test_air_document(spark):
    docs = [{"list": [{"dt": 1704067200, "main": {"aqi": 2}, "components": {"co": 200.5, "pm2_5": 3.0}},
                      {"dt": 1704070800, "main": {"aqi": 9}, "components": {}}]}]
    first, second = feeds.flatten_air(documents(spark, "air", docs, location_id=3)).orderBy("timestamp").collect()
    assert (first["aqi"], first["aqi_label"], first["co"], first["pm2_5"], first["nh3"]) == (2, "Fair", 200.5, 3.0, 0.0)
    assert (second["aqi_label"], second["so2"]) == ("Unknown", 0.0)


def test_quake_document(spark):
    docs = [{"features": [
        {"id": "us1", "properties": {"title": "M 4", "mag": 4.2, "time": 1704067200123},
         "geometry": {"coordinates": [72.0, 19.0, 10.5]}},
        {"id": "us2", "properties": {"mag": None, "time": 0}, "geometry": {"coordinates": [1.0, 2.0]}},
    ]}]
    first, second = feeds.flatten_quakes(documents(spark, "quakes", docs)).orderBy("id").collect()
    assert (first["latitude"], first["longitude"], first["depth_km"]) == (19.0, 72.0, 10.5)
    assert first["timestamp"] == dt.datetime(2024, 1, 1, 0, 0, 0, 123000)
    assert (second["title"], second["magnitude"], second["depth_km"]) == ("Earthquake", None, 0.0)
    assert second["category"] == "Earthquakes" and second["status"] == "open"


def test_landed_files_and_unreadable_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"events": [event()]}) + "\nnot json\n")
    read = feeds.read_documents(spark, "hazards", str(tmp_path))
    assert feeds.flatten_hazards(read).count() == 1


def test_documents_are_read_or_rejected_with_a_reason(spark):
    texts = [json.dumps({"list": [reading()]}), '{"list": [{"dt": 5, "ma', None, "  ", "[1, 2", "{}", '{"list": []}',
             json.dumps({"list": [reading(dt="noon")]}), json.dumps({"list": [reading()], "more": {"x": 1}})]
    landed = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "location_id long, seq long, document string")
    good, bad = feeds.opened(landed, "forecast")
    assert sorted(r["location_id"] for r in good.collect()) == [0, 5, 6, 8]
    reasons = {r["location_id"]: (r["reason"], r["document"]) for r in bad.collect()}
    assert {k: v[0] for k, v in reasons.items()} == {1: "malformed", 2: "missing", 3: "missing", 4: "malformed", 7: "malformed"}
    assert reasons[1][1] == texts[1] and good.columns == ["location_id", "seq", "list"]


@pytest.mark.parametrize("sizing", [Sizing(), Sizing(rows_per_task=2)])
def test_weather_from_documents(spark, sizing):
    """Overlapping forecasts, an empty one, a broken one, several current conditions."""
    start = 1677866400
    def forecast(*hours, temp=0.0):
        return json.dumps({"list": [reading(dt=start + 3600 * h, main={"temp": temp + h, "humidity": 50, "pressure": 1000}) for h in hours]})

    def current(hour, temp):
        return json.dumps(reading(dt=start + 60 * hour, main={"temp": temp, "humidity": 40, "pressure": 990}))

    forecasts = [(1, 1, forecast(0, 3, 6)), (1, 2, forecast(3, 9, temp=30.0)), (2, 3, '{"list": []}'), (3, 4, forecast(0)[:-5]), (9, 5, forecast(0))]
    currents = [(i, n, current(n, 10.0 * n)) for i in (1, 2, 3) for n in (7, 8)] + [(4, 1, None)]
    places = spark.createDataFrame([(i, 10.0 * i, 5.0) for i in range(1, 5)], "location_id long, latitude double, longitude double")
    schema = "location_id long, seq long, document string"
    found = plans.weather(spark.createDataFrame(forecasts, schema), spark.createDataFrame(currents, schema), places, sizing)
    rows = {}
    for r in found.rows.collect():
        rows.setdefault(r["location_id"], []).append(r)
    assert set(rows) == {1, 2, 3}
    hours = sorted(rows[1], key=lambda r: r["forecast_timestamp"])
    assert [r["temperature"] for r in hours] == [0, 11, 22, 33, 24, 15, 6, 17, 28, 39]  # 0, 33, 6 and 39 given
    assert all(r["source_name"] == "openweathermap" and r["ingestion_ts"] is not None for r in hours)
    for place in (2, 3):
        (row,) = rows[place]
        assert (row["temperature"], row["precipitation"]) == (80.0, 0.0)
        assert row["forecast_timestamp"] == dt.datetime(2023, 3, 3, 18, 8)
    rejected = sorted((r["feed"], r["location_id"], r["reason"]) for r in found.rejected.collect())
    assert rejected == [("current", 4, "missing"), ("forecast", 3, "malformed")]


def hazards(spark, rows):
    return spark.createDataFrame(rows, HAZARDS)


def test_clean_hazards(spark):
    df = hazards(spark, [
        ("a", "Wildfires", "Fire 1", 19.0, 72.0, "2024-01-01", "open", 1),
        ("a", "Wildfires", "Fire 2", 19.0, 72.0, "2024-01-01T05:00:00Z", "open", 2),
        ("b", "Floods", "Flood 1", 20.0, 73.0, "2024-01-02", "open", 3),
        (None, "Floods", "x", 20.0, 73.0, "nonsense", "open", 4),
        (None, "Floods", "y", 20.0, 73.0, "nonsense", "open", 5),
    ])
    rows = cleaning.clean_hazards(df).orderBy("seq").collect()
    assert [r["title"] for r in rows] == ["Fire 2", "Flood 1", "y"]
    assert rows[0]["event_timestamp"] == dt.datetime(2024, 1, 1, 5)
    assert rows[2]["event_timestamp"] is None


def test_last_version_decides_before_coordinates_are_checked(spark):
    df = hazards(spark, [
        ("a", "Wildfires", "good", 19.0, 72.0, "2024-01-01", "open", 1),
        ("a", "Wildfires", "bad", 200.0, 72.0, "2024-01-01", "open", 2),
        ("b", "Floods", "good", 19.0, 72.0, "2024-01-01", "open", 3),
    ])
    assert [r["event_id"] for r in cleaning.clean_hazards(df).collect()] == ["b"]


def test_cleaners_pass_tables_lacking_columns(spark):
    df = spark.createDataFrame([("a", 200.0)], "event_id string, latitude double")
    assert cleaning.clean_hazards(df) is df and cleaning.clean_weather(df) is df
    assert not cleaning.has_columns(df, cleaning.HAZARD_COLUMNS)


def test_clean_weather(spark):
    df = spark.createDataFrame(
        [
            (1, 1, "2024-01-01 00:00", 25.0, 60.0, 15.0, None),
            (1, 2, "2024-01-01 01:00", math.nan, 70.0, 20.0, 1012.0),
            (1, 3, "2024-01-01 01:00", None, 71.0, 21.0, None),
            (2, 4, "2024-01-01 01:00", 3.0, None, None, 1.0),
            (2, 5, "never", 3.0, None, None, 1.0),
        ],
        "location_id long, seq long, forecast_timestamp string, temperature double, humidity double, "
        "wind_speed double, pressure double",
    )
    rows = cleaning.clean_weather(df).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == [1, 3, 4]
    assert [r["temperature"] for r in rows] == [25.0, 25.0, 3.0]
    assert [r["pressure"] for r in rows] == [1013.0, 1013.0, 1.0]
    assert rows[2]["humidity"] == 50.0 and rows[2]["wind_speed"] == 0.0
    assert "uv_index" not in rows[0]


def test_valid_coordinates(spark):
    df = spark.createDataFrame(
        [(19.0, 72.0), (91.0, 73.0), (-100.0, 74.0), (0.0, 200.0), (None, 1.0), (math.nan, 1.0), (90.0, -180.0), (0.0, 0.0)],
        "latitude double, longitude double",
    )
    got = sorted((r[0], r[1]) for r in cleaning.valid_coordinates(df).collect())
    assert got == [(0.0, 0.0), (19.0, 72.0), (90.0, -180.0)]


def test_quality_report(spark):
    df = hazards(spark, [
        ("a", "F", "t", 1.0, 1.0, None, "open", 1), ("a", "F", "t", 1.0, 1.0, None, "open", 2),
        ("b", "F", "t", 99.0, 1.0, None, "open", 3), ("c", "F", "t", None, 1.0, None, "open", 4),
    ])
    row = cleaning.hazard_quality(df).first()
    assert tuple(row) == (4, 1, 2, 1)
    assert tuple(cleaning.hazard_quality(df.where("false")).first()) == (0, 0, 0, 0)


def test_hot_copies_are_reduced_before_the_shuffle(spark):
    df = hazards(spark, [("a", "F", "t", 1.0, 1.0, None, "open", 1)])
    plan = cleaning.keep_last(df, ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Partial") > plan.index("Exchange") and "WindowGroupLimit" in plan


def test_hours_are_dealt_to_tasks_by_their_number(spark):
    """Readings days apart become many hours; the grid's tasks are as many as these need, not the readings."""
    text = lambda place: json.dumps({"list": [{"dt": 1704067200 + 3600 * hour, "main": {"temp": float(place)}} for hour in (0, 40)]})
    forecasts = spark.createDataFrame([(i, i, text(i)) for i in range(30)], "location_id long, seq long, document string")
    currents = forecasts.where("false")
    places = spark.createDataFrame([(i, 1.0, 2.0) for i in range(30)], "location_id long, latitude double, longitude double")
    rows = plans.weather(forecasts, currents, places, Sizing(rows_per_task=60)).rows
    assert rows.count() == 30 * 41 and rows.where("temperature <> location_id").isEmpty()
    assert rows.rdd.getNumPartitions() >= 30 * 41 / 60
