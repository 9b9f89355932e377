"""Grid answers against brute force, on the globe's awkward places and under forced refinement."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitehazard.config import Sizing
from sitehazard.functions.geo import haversine_km, wind_alignment
from sitehazard.operators import changes, grid, spatial

SETTINGS = [
    Sizing(),
    Sizing(points_per_cell=3),
    Sizing(rows_per_task=7, points_per_cell=5),
]
KINDS = ["Wildfires", "Floods", "Droughts"]


def km(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(
        math.radians(lon2 - lon1) / 2
    ) ** 2
    return 6371.0 * 2 * math.asin(min(1.0, math.sqrt(a)))


def world(seed):
    """Sites and hazards: spread out, crowded, at the poles, on both sides of 180°."""
    dice = random.Random(seed)
    spots = [(dice.uniform(-90, 90), dice.uniform(-180, 180)) for _ in range(40)]
    spots += [(19 + dice.uniform(-1, 1), 73 + dice.uniform(-1, 1)) for _ in range(80)]
    spots += [(19.05, 72.85)] * 30
    spots += [(dice.choice([90.0, -90.0, 89.9, -89.6]), dice.uniform(-180, 180)) for _ in range(12)]
    spots += [(dice.uniform(-2, 2), dice.choice([179.9, -179.9, 180.0, -180.0])) for _ in range(12)]
    dice.shuffle(spots)
    return spots


def tables(spark, seed=1):
    sites = [(i, lat, lon) for i, (lat, lon) in enumerate(world(seed))]
    hazards = [
        (i, f"EV_{i:03d}", KINDS[i % 3], f"T{i}", lat, lon, float(i % 7))
        for i, (lat, lon) in enumerate(world(seed + 100))
    ]
    locations = spark.createDataFrame(sites, "location_id long, latitude double, longitude double")
    events = spark.createDataFrame(
        hazards,
        "seq long, event_id string, category string, title string, latitude double, "
        "longitude double, magnitude double",
    )
    return sites, hazards, locations, events


@pytest.mark.parametrize("sizing", SETTINGS)
def test_changed_spots_reach_the_locations_whose_profile_they_can_alter(spark, sizing):
    sites, _, locations, events = tables(spark)
    old = spatial.hazard_profile(locations, events.where("seq % 9 > 1"), sizing=sizing)
    new = spatial.hazard_profile(locations, events.where("seq % 9 <> 2"), sizing=sizing)
    altered = {r["location_id"] for r in new.exceptAll(old).collect()}
    changed = changes.changed_spots(*(
        events.where(c).withColumn("feed", F.lit(0)) for c in ("seq % 9 > 1", "seq % 9 <> 2")
    ))
    wanted = {(lat, lon) for i, (lat, lon) in enumerate(world(101)) if i % 9 < 3}
    spots = [tuple(r) for r in changed.collect()]
    assert set(spots) <= wanted and len(spots) == len(set(spots))
    so_far = {r["location_id"]: r["nearest_hazard_distance_km"] for r in old.collect()}
    reach = {i: min((km(lat, lon, *s) for s in spots)) for i, lat, lon in sites}
    expected = {i for i in reach if reach[i] <= max(100.0, so_far[i] + 0.01)}
    found = {r["location_id"] for r in changes.reached(old, changed, sizing=sizing).collect()}
    assert found == expected and altered <= found and len(altered) > 20 and len(found) < len(sites)


def test_haversine(spark):
    pairs = [(19.076, 72.8777, 19.076, 72.8777), (19.076, 72.8777, 19.176, 72.8777), (10.0, 20.0, -10.0, -160.0)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(haversine_km(*"abcd")).collect()]
    assert got[0] == 0.0 and 10 < got[1] < 12
    assert got[2] == pytest.approx(math.pi * 6371.0)


def test_wind_alignment(spark):
    rows = [(0.0, 1.0, 0.0), (0.0, 1.0, 180.0), (1.0, 0.0, 90.0), (0.0, 1.0, -360.0), (0.0, 1.0, 270.0),
            (0.0, 1.0, None), (0.0, 1.0, math.nan), (None, None, 10.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, w double")
    score = wind_alignment(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0), F.col("w"))
    got = [r["v"] for r in df.select("i", score.alias("v")).orderBy("i").collect()]
    assert got == pytest.approx([1.0, 0.0, 1.0, 1.0, 0.5, 0.0, 0.0, 0.0])


def test_cells_nest(spark):
    df = spark.createDataFrame(world(5), "lat double, lon double")
    for size, larger in zip(grid.SIZES[1:], grid.SIZES):
        both = df.select(
            grid.cell_of("lat", "lon", size).alias("child"), grid.cell_of("lat", "lon", larger).alias("parent")
        )
        assert both.where(grid.parent_of("child", size, larger) != F.col("parent")).count() == 0


@pytest.mark.parametrize("sizing", SETTINGS)
def test_profile_equals_brute_force(spark, sizing):
    sites, hazards, locations, events = tables(spark)
    got = {r["location_id"]: r for r in spatial.hazard_profile(locations, events, sizing=sizing).collect()}
    assert len(got) == len(sites)
    for i, lat, lon in sites:
        far = [(km(h[4], h[5], lat, lon), h) for h in hazards]
        row = got[i]
        for band in (10, 50, 100):
            assert row[f"hazard_count_{band}km"] == sum(d <= band for d, _ in far)
        nearest = min(d for d, _ in far)
        assert row["nearest_hazard_distance_km"] == pytest.approx(nearest, abs=0.0051)
        tied = sorted((h[0], h[2], h[4:6]) for d, h in far if d - nearest < 1e-6)
        if len({t[2] for t in tied}) == 1:  # copies of one point: the first of them
            tied = tied[:1]
        assert row["nearest_hazard_type"] in {t[1] for t in tied}
        assert row["hazard_types"] == ",".join(sorted({h[2] for d, h in far if d <= 100}))
        assert row["max_eq_magnitude"] == max([h[6] for d, h in far if d <= 100], default=0.0)


@pytest.mark.parametrize("sizing", SETTINGS)
@pytest.mark.parametrize("k", [1, 7])
def test_nearest_k_equals_brute_force(spark, sizing, k):
    sites, hazards, locations, events = tables(spark, 2)
    got = {}
    for r in spatial.nearest_hazards(locations, events, k, sizing).collect():
        got.setdefault(r["location_id"], []).append((r["distance_km"], r["id"]))
    for i, lat, lon in sites:
        want = sorted((math.floor(km(h[4], h[5], lat, lon) * 10 + 0.5) / 10, h[1]) for h in hazards)[:k]
        found = sorted(got[i])
        assert [e for _, e in found] == [e for _, e in want]
        assert [d for d, _ in found] == pytest.approx([d for d, _ in want])


@pytest.mark.parametrize("sizing", SETTINGS)
def test_newest_in_reach_equals_brute_force(spark, sizing):
    sites, hazards, locations, events = tables(spark, 3)
    quakes = events.select(
        F.col("event_id").alias("id"), "title", "magnitude", "latitude", "longitude",
        F.timestamp_seconds((F.col("seq") * 37) % 50).alias("timestamp"),
    )
    got = {}
    for r in spatial.quakes_near(locations, quakes, 300.0, 2.5, 4, sizing).collect():
        got.setdefault(r["location_id"], set()).add(r["id"])
    for i, lat, lon in sites:
        near = [h for h in hazards if h[6] >= 2.5 and km(h[4], h[5], lat, lon) <= 300]
        want = {h[1] for h in sorted(near, key=lambda h: (-((h[0] * 37) % 50), h[1]))[:4]}
        assert got.get(i, set()) == want


def test_no_hazards(spark):
    _, _, locations, events = tables(spark)
    row = spatial.hazard_profile(locations, events.where("false")).first()
    assert row["hazard_count_100km"] == 0 and row["hazard_types"] == ""
    assert row["nearest_hazard_distance_km"] is None and row["nearest_hazard_type"] is None


def test_counts_use_exact_and_proximity_rounded_distance(spark):
    north = math.degrees(10.004 / 6371.0)
    locations = spark.createDataFrame([(1, 0.0, 0.0)], "location_id long, latitude double, longitude double")
    hazards = spark.createDataFrame([(1, None, north, 0.0)], "seq long, category string, latitude double, longitude double")
    row = spatial.hazard_profile(locations, hazards).first()
    assert row["hazard_count_10km"] == 0 and row["nearest_hazard_distance_km"] == 10.0
    assert row["nearest_hazard_type"] == "Unknown"


def test_map_merges_quakes_and_leaves_out_placeholders(spark):
    locations = spark.createDataFrame([(1, 0.0, 0.0)], "location_id long, latitude double, longitude double")
    events = spark.createDataFrame(
        [("a", "Floods", "A", 0.0, 0.5), ("b", "Floods", "B", 0.0, 2.0)],
        "event_id string, category string, title string, latitude double, longitude double",
    )
    quakes = spark.createDataFrame(
        [("mock_eq_1", "M", 0.0, 0.1), ("us1", "Q", 0.0, 0.5), ("us2", "R", 0.0, 1.0), (None, "N", 0.0, 9.0)],
        "id string, title string, latitude double, longitude double",
    )
    rows = spatial.hazard_and_quake_map(locations, events, quakes, k=3).collect()
    rows.sort(key=lambda r: (r["distance_km"], r["id"]))
    assert [r["id"] for r in rows] == ["a", "us1", "us2"]
    assert rows[1]["category"] == "Earthquakes"


def test_places_off_the_globe_are_no_places(spark):
    point = "double, latitude double, longitude double"
    places = [(1, 10.0, 20.0), (2, math.nan, 20.0), (3, 10.0, 190.0), (4, None, 20.0), (5, -91.0, 20.0)]
    locations = spark.createDataFrame(places, "location_id long, latitude double, longitude double")
    kinds = ["A", "B", "C", "D"]
    spots = [(10.0, 20.5), (math.nan, 20.0), (10.0, math.inf), (200.0, None)]
    hazards = spark.createDataFrame(
        [(float(i), *spot, kind) for i, (spot, kind) in enumerate(zip(spots, kinds))],
        f"seq {point}, category string",
    )
    rows = {r["location_id"]: r for r in spatial.hazard_profile(locations, hazards).collect()}
    assert len(rows) == 5
    assert rows[1]["nearest_hazard_distance_km"] == pytest.approx(km(10, 20, 10, 20.5), abs=0.0051)
    assert (rows[1]["hazard_types"], rows[1]["hazard_count_100km"]) == ("A", 1)
    for i in (2, 3, 4, 5):
        assert rows[i]["nearest_hazard_distance_km"] is None and rows[i]["hazard_count_100km"] == 0
    far = locations.select("location_id", haversine_km("latitude", "longitude", "10D", "20D").alias("d"))
    found = {r["location_id"]: r["d"] for r in far.collect()}
    assert found[1] == 0 and found[2] is None and found[4] is None
