"""Series operators, once whole and once cut into chunks: both must equal brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sitehazard.operators import series as ops
from sitehazard.operators.skew import Series, hot_keys, join_few, mark_chunks, measure_series

START = dt.datetime(2024, 1, 1)
LIMITS = [10_000, 9]  # rows a task may take: everything, or so few that long series are cut
WEATHER = """location_id long, seq long, forecast_timestamp timestamp_ntz, temperature double,
    wind_speed double, precipitation double"""
AIR = "location_id long, seq long, timestamp timestamp_ntz, aqi int, co double"


def weather_rows(seed=1):
    """One long and bursty location, one short one, one with a single row."""
    dice = random.Random(seed)
    rows = []
    for location, count in ((1, 120), (2, 6), (3, 1)):
        seconds = {dice.randrange(86_400 * 20) for _ in range(count // 2)}
        while len(seconds) < count:  # the other half within one hour
            seconds.add(500_000 + dice.randrange(3_600))
        for s in sorted(seconds):
            temperature = None if dice.random() < 0.15 else round(dice.uniform(0, 40), 1)
            rows.append((location, len(rows), START + dt.timedelta(seconds=s), temperature,
                         float(dice.randrange(80)), round(dice.uniform(0, 9), 1)))
    return rows


def by_location(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: r[2]):
        groups.setdefault(row[0], []).append(row)
    return groups


def setup(spark, limit):
    rows = weather_rows()
    df = spark.createDataFrame(rows, WEATHER).repartition(5)
    return rows, df, measure_series(df, "location_id", "forecast_timestamp", limit)


def test_long_series_are_cut_and_short_ones_are_not(spark):
    rows, df, whole = setup(spark, 10_000)
    assert whole.cuts is None and whole.group == ["location_id"]
    _, _, cut = setup(spark, 9)
    assert [r["location_id"] for r in cut.cuts.collect()] == [1]
    sizes = mark_chunks(df, cut).groupBy("location_id", "_chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 9
    assert {r["_chunk"] for r in sizes if r["location_id"] != 1} == {0}


def test_rows_at_one_instant_cannot_be_cut_and_do_not_hang(spark):
    df = spark.createDataFrame([(1, START)] * 50, "k long, t timestamp_ntz")
    assert measure_series(df, "k", "t", 10).cuts.count() == 1


def mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def less(a, b):
    return None if a is None or b is None else a - b


@pytest.mark.parametrize("limit", LIMITS)
def test_trends(spark, limit):
    rows, df, series = setup(spark, limit)
    got = {r["seq"]: r for r in ops.trend_features(df, series).collect()}
    assert len(got) == len(rows)
    for group in by_location(rows).values():
        for i, row in enumerate(group):
            temperature = [r[3] for r in group]
            wind = [r[4] for r in group]
            found = got[row[1]]
            want = {
                "temp_3h_avg": mean(temperature[max(0, i - 2) : i + 1]),
                "temp_6h_avg": mean(temperature[max(0, i - 5) : i + 1]),
                "temp_1h_change": less(temperature[i], temperature[i - 1]) if i else None,
                "temp_3h_change": less(temperature[i], temperature[i - 3]) if i > 2 else None,
                "wind_3h_avg": mean(wind[max(0, i - 2) : i + 1]),
                "wind_1h_change": less(wind[i], wind[i - 1]) if i else None,
                "precip_3h_sum": sum(r[5] for r in group[max(0, i - 2) : i + 1]),
            }
            for name, value in want.items():
                assert found[name] == (None if value is None else pytest.approx(value)), name


def test_first_average_is_the_first_value(spark):
    hours = [(1, i, START + dt.timedelta(hours=i), 20.0 + i, 10.0 + i, 0.0) for i in range(10)]
    df = spark.createDataFrame(hours, WEATHER)
    got = ops.trend_features(df, Series("location_id", "forecast_timestamp")).orderBy("seq").collect()
    assert got[0]["temp_3h_avg"] == 20.0 and got[0]["temp_1h_change"] is None
    assert got[9]["temp_3h_avg"] == 28.0 and got[9]["temp_3h_change"] == 3.0


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("direction", ["lag", "lead"])
def test_horizon_labels(spark, limit, direction):
    rows, df, series = setup(spark, limit)
    horizons = {"six": 6, "twelve": 12}
    got = {r["seq"]: r for r in ops.horizon_labels(df, series, "wind_speed", horizons, direction).collect()}
    assert len(got) == len(rows)
    for group in by_location(rows).values():
        for i, row in enumerate(group):
            for name, steps in horizons.items():
                j = i - steps if direction == "lag" else i + steps
                assert got[row[1]][name] == (group[j][4] if 0 <= j < len(group) else None)


def air_rows(weather):
    dice = random.Random(7)
    rows = []
    for location, _, ts, *_ in weather:
        for _ in range(dice.choice([0, 0, 1, 2])):
            away = dice.choice([0, 0, 60, -60, 10_800, -10_800, 10_801, dice.randrange(-20_000, 20_000)])
            rows.append((location, len(rows), ts + dt.timedelta(seconds=away), dice.randrange(1, 6), 1.0 * len(rows)))
    return rows


def nearest(left, group):
    """Back: latest at or before, last of equals. Ahead: earliest after, first of equals."""
    back = max((r for r in group if r[2] <= left), key=lambda r: (r[2], r[1]), default=None)
    ahead = min((r for r in group if r[2] > left), key=lambda r: (r[2], r[1]), default=None)
    choice = back
    if back is None or (ahead is not None and ahead[2] - left < left - back[2]):
        choice = ahead
    if choice is None or abs(choice[2] - left) > dt.timedelta(hours=3):
        return None
    return choice


@pytest.mark.parametrize("limit", LIMITS)
def test_match_nearest(spark, limit):
    rows, df, _ = setup(spark, limit)
    air = air_rows(rows)
    right = spark.createDataFrame(air, AIR)
    stamps = df.select("location_id", "forecast_timestamp").union(right.select("location_id", "timestamp"))
    series = measure_series(stamps, "location_id", "forecast_timestamp", limit)
    assert (series.cuts is None) == (limit == 10_000)
    got = {r["seq"]: r for r in ops.match_nearest(df, right, series, "timestamp", ["aqi", "co"]).collect()}
    assert len(got) == len(rows)
    matched = 0
    for row in rows:
        want = nearest(row[2], [a for a in air if a[0] == row[0]])
        assert (got[row[1]]["aqi"], got[row[1]]["co"]) == ((want[3], want[4]) if want else (None, None))
        matched += want is not None
    assert 0 < matched < len(rows)


@pytest.mark.parametrize("limit", LIMITS)
def test_bursts_at_one_instant(spark, limit):
    """Half of all air rows share one time; only its first and last can be matched."""
    dice = random.Random(9)
    weather = [(1, i, START + dt.timedelta(minutes=10 * i), 1.0, 1.0, 1.0) for i in range(30)]
    burst = START + dt.timedelta(minutes=95)
    air = [(1, i, START + dt.timedelta(seconds=dice.randrange(18_000)), 1, float(i)) for i in range(200)]
    air += [(1, i, burst, 2, float(i)) for i in range(200, 400)]
    dice.shuffle(air)
    df, right = spark.createDataFrame(weather, WEATHER), spark.createDataFrame(air, AIR).repartition(4)
    stamps = df.select("location_id", "forecast_timestamp").union(right.select("location_id", "timestamp"))
    series = measure_series(stamps, "location_id", "forecast_timestamp", limit)
    got = {r["seq"]: r for r in ops.match_nearest(df, right, series, "timestamp", ["aqi", "co"]).collect()}
    for row in weather:
        want = nearest(row[2], air)
        assert (got[row[1]]["aqi"], got[row[1]]["co"]) == (want[3], want[4])
    stamped = right.select("location_id", "timestamp", F.col("seq").alias("_turn"), F.struct("co").alias("_right"))
    left = ops._ends_of_instants(stamped, "location_id", "timestamp").groupBy("timestamp").count()
    assert left.agg(F.max("count")).first()[0] == 2
    assert sorted(r["_turn"] for r in ops._ends_of_instants(stamped, "location_id", "timestamp").where(F.col("timestamp") == burst).collect()) == [200, 399]


@pytest.mark.parametrize("limit", [10_000, 2])
def test_a_stray_time_opens_a_long_gap(spark, limit):
    """Half a million hours after one row of 1970; no row holds a list of them all."""
    rows = [(1, 0, dt.datetime(1970, 1, 1, 0, 30), 0.0, 1.0, 0.0), (1, 1, dt.datetime(1970, 1, 2), 47.0, 1.0, 0.0),
            (1, 2, START, 5.0, 3.0, 0.0), (1, 3, START + dt.timedelta(hours=2), 9.0, 3.0, 0.0)]
    df = spark.createDataFrame(rows, WEATHER)
    series = measure_series(df, "location_id", "forecast_timestamp", limit)
    out = ops.hourly_grid(df, series, ["temperature", "wind_speed"], [])
    hours = int((START + dt.timedelta(hours=2) - dt.datetime(1970, 1, 1, 1)) / dt.timedelta(hours=1)) + 1
    assert out.agg(F.count("*"), F.count_distinct("forecast_timestamp")).first()[:] == (hours, hours)
    middle = out.where(F.col("forecast_timestamp") == dt.datetime(1997, 1, 1, 6)).first()
    share = (dt.datetime(1997, 1, 1, 6) - dt.datetime(1970, 1, 2)) / (START - dt.datetime(1970, 1, 2))
    assert middle["temperature"] == pytest.approx(47 - 42 * share)
    assert middle["wind_speed"] == pytest.approx(1 + 2 * share)
    assert out.orderBy(F.col("forecast_timestamp").desc()).first()["temperature"] == 9.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(sequence(") == 2


def hourly_reference(group, index):
    """Values on every hour between the first and last row, linear between known anchors."""
    anchors = [(r[2], r[index]) for r in group if r[index] is not None]
    first, last = group[0][2], group[-1][2]
    hour = first.replace(minute=0, second=0, microsecond=0)
    result = {}
    while hour <= last:
        if hour >= first:
            before = [a for a in anchors if a[0] <= hour]
            after = [a for a in anchors if a[0] > hour]
            if not before:
                result[hour] = None
            elif before[-1][0] == hour or not after:
                result[hour] = before[-1][1]
            else:
                (t0, v0), (t1, v1) = before[-1], after[0]
                result[hour] = v0 + (v1 - v0) * ((hour - t0) / (t1 - t0))
        hour += dt.timedelta(hours=1)
    return result


@pytest.mark.parametrize("limit", LIMITS)
def test_hourly_grid(spark, limit):
    rows, df, series = setup(spark, limit)
    labelled = df.withColumn("label", F.concat(F.lit("row "), F.col("seq")))
    out = ops.hourly_grid(labelled, series, ["temperature", "wind_speed"], ["label"]).collect()
    got = {(r["location_id"], r["forecast_timestamp"]): r for r in out}
    assert len(got) == len(out)
    total = 0
    for location, group in by_location(rows).items():
        for index, name in ((3, "temperature"), (4, "wind_speed")):
            want = hourly_reference(group, index)
            for hour, value in want.items():
                found = got[(location, hour)][name]
                assert found == (None if value is None else pytest.approx(value)), (location, hour)
        for hour in want:
            latest = [r for r in group if r[2] <= hour][-1]
            assert got[(location, hour)]["label"] == f"row {latest[1]}"
        total += len(want)
    assert total == len(got)


def test_three_hourly_becomes_hourly(spark):
    rows = [(1, 0, START, None, 3.0, 0.0), (1, 1, START + dt.timedelta(hours=3), 10.0, 9.0, 0.0),
            (1, 2, START + dt.timedelta(hours=6), 16.0, 3.0, 0.0), (1, 3, START + dt.timedelta(hours=7), None, 3.0, 0.0)]
    df = spark.createDataFrame(rows, WEATHER)
    out = ops.hourly_grid(df, Series("location_id", "forecast_timestamp"), ["temperature", "wind_speed"], [])
    got = out.orderBy("forecast_timestamp").collect()
    assert [r["temperature"] for r in got] == [None, None, None, 10.0, 12.0, 14.0, 16.0, 16.0]
    assert [r["wind_speed"] for r in got] == [3.0, 5.0, 7.0, 9.0, 7.0, 5.0, 3.0, 3.0]


def test_time_features(spark):
    days = [(START + dt.timedelta(days=i, hours=i),) for i in range(7)]  # from a Monday
    got = ops.time_features(spark.createDataFrame(days, "timestamp timestamp_ntz")).orderBy("timestamp").collect()
    assert [r["day_of_week"] for r in got] == list(range(7))
    assert [r["weekend"] for r in got] == [0, 0, 0, 0, 0, 1, 1]
    assert [r["hour"] for r in got] == list(range(7))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, how):
    many = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k long, v long")
    few = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c"), (1000, "d")], "k long, w string")
    hot = hot_keys(many, "k", 20)
    assert [r["k"] for r in hot.table.collect()] == [1]
    plain = many.join(few, "k", how)
    spread = join_few(many, few, ["k"], hot, how)
    assert sorted(map(str, spread.select("k", "v", "w").collect())) == sorted(
        map(str, plain.select("k", "v", "w").collect())
    )
    assert hot_keys(many, "k", 1000) is None
