import datetime as dt

import pytest
from pyspark.sql import functions as F

from sitehazard.functions import text
from sitehazard.operators import explain

SCHEMA = """location_id long, risk_score double, risk_band string, recommendation string,
    hazard_count_100km int, nearest_hazard_distance_km double, nearest_hazard_type string,
    hazard_types string, wind_speed double, temp_1h_change double"""


def explained(spark, *row):
    return explain.explain(spark.createDataFrame([(1, *row)], SCHEMA)).first()


def test_safe(spark):
    got = explained(spark, 20.0, "Safe", "Go now", 0, None, "None", "", 10.0, 0.0)
    assert got["summary"] == "Conditions appear safe for outdoor activity."
    assert got["top_reasons"] == [] and got["confidence"] == 0.7 and got["provider"] == "rules"


def test_safe_with_a_reason_is_lower_case(spark):
    got = explained(spark, 39.0, "Safe", "Go now", 1, 60.5, "Floods", "Floods", 10.0, None)
    assert got["summary"] == (
        "Conditions are generally safe, but note: a floods is reported 60 km away."
    )
    assert got["confidence"] == 0.85


def test_caution(spark):
    got = explained(spark, 60.0, "Caution", "Safe with caution", 2, 30.0, "Floods", "Floods", 35.0, 2.0)
    assert got["top_reasons"] == [
        "A Floods is 30 km away — moderately close",
        "There are 2 active hazards in the broader area",
        "Wind speed is 35 km/h — moderate winds may carry hazard effects",
    ]
    assert got["summary"] == (
        "Caution advised: a floods is 30 km away — moderately close"
        " Additionally, there are 2 active hazards in the broader area."
    )


def test_avoid_keeps_three_reasons(spark):
    got = explained(spark, 85.0, "Avoid", "Avoid today", 3, 5.0, "Severe Storms", "Severe Storms", 60.0, 6.0)
    assert len(got["top_reasons"]) == 3
    assert got["top_reasons"][2] == "Wind speed is 60 km/h — extreme winds amplify risk"
    assert got["summary"] == (
        "Avoid outdoor activity today. A severe storms is within 5 km of your location "
        "There are 3 active hazards in the broader area. "
        "Conditions are likely to worsen before they improve."
    )


def test_temperature_reasons(spark):
    rising = explained(spark, 75.0, "Avoid", "Avoid today", 0, None, "None", "", 0.0, 3.0)
    assert rising["top_reasons"] == ["Temperature is rising sharply, indicating worsening conditions"]
    assert rising["summary"].endswith("worsening conditions. Conditions are likely to worsen before they improve.")
    falling = explained(spark, 50.0, "Caution", "Safe with caution", 0, None, "None", "", 0.0, -3.0)
    assert falling["summary"] == (
        "Caution advised: temperature is dropping, which may indicate improving conditions"
    )
    none = explained(spark, 50.0, "Caution", "Safe with caution", 0, None, "None", "", None, None)
    assert none["summary"] == "Caution is advised for outdoor activity."


def test_whole_numbers_round_halves_to_even(spark):
    df = spark.createDataFrame([(0, 2.5), (1, 3.5), (2, 0.5), (3, 2.51)], "i int, x double")
    got = [r["v"] for r in df.select("i", text.whole(F.col("x")).alias("v")).orderBy("i").collect()]
    assert got == ["2", "4", "0", "3"] == [f"{x:.0f}" for x in (2.5, 3.5, 0.5, 2.51)]


@pytest.mark.parametrize("words", ["light rain", "it's RAINING", "a-b c3d", "", "o'neil's  two"])
def test_title_case(spark, words):
    df = spark.createDataFrame([(words,)], "x string")
    assert df.select(text.title_case(F.col("x")).alias("v")).first()["v"] == words.title()


def test_capitalise_slug_labels(spark):
    df = spark.createDataFrame([("a Severe STORM (New, York)",)], "x string")
    row = df.select(
        text.capitalise(F.col("x")).alias("cap"),
        text.slug(F.col("x")).alias("slug"),
        text.slug(F.col("x"), keep_parentheses=True).alias("open"),
        text.air_label(F.lit(5)).alias("five"),
        text.air_label(F.lit(0)).alias("zero"),
        text.air_label(F.lit(None).cast("int")).alias("none"),
        text.risk_colour(F.lit(39.5)).alias("colour"),
        text.risk_mark(F.lit("Unknown")).alias("mark"),
    ).first()
    assert row["cap"] == "A severe storm (new, york)"
    assert row["slug"] == "a_severe_storm_new_york" and row["open"] == "a_severe_storm_(new_york)"
    assert (row["five"], row["zero"], row["none"]) == ("Very Poor", "Unknown", "Unknown")
    assert (row["colour"], row["mark"]) == ("orange", "?")


def test_replies(spark):
    good = '{"recommendation": "Go now", "confidence": 0.9, "explanation": "fine", "top_reasons": ["a", "b"]}'
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, f"```{good}```"), (4, "I cannot say"), (5, None)]
    out = explain.decode_replies(spark.createDataFrame(rows, "i int, reply string")).orderBy("i").collect()
    assert [r["recommendation"] for r in out] == ["Go now"] * 3 + [None] * 2
    assert out[1]["top_reasons"] == ["a", "b"] and out[2]["confidence"] == 0.9


def test_reasons_stored_as_text(spark):
    rows = [(1, '["a", "b"]'), (2, "just one"), (3, "[]")]
    df = spark.createDataFrame(rows, "i int, r string").withColumn("d", text.decode_reasons(F.col("r")))
    assert [r["d"] for r in df.orderBy("i").collect()] == [["a", "b"], ["just one"], []]


def test_prompt_names_what_is_missing(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 42.0, None)],
                               "location_id long, timestamp timestamp, risk_score double, hazard_types string")
    prompt = explain.prompts(df).first()["prompt"]
    assert "Current risk score: 42.0/100" in prompt and "within 100 km: None" in prompt
    assert "Nearest hazard: None at N/A km" in prompt and prompt.endswith("explanation, top_reasons.")
    assert prompt == prompt.strip()


def test_a_reply_that_can_be_read_wins(spark):
    rules = spark.createDataFrame(
        [(i, i, "Go now", "Safe", 20.0, "by rules", ["one"], 0.7, "rules") for i in range(1, 8)],
        "location_id long, timestamp long, recommendation string, risk_band string, risk_score double, "
        "summary string, top_reasons array<string>, confidence double, provider string",
    )
    whole = '{"recommendation": "Avoid today", "confidence": 0.25, "explanation": "smoke", "top_reasons": ["fire", "wind"]}'
    replies = [(1, 1, whole), (2, 2, "no idea"), (3, 3, None), (4, 4, "{}"), (5, 5, "```json\n" + whole + "\n```"),
               (6, 6, '{"explanation": "only this"}'), (6, 6, None), (9, 9, whole)]
    frame = spark.createDataFrame(replies, "location_id long, timestamp long, reply string")
    got = explain.choose(rules, frame, provider="writer")
    assert got.columns == rules.columns
    rows = {r["location_id"]: r for r in got.collect()}
    assert set(rows) == set(range(1, 8))
    for i in (2, 3, 4, 7):
        assert (rows[i]["provider"], rows[i]["summary"], rows[i]["recommendation"]) == ("rules", "by rules", "Go now")
    for i in (1, 5):
        row = rows[i]
        assert (row["provider"], row["summary"], row["recommendation"]) == ("writer", "smoke", "Avoid today")
        assert (row["confidence"], row["top_reasons"], row["risk_score"]) == (0.25, ["fire", "wind"], 20.0)
    assert (rows[6]["provider"], rows[6]["summary"], rows[6]["confidence"]) == ("writer", "only this", 0.7)
