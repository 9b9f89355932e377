"""Rule-based explanations, and the text exchange with an outside writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitehazard.functions.scoring import known
from sitehazard.functions.text import capitalise, whole
from sitehazard.sources.tables import latest_per

TOP_REASONS = 3

# Wording of reasons and summaries, thresholds they apply at, confidences.

VERY_NEAR_KM, NEAR_KM = 10, 50
EXTREME_WIND, HIGH_WIND = 60, 30
RISING, FALLING = 3, -3
SAFE_UP_TO, CAUTION_UP_TO = 39, 69
SURE, LESS_SURE = 0.85, 0.7

VERY_NEAR = "A {} is within {} km of your location"
NEAR = "A {} is {} km away — moderately close"
REPORTED = "A {} is reported {} km away"
SEVERAL = "There are {} active hazards in the broader area"
WIND_EXTREME = "Wind speed is {} km/h — extreme winds amplify risk"
WIND_HIGH = "Wind speed is {} km/h — moderate winds may carry hazard effects"
TEMP_RISING = "Temperature is rising sharply, indicating worsening conditions"
TEMP_FALLING = "Temperature is dropping, which may indicate improving conditions"

ALL_SAFE = "Conditions appear safe for outdoor activity."
SAFE_BUT = "Conditions are generally safe, but note: {}."
CAUTION = "Caution is advised for outdoor activity."
CAUTION_FOR = "Caution advised: {}"
CAUTION_ALSO = " Additionally, {}."
AVOID = "Avoid outdoor activity today."
AVOID_FOR = "Avoid outdoor activity today. {}"
AVOID_ALSO = " {}"
AVOID_END = ". Conditions are likely to worsen before they improve."

PROMPT = """You are an environmental safety advisor. Given the following data, provide a recommendation.

Location: {location_name}
Current risk score: {risk_score}/100
Risk band: {risk_band}
Active hazards within 100 km: {hazard_types}
Nearest hazard: {nearest_hazard_type} at {nearest_hazard_distance_km} km
Current weather: {temperature}°C, wind {wind_speed} km/h, humidity {humidity}%
6h forecast risk: {predicted_risk_6h}
12h forecast risk: {predicted_risk_12h}

Provide:
1. Recommendation label (one of: Go now, Safe with caution, Wait until later, Avoid today)
2. Confidence score (0-1)
3. One short paragraph explaining the reasoning
4. Top 3 contributing factors

Respond in JSON format with keys: recommendation, confidence, explanation, top_reasons."""

PROMPT_DEFAULTS = {
    "location_name": "Mumbai",
    "risk_score": "0",
    "risk_band": "Unknown",
    "hazard_types": "None",
    "nearest_hazard_type": "None",
    "nearest_hazard_distance_km": "N/A",
    "temperature": "N/A",
    "wind_speed": "N/A",
    "humidity": "N/A",
    "predicted_risk_6h": "N/A",
    "predicted_risk_12h": "N/A",
}

REPLY = "recommendation string, confidence double, explanation string, top_reasons array<string>"


def fill(template: str, *values: Column) -> Column:
    """The template with each ``{}`` replaced by the next value."""
    pieces = template.split("{}")
    parts: list[Column] = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def reasons() -> Column:
    """All reasons that apply, in order of importance."""
    count, kind = F.col("hazard_count_100km"), F.col("nearest_hazard_type")
    km, wind = known(F.col("nearest_hazard_distance_km")), known(F.col("wind_speed"))
    change = known(F.col("temp_1h_change"))
    nearest = (
        F.when(km <= VERY_NEAR_KM, fill(VERY_NEAR, kind, whole(km)))
        .when(km <= NEAR_KM, fill(NEAR, kind, whole(km)))
        .when(km.isNotNull(), fill(REPORTED, kind, whole(km)))
    )
    return F.array_compact(
        F.array(
            F.when((count > 0) & (kind != "None"), nearest),
            F.when(count > 1, fill(SEVERAL, count.cast("string"))),
            F.when(wind >= EXTREME_WIND, fill(WIND_EXTREME, whole(wind))).when(
                wind >= HIGH_WIND, fill(WIND_HIGH, whole(wind))
            ),
            F.when(change >= RISING, TEMP_RISING).when(change <= FALLING, TEMP_FALLING),
        )
    )


def summary(score: Column, found: Column) -> Column:
    first, second = F.get(found, 0), F.get(found, 1)
    none, two = F.size(found) == 0, F.size(found) > 1
    nothing = F.lit("")
    safe = F.when(none, ALL_SAFE).otherwise(fill(SAFE_BUT, F.lower(first)))
    caution = F.when(none, CAUTION).otherwise(
        F.concat(
            fill(CAUTION_FOR, F.lower(first)),
            F.when(two, fill(CAUTION_ALSO, F.lower(second))).otherwise(nothing),
        )
    )
    avoid = F.when(none, AVOID).otherwise(
        F.concat(
            fill(AVOID_FOR, capitalise(first)),
            F.when(two, fill(AVOID_ALSO, capitalise(second))).otherwise(nothing),
            F.lit(AVOID_END),
        )
    )
    return F.when(score <= SAFE_UP_TO, safe).when(score <= CAUTION_UP_TO, caution).otherwise(avoid)


def explain(risk: DataFrame) -> DataFrame:
    """One explanation per scored row."""
    found = risk.withColumn("_reasons", reasons())
    keys = [c for c in ("location_id", "timestamp") if c in risk.columns]
    return found.select(
        *keys,
        "recommendation",
        "risk_band",
        F.round("risk_score", 1).alias("risk_score"),
        summary(F.col("risk_score"), F.col("_reasons")).alias("summary"),
        F.slice("_reasons", 1, TOP_REASONS).alias("top_reasons"),
        F.when(F.col("hazard_count_100km") > 0, SURE).otherwise(LESS_SURE).alias("confidence"),
        F.lit("rules").alias("provider"),
    )


def choose(
    explanations: DataFrame,
    replies: DataFrame,
    keys: tuple[str, ...] = ("location_id", "timestamp"),
    provider: str = "model",
) -> DataFrame:
    """The outside writer's answer where its reply can be read, else the one by rules.

    ``replies`` has the keys and ``reply``. A reply without any of the expected fields counts as
    none, and fields it leaves out stay those of the rules. ``provider`` says which it was. Of
    several replies to one row the last by its text is taken.
    """
    one = replies.groupBy(*keys).agg(F.max("reply").alias("reply"))
    read = decode_replies(one)
    fields = {"recommendation": "recommendation", "confidence": "confidence", "summary": "explanation"}
    fields["top_reasons"] = "top_reasons"
    answered = (
        F.col("recommendation").isNotNull()
        | F.col("explanation").isNotNull()
        | F.col("confidence").isNotNull()
        | F.col("top_reasons").isNotNull()
    )
    answers = read.where(answered).select(
        *keys, F.struct(*(F.col(source).alias(name) for name, source in fields.items())).alias("_answer")
    )
    joined = explanations.join(answers, list(keys), "left")
    chosen = {name: F.coalesce(F.col(f"_answer.{name}"), F.col(name)) for name in fields}
    by = F.when(F.col("_answer").isNotNull(), provider).otherwise(F.col("provider"))
    return joined.withColumns({**chosen, "provider": by}).select(explanations.columns)


def with_explanation(risk: DataFrame) -> DataFrame:
    """Fill the fact table's own explanation columns."""
    found = risk.withColumn("_reasons", reasons())
    return found.withColumns(
        {
            "confidence_score": F.when(F.col("hazard_count_100km") > 0, SURE).otherwise(LESS_SURE),
            "explanation_text": summary(F.col("risk_score"), F.col("_reasons")),
        }
    ).drop("_reasons")


def latest_explanation(explanations: DataFrame) -> DataFrame:
    return latest_per(explanations, "location_id", "timestamp")


def prompts(risk: DataFrame, keep: list[str] = ["location_id", "timestamp"]) -> DataFrame:
    """The request text for every row, for a writer outside Spark; absent values named so."""

    def field(name: str) -> Column:
        if name not in risk.columns:
            return F.lit(PROMPT_DEFAULTS[name])
        return F.coalesce(F.col(name).cast("string"), F.lit(PROMPT_DEFAULTS[name]))

    text: list[Column] = []
    rest = PROMPT
    for name in PROMPT_DEFAULTS:
        before, rest = rest.split("{" + name + "}", 1)
        text += [F.lit(before), field(name)]
    return risk.select(*keep, F.concat(*text, F.lit(rest)).alias("prompt"))


def decode_replies(replies: DataFrame, text: str = "reply") -> DataFrame:
    """Replies as columns: code fences stripped, JSON read; unreadable replies give nulls."""
    bare = F.trim(F.regexp_replace(F.col(text), r"^\s*(```json|```)?|(```)?\s*$", ""))
    rest = [c for c in replies.columns if c != text]
    return replies.withColumn("_reply", F.from_json(bare, REPLY)).select(*rest, "_reply.*")
