"""The rule components of the risk score, each a Column over one feature row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitehazard.config import DEFAULT_RULES, RiskRules


def known(value: Column) -> Column:
    """NaN reads as missing: in Spark every comparison ``NaN >= x`` would be true."""
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def hazard_type(types: Column, rules: RiskRules = DEFAULT_RULES) -> Column:
    """Highest weight among the comma-separated types."""
    weights = F.create_map(
        *[F.lit(part) for pair in rules.hazard_weights.items() for part in pair]
    ) if rules.hazard_weights else F.lit(None).cast("map<string,double>")
    scored = F.transform(
        F.split(types, ","),
        lambda t: F.coalesce(F.try_element_at(weights, F.trim(t)), F.lit(rules.default_weight)),
    )
    return F.when(types.isNull() | (types == ""), 0.0).otherwise(F.array_max(scored))


def proximity(distance_km: Column, rules: RiskRules = DEFAULT_RULES) -> Column:
    distance = known(distance_km)
    score = F.lit(0.0)
    for band, points in reversed(list(zip(rules.bands_km, rules.band_scores))):
        score = F.when(distance <= band, points).otherwise(score)
    return score


def weather(
    wind: Column, humidity: Column, rain: Column, rules: RiskRules = DEFAULT_RULES
) -> Column:
    wind = known(wind)
    wind_points = (
        F.when(wind >= rules.extreme_wind, rules.extreme_wind_score)
        .when(wind >= rules.high_wind, rules.high_wind_score)
        .otherwise(0.0)
    )
    damp = F.when(known(humidity) >= rules.high_humidity, rules.high_humidity_score).otherwise(0.0)
    wet = F.when(known(rain) >= rules.heavy_rain, rules.heavy_rain_score).otherwise(0.0)
    return wind_points + damp + wet


def several_hazards(count: Column, rules: RiskRules = DEFAULT_RULES) -> Column:
    extra = (count - 1) * rules.hazard_step
    return F.when(count > 1, F.least(extra, F.lit(rules.hazard_step_cap))).otherwise(0.0)


def trend(change: Column, rules: RiskRules = DEFAULT_RULES) -> Column:
    change = known(change)
    return (
        F.when(change >= rules.warming, rules.warming_score)
        .when(change <= rules.cooling, rules.cooling_score)
        .otherwise(0.0)
    )


def air_quality(
    index: Column, co: Column, so2: Column, rules: RiskRules = DEFAULT_RULES
) -> Column:
    index = known(index)
    score = F.lit(0.0)
    if rules.poor_air_index is not None and rules.fair_air_index is not None:
        score = (
            F.when(index == 0, 0.0)
            .when(index >= rules.poor_air_index, rules.poor_air_score)
            .when(index >= rules.fair_air_index, rules.fair_air_score)
            .otherwise(0.0)
        )
    if rules.co_limit is not None:
        score = score + F.when(known(co) > rules.co_limit, rules.co_score).otherwise(0.0)
    if rules.so2_limit is not None:
        score = score + F.when(known(so2) > rules.so2_limit, rules.so2_score).otherwise(0.0)
    return score


def earthquake(magnitude: Column, rules: RiskRules = DEFAULT_RULES) -> Column:
    magnitude = known(magnitude)
    score = F.lit(0.0)
    for floor, points in sorted(rules.quake_steps):
        score = F.when(magnitude >= floor, points).otherwise(score)
    return score


def total_score(components: list[Column]) -> Column:
    total = components[0]
    for component in components[1:]:
        total = total + component
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def band_label(score: Column, rules: RiskRules = DEFAULT_RULES) -> Column:
    return _by_band(score, rules, "label", "Unknown")


def band_advice(score: Column, rules: RiskRules = DEFAULT_RULES) -> Column:
    return _by_band(score, rules, "advice", "Check conditions")


def _by_band(score: Column, rules: RiskRules, what: str, otherwise: str) -> Column:
    result = F.lit(otherwise)
    for band in sorted(rules.risk_bands, key=lambda b: b.low, reverse=True):
        result = F.when(score.between(band.low, band.high), getattr(band, what)).otherwise(result)
    return result


def components_of(df: DataFrame, rules: RiskRules = DEFAULT_RULES) -> dict[str, Column]:
    """All seven components over a feature table; a column the table lacks reads as missing."""

    def col(name: str, kind: str = "double") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    return {
        "component_hazard": hazard_type(col("hazard_types", "string"), rules),
        "component_proximity": proximity(col("nearest_hazard_distance_km"), rules),
        "component_weather": weather(
            col("wind_speed"), col("humidity"), col("precipitation"), rules
        ),
        "component_trend": trend(col("temp_1h_change"), rules),
        "component_multi_hazard": several_hazards(col("hazard_count_100km", "int"), rules),
        "component_air_quality": air_quality(col("aqi"), col("co"), col("so2"), rules),
        "component_earthquake": earthquake(col("max_eq_magnitude"), rules),
    }


def with_risk(df: DataFrame, rules: RiskRules = DEFAULT_RULES) -> DataFrame:
    """Score, band, advice and components for every feature row; one projection, no shuffle.

    ``component_earthquake`` is kept so that the components add up to the unclamped total. The
    band is taken from the unrounded total.
    """
    components = components_of(df, rules)
    scored = df.withColumns(components).withColumn(
        "_total", total_score([F.col(name) for name in components])
    )
    return scored.withColumns(
        {
            "risk_score": F.round("_total", 1),
            "risk_band": band_label(F.col("_total"), rules),
            "recommendation": band_advice(F.col("_total"), rules),
            **{name: F.round(name, 1) for name in components},
        }
    ).drop("_total")


def is_valid_score(score: Column) -> Column:
    return score.between(0.0, 100.0)
