"""The same answers in plain SQL, written independently, to check the DataFrame queries.

``SQL[name]`` is one statement over the test tables. Shared steps are common table
expressions; ``_query`` puts in front the ones a statement needs.
"""

from __future__ import annotations

import re

from sitehazard.config import HAZARD_WEIGHTS, SHORT_KEY_WEIGHTS
from sitehazard.sources.derived import FEEDS


def _km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * CAST(6371 AS DOUBLE) * asin(least(CAST(1 AS DOUBLE), sqrt("
        f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))"
    )


def _score(weights: dict[str, float], source: str) -> str:
    listed = ", ".join(f"'{name}': {value:g}" for name, value in weights.items())
    number = "CAST({} AS DOUBLE)"
    return f"""
SELECT *,
  CASE WHEN hazard_types IS NULL OR hazard_types = '' THEN CAST(0 AS DOUBLE) ELSE
    CAST(list_max([coalesce(map_extract(MAP {{{listed}}}, trim(t))[1], 15)
      for t in string_split(hazard_types, ',')]) AS DOUBLE) END AS c_hazard,
  CAST(CASE WHEN nearest_hazard_distance_km <= 10 THEN 25 WHEN nearest_hazard_distance_km <= 50
    THEN 15 WHEN nearest_hazard_distance_km <= 100 THEN 5 ELSE 0 END AS DOUBLE) AS c_proximity,
  CAST((CASE WHEN wind_speed >= 60 THEN 20 WHEN wind_speed >= 30 THEN 10 ELSE 0 END)
    + (CASE WHEN humidity >= 70 THEN 5 ELSE 0 END)
    + (CASE WHEN precipitation >= 10 THEN 10 ELSE 0 END) AS DOUBLE) AS c_weather,
  CAST(CASE WHEN temp_1h_change >= 5 THEN 10 WHEN temp_1h_change <= -5 THEN -5 ELSE 0 END
    AS DOUBLE) AS c_trend,
  CAST(CASE WHEN hazard_count_100km > 1 THEN least((hazard_count_100km - 1) * 5, 15) ELSE 0 END
    AS DOUBLE) AS c_multi,
  CAST((CASE WHEN aqi >= 4 THEN 25 WHEN aqi >= 3 THEN 15 ELSE 0 END)
    + (CASE WHEN co > 10 THEN 5 ELSE 0 END) + (CASE WHEN so2 > 20 THEN 5 ELSE 0 END)
    AS DOUBLE) AS c_air,
  CAST(CASE WHEN max_eq_magnitude >= 6 THEN 15 WHEN max_eq_magnitude >= 5 THEN 10
    WHEN max_eq_magnitude >= 4 THEN 5 ELSE 0 END AS DOUBLE) AS c_quake,
  least({number.format(100)}, greatest({number.format(0)},
    c_hazard + c_proximity + c_weather + c_trend + c_multi + c_air + c_quake)) AS risk_score,
  CASE WHEN risk_score BETWEEN 0 AND 39 THEN 'Safe' WHEN risk_score BETWEEN 40 AND 69 THEN 'Caution'
    WHEN risk_score BETWEEN 70 AND 100 THEN 'Avoid' ELSE 'Unknown' END AS risk_band,
  CASE WHEN risk_score BETWEEN 0 AND 39 THEN 'Go now'
    WHEN risk_score BETWEEN 40 AND 69 THEN 'Safe with caution'
    WHEN risk_score BETWEEN 70 AND 100 THEN 'Avoid today' ELSE 'Check conditions' END
    AS recommendation
FROM {source}"""


_LAST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY {} DESC) = 1"
_UV = """CASE WHEN height <= 0 THEN CAST(0 AS DOUBLE) ELSE round(
    (CASE WHEN abs(latitude) < 15 THEN 12 WHEN abs(latitude) < 30 THEN 10
      WHEN abs(latitude) < 45 THEN 7 ELSE 4 END) * pow(sin(asin(height)), 1.3), 1) END"""


def _sun(ts: str) -> str:
    declination = (
        f"radians(23.44 * sin(radians(CAST(284 + dayofyear({ts}) AS DOUBLE)) * 360 / 365))"
    )
    hour = (
        f"radians(15 * (hour({ts}) + minute({ts}) / CAST(60 AS DOUBLE) "
        f"+ longitude / CAST(15 AS DOUBLE) - 12))"
    )
    return (
        f"sin(radians(latitude)) * sin({declination}) "
        f"+ cos(radians(latitude)) * cos({declination}) * cos({hour})"
    )


def _between(c: str) -> str:
    """A column's value on the line between its anchors around an hour."""
    return (
        f"CASE WHEN {c}_t0 = forecast_timestamp OR {c}_t1 IS NULL THEN {c}_v0 ELSE {c}_v0 + "
        f"({c}_v1 - {c}_v0) * ((epoch_us(forecast_timestamp) - epoch_us({c}_t0)) / "
        f"CAST(epoch_us({c}_t1) - epoch_us({c}_t0) AS DOUBLE)) END"
    )


_TRENDS = """
  avg(temperature) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS temp_3h_avg,
  avg(temperature) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS temp_6h_avg,
  temperature - lag(temperature, 1) OVER w AS temp_1h_change,
  temperature - lag(temperature, 3) OVER w AS temp_3h_change,
  avg(wind_speed) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS wind_3h_avg,
  wind_speed - lag(wind_speed, 1) OVER w AS wind_1h_change,
  sum(precipitation) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS precip_3h_sum"""

_RESAMPLED = (
    "temperature", "humidity", "wind_speed", "wind_direction", "precipitation", "pressure",
    "uv_index",
)

STEPS = {
    **{name: feed.sql() for name, feed in FEEDS.items()},
    "clean_hazards": "SELECT * FROM (SELECT * FROM raw_hazards "
    + _LAST.format("event_id", "seq")
    + ") WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180",
    "active": "SELECT * FROM clean_hazards WHERE status IN ('open', 'unknown')",
    "all_hazards": """
SELECT 0 AS feed, seq, event_id AS id, category, latitude, longitude, CAST(NULL AS DOUBLE) AS magnitude
FROM active UNION ALL
SELECT 1, seq, id, 'Earthquakes', latitude, longitude, magnitude FROM raw_quakes WHERE magnitude >= 2.5""",
    "around": f"""
SELECT l.location_id, l.latitude AS lat, l.longitude AS lon, h.*,
  {_km('h.latitude', 'h.longitude', 'l.latitude', 'l.longitude')} AS km
FROM locations l CROSS JOIN all_hazards h""",
    "counted": """
SELECT location_id,
  CAST(count(*) FILTER (WHERE km <= 10) AS INT) AS hazard_count_10km,
  CAST(count(*) FILTER (WHERE km <= 50) AS INT) AS hazard_count_50km,
  CAST(count(*) FILTER (WHERE km <= 100) AS INT) AS hazard_count_100km,
  coalesce(string_agg(DISTINCT category, ',' ORDER BY category) FILTER (WHERE km <= 100), '') AS hazard_types,
  coalesce(max(magnitude) FILTER (WHERE km <= 100), 0) AS max_eq_magnitude
FROM around GROUP BY location_id""",
    "closest": "SELECT location_id, lat, lon, round(km, 2) AS nearest_hazard_distance_km, "
    "category AS nearest_hazard_type, latitude AS hazard_lat, longitude AS hazard_lon FROM around "
    "QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY km, feed, seq) = 1",
    "profile": "SELECT * FROM counted JOIN closest USING (location_id)",
    "clean_weather": """
SELECT location_id, seq, forecast_timestamp, coalesce(temperature, 25) AS temperature,
  coalesce(humidity, 50) AS humidity, coalesce(wind_speed, 0) AS wind_speed,
  coalesce(wind_direction, 0) AS wind_direction, coalesce(precipitation, 0) AS precipitation,
  coalesce(pressure, 1013) AS pressure, coalesce(uv_index, 0) AS uv_index, condition_text
FROM (SELECT * FROM raw_weather """
    + _LAST.format("location_id, forecast_timestamp", "seq")
    + ") WHERE forecast_timestamp IS NOT NULL",
    "trends": f"""
SELECT *, {_TRENDS}
FROM clean_weather WINDOW w AS (PARTITION BY location_id ORDER BY forecast_timestamp)""",
    "back": """
SELECT w.seq, a.timestamp AS at, a.aqi, a.co, a.so2 FROM trends w ASOF JOIN raw_air a
  ON w.location_id = a.location_id AND w.forecast_timestamp >= a.timestamp""",
    "ahead": """
SELECT w.seq, a.timestamp AS at, a.aqi, a.co, a.so2 FROM trends w ASOF JOIN raw_air a
  ON w.location_id = a.location_id AND w.forecast_timestamp <= a.timestamp""",
    "matched": """
SELECT t.*,
  coalesce(epoch_us(t.forecast_timestamp) - epoch_us(b.at), 1000000000000000) AS gap_b,
  coalesce(epoch_us(a.at) - epoch_us(t.forecast_timestamp), 1000000000000000) AS gap_a,
  CASE WHEN least(gap_b, gap_a) > 10800000000 THEN NULL WHEN gap_b <= gap_a THEN b.aqi ELSE a.aqi END AS aqi,
  CASE WHEN least(gap_b, gap_a) > 10800000000 THEN NULL WHEN gap_b <= gap_a THEN b.co ELSE a.co END AS co,
  CASE WHEN least(gap_b, gap_a) > 10800000000 THEN NULL WHEN gap_b <= gap_a THEN b.so2 ELSE a.so2 END AS so2
FROM trends t LEFT JOIN back b ON t.seq = b.seq LEFT JOIN ahead a ON t.seq = a.seq""",
    "features": """
SELECT m.location_id, m.forecast_timestamp AS timestamp,
  coalesce(p.hazard_count_10km, 0) AS hazard_count_10km,
  coalesce(p.hazard_count_50km, 0) AS hazard_count_50km,
  coalesce(p.hazard_count_100km, 0) AS hazard_count_100km,
  p.nearest_hazard_distance_km, coalesce(p.nearest_hazard_type, 'None') AS nearest_hazard_type,
  coalesce(p.hazard_types, '') AS hazard_types,
  m.temperature, m.humidity, m.wind_speed, m.wind_direction, m.precipitation, m.pressure, m.uv_index,
  CASE WHEN p.hazard_lat IS NULL THEN CAST(0 AS DOUBLE) ELSE
    fmod(fmod(degrees(atan2(p.hazard_lat - p.lat, p.hazard_lon - p.lon)), 360) + 360, 360) END AS angle,
  abs(angle - fmod(m.wind_direction, 360)) AS turn,
  CASE WHEN p.hazard_lat IS NULL THEN CAST(0 AS DOUBLE) ELSE
    round(greatest(0, 1 - least(turn, 360 - turn) / CAST(180 AS DOUBLE)) * 100, 2) END AS wind_alignment_score,
  m.aqi, m.co, m.so2, coalesce(p.max_eq_magnitude, 0) AS max_eq_magnitude,
  CAST(hour(m.forecast_timestamp) AS INT) AS hour,
  CAST(isodow(m.forecast_timestamp) - 1 AS INT) AS day_of_week,
  CAST(CASE WHEN isodow(m.forecast_timestamp) > 5 THEN 1 ELSE 0 END AS INT) AS weekend,
  m.temp_3h_avg, m.temp_6h_avg, m.temp_1h_change, m.temp_3h_change, m.wind_3h_avg,
  m.wind_1h_change, m.precip_3h_sum
FROM matched m LEFT JOIN profile p ON m.location_id = p.location_id""",
    "risk": _score(HAZARD_WEIGHTS, "features"),
    "bulk_scored": _score(HAZARD_WEIGHTS, "bulk_rows"),
    "bulk_short": _score(SHORT_KEY_WEIGHTS, "bulk_rows"),
    "held": """
SELECT *, lag(risk_score, 6) OVER w AS predicted_risk_6h, lag(risk_score, 12) OVER w AS predicted_risk_12h
FROM risk WINDOW w AS (PARTITION BY location_id ORDER BY timestamp)""",
    "hourly_weather": "SELECT * REPLACE (date_trunc('hour', forecast_timestamp) AS forecast_timestamp) "
    "FROM raw_weather "
    + _LAST.format("location_id, date_trunc('hour', forecast_timestamp)", "seq"),
    "hours": """
SELECT location_id, unnest(generate_series(min(forecast_timestamp), max(forecast_timestamp),
  INTERVAL 1 HOUR)) AS forecast_timestamp FROM hourly_weather GROUP BY location_id""",
    "gridded": "SELECT h.location_id, h.forecast_timestamp, o.condition_text, "
    + ", ".join(f"o.{c}" for c in _RESAMPLED)
    + " FROM hours h LEFT JOIN hourly_weather o ON h.location_id = o.location_id "
    "AND h.forecast_timestamp = o.forecast_timestamp",
    "anchored": "SELECT location_id, forecast_timestamp, "
    "last_value(condition_text IGNORE NULLS) OVER b AS condition_text, "
    + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER b AS {c}_v0, first_value({c} IGNORE NULLS) OVER a AS {c}_v1, "
        f"last_value(CASE WHEN {c} IS NOT NULL THEN forecast_timestamp END IGNORE NULLS) OVER b AS {c}_t0, "
        f"first_value(CASE WHEN {c} IS NOT NULL THEN forecast_timestamp END IGNORE NULLS) OVER a AS {c}_t1"
        for c in _RESAMPLED
    )
    + " FROM gridded WINDOW b AS (PARTITION BY location_id ORDER BY forecast_timestamp "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY location_id "
    "ORDER BY forecast_timestamp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "reasoned": """
SELECT *, printf('%.0f', nearest_hazard_distance_km) AS km, printf('%.0f', wind_speed) AS wind,
  [r for r in [
    CASE WHEN hazard_count_100km > 0 AND nearest_hazard_type <> 'None' THEN
      CASE WHEN nearest_hazard_distance_km <= 10
        THEN 'A ' || nearest_hazard_type || ' is within ' || km || ' km of your location'
      WHEN nearest_hazard_distance_km <= 50
        THEN 'A ' || nearest_hazard_type || ' is ' || km || ' km away — moderately close'
      WHEN nearest_hazard_distance_km IS NOT NULL
        THEN 'A ' || nearest_hazard_type || ' is reported ' || km || ' km away' END END,
    CASE WHEN hazard_count_100km > 1
      THEN 'There are ' || hazard_count_100km || ' active hazards in the broader area' END,
    CASE WHEN wind_speed >= 60 THEN 'Wind speed is ' || wind || ' km/h — extreme winds amplify risk'
      WHEN wind_speed >= 30
        THEN 'Wind speed is ' || wind || ' km/h — moderate winds may carry hazard effects' END,
    CASE WHEN temp_1h_change >= 3
        THEN 'Temperature is rising sharply, indicating worsening conditions'
      WHEN temp_1h_change <= -3
        THEN 'Temperature is dropping, which may indicate improving conditions' END
  ] if r IS NOT NULL] AS reasons
FROM risk""",
    "explained": """
SELECT location_id, timestamp, recommendation, risk_band, risk_score,
  upper(reasons[1][1]) || lower(reasons[1][2:]) AS big1,
  upper(reasons[2][1]) || lower(reasons[2][2:]) AS big2,
  CASE WHEN risk_score <= 39 THEN
    CASE WHEN len(reasons) = 0 THEN 'Conditions appear safe for outdoor activity.'
      ELSE 'Conditions are generally safe, but note: ' || lower(reasons[1]) || '.' END
  WHEN risk_score <= 69 THEN
    CASE WHEN len(reasons) = 0 THEN 'Caution is advised for outdoor activity.'
      WHEN len(reasons) = 1 THEN 'Caution advised: ' || lower(reasons[1])
      ELSE 'Caution advised: ' || lower(reasons[1]) || ' Additionally, ' || lower(reasons[2]) || '.' END
  ELSE
    CASE WHEN len(reasons) = 0 THEN 'Avoid outdoor activity today.'
      WHEN len(reasons) = 1 THEN 'Avoid outdoor activity today. ' || big1
        || '. Conditions are likely to worsen before they improve.'
      ELSE 'Avoid outdoor activity today. ' || big1 || ' ' || big2
        || '. Conditions are likely to worsen before they improve.' END
  END AS summary,
  array_to_string(reasons[1:3], '; ') AS top_reasons,
  CASE WHEN hazard_count_100km > 0 THEN CAST(0.85 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS confidence,
  'rules' AS provider
FROM reasoned""",
    "requests": """
SELECT n_nationkey AS request_id, concat('  ', lower(substr(n_name, 1, 3))) AS text FROM nation
UNION ALL SELECT 1000 + s_suppkey, concat('Site ', s_suppkey) FROM supplier
UNION ALL SELECT 500 + r_regionkey, substr(r_name, 1, 1) FROM region""",
    "named": """
SELECT location_id, latitude, longitude, location_name, lower(location_name) AS name FROM locations
UNION SELECT location_id, latitude, longitude, location_name, lower(city) FROM locations""",
    "nearby_hazards": f"""
SELECT l.location_id, h.event_id AS id, h.category, h.title,
  round({_km('h.latitude', 'h.longitude', 'l.latitude', 'l.longitude')}, 1) AS distance_km
FROM locations l CROSS JOIN active h
QUALIFY row_number() OVER (PARTITION BY l.location_id ORDER BY distance_km, id) <= 50""",
    "nearby_quakes": f"""
SELECT l.location_id, q.id, 'Earthquakes' AS category, q.title,
  round({_km('q.latitude', 'q.longitude', 'l.latitude', 'l.longitude')}, 1) AS distance_km
FROM locations l CROSS JOIN raw_quakes q WHERE NOT starts_with(q.id, 'mock_')
QUALIFY row_number() OVER (PARTITION BY l.location_id ORDER BY distance_km, id) <= 20""",
}

# The same steps from landed documents: readings on the hour, a grid for each location, current
# conditions where there is none.
STEPS |= {
    "current_rows": f"""
SELECT location_id, on_time AS forecast_timestamp, CAST(location_id % 40 AS DOUBLE) AS temperature,
  CAST(75 AS DOUBLE) AS humidity, CAST(location_id % 70 AS DOUBLE) AS wind_speed,
  CAST(CASE WHEN location_id % 5 = 0 THEN 0 ELSE location_id % 360 END AS DOUBLE) AS wind_direction,
  CAST(0 AS DOUBLE) AS precipitation, CAST(1001.5 AS DOUBLE) AS pressure, {_UV} AS uv_index,
  CASE WHEN location_id % 11 = 0 THEN 'Clear' ELSE 'Light Rain' END AS condition_text
FROM (SELECT *, {_sun('on_time')} AS height FROM (
  SELECT *, TIMESTAMP '2024-01-01' + to_minutes(CAST(location_id AS INT)) AS on_time FROM locations))
WHERE location_id % 17 <> 0""",
    "doc_readings": f"""
SELECT location_id, seq, on_time AS forecast_timestamp, temperature, humidity, wind_speed,
  CASE WHEN seq % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE wind_direction END AS wind_direction,
  (CASE WHEN seq % 2 = 0 THEN precipitation ELSE 0 END) + (CASE WHEN seq % 7 = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END)
    AS precipitation, pressure, {_UV} AS uv_index,
  CASE WHEN seq % 11 = 0 THEN 'Clear' ELSE condition_text END AS condition_text
FROM (SELECT *, {_sun('on_time')} AS height FROM (
  SELECT w.*, date_trunc('hour', forecast_timestamp) AS on_time, latitude, longitude
  FROM raw_weather w JOIN locations USING (location_id)))
WHERE location_id % 10 <> 0 AND seq % 19 <> 0 AND seq % 13 <> 0""",
    "doc_hourly_weather": "SELECT * FROM doc_readings " + _LAST.format("location_id, forecast_timestamp", "seq"),
}


def _renamed(steps: list[str]) -> dict[str, str]:
    """Steps that read each other's documents variant."""
    names = "|".join(["hourly_weather", "clean_weather", *steps])
    return {
        f"doc_{step}": re.sub(rf"\b(FROM|JOIN)\s+({names})\b", r"\1 doc_\2", STEPS[step]) for step in steps
    }


STEPS |= _renamed(["hours", "gridded", "anchored"])
STEPS |= {
    "doc_weather": "SELECT location_id, forecast_timestamp, condition_text, "
    + ", ".join(f"{_between(c)} AS {c}" for c in _RESAMPLED)
    + " FROM doc_anchored UNION ALL SELECT location_id, forecast_timestamp, condition_text, "
    + ", ".join(_RESAMPLED)
    + " FROM current_rows WHERE location_id NOT IN (SELECT location_id FROM doc_hourly_weather)",
    "doc_clean_weather": """
SELECT location_id, location_id * 10000000 + CAST(floor(epoch(forecast_timestamp) / 3600) AS BIGINT) AS seq,
  forecast_timestamp, coalesce(temperature, 25) AS temperature,
  coalesce(humidity, 50) AS humidity, coalesce(wind_speed, 0) AS wind_speed,
  coalesce(wind_direction, 0) AS wind_direction, coalesce(precipitation, 0) AS precipitation,
  coalesce(pressure, 1013) AS pressure, coalesce(uv_index, 0) AS uv_index, condition_text
FROM doc_weather""",
}
STEPS |= _renamed(["trends", "back", "ahead", "matched", "features", "risk"])
STEPS["labelled"] = """
SELECT *, lead(risk_score, 6) OVER w AS risk_6h, lead(risk_score, 12) OVER w AS risk_12h,
  (location_id % 1000003 * 7919 + CAST(floor(epoch(timestamp)) AS BIGINT) % 1000003 * 104729 + 42)
    % 1000003 % 100 < 20 AS tested
FROM risk WINDOW w AS (PARTITION BY location_id ORDER BY timestamp)"""

_FEATURE_OUT = """location_id, timestamp, hazard_count_10km, hazard_count_50km, hazard_count_100km,
  nearest_hazard_distance_km, nearest_hazard_type, hazard_types, temperature, humidity, wind_speed,
  wind_direction, precipitation, pressure, uv_index, wind_alignment_score, aqi, co, so2,
  max_eq_magnitude, hour, day_of_week, weekend, round(temp_3h_avg, 4) AS temp_3h_avg,
  round(temp_6h_avg, 4) AS temp_6h_avg, round(temp_1h_change, 4) AS temp_1h_change,
  round(temp_3h_change, 4) AS temp_3h_change, round(wind_3h_avg, 4) AS wind_3h_avg,
  round(wind_1h_change, 4) AS wind_1h_change, round(precip_3h_sum, 4) AS precip_3h_sum"""

_COMPONENTS = """c_hazard AS component_hazard, c_proximity AS component_proximity,
  c_weather AS component_weather, c_trend AS component_trend, c_multi AS component_multi_hazard,
  c_air AS component_air_quality"""

_INT_COUNTS = "hazard_count_10km, hazard_count_50km, hazard_count_100km"

QUERIES = {
    "active_hazards": "SELECT event_id, category, title, latitude, longitude, event_timestamp "
    "FROM clean_hazards WHERE status = 'open'",
    "open_unknown_hazards": "SELECT seq, event_id, status FROM raw_hazards WHERE status IN ('open', 'unknown')",
    "hazard_feed": "SELECT event_id, seq, event_timestamp FROM clean_hazards WHERE status = 'open' "
    "ORDER BY event_timestamp DESC, event_id LIMIT 100",
    "valid_coordinates": "SELECT seq, latitude, longitude FROM raw_hazards "
    "WHERE latitude >= -90 AND latitude <= 90 AND longitude >= -180 AND longitude <= 180",
    "clean_hazards": "SELECT * FROM clean_hazards",
    "clean_weather": "SELECT * FROM clean_weather",
    "parsed_timestamps": "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN "
    "date_trunc('day', o_orderdate) WHEN 1 THEN date_trunc('second', o_orderdate) END AS parsed FROM orders",
    "hazard_categories": "SELECT DISTINCT category FROM all_hazards",
    "hazard_json_flatten": """
SELECT seq, event_id, CASE WHEN seq % 7 = 0 THEN 'Unknown' ELSE category END AS category,
  CASE WHEN seq % 11 = 0 THEN '' ELSE title END AS title, 'open' AS status,
  date_trunc('second', event_timestamp) AS event_timestamp, latitude, longitude
FROM raw_hazards WHERE longitude IS NOT NULL""",
    "forecast_json_flatten": f"""
SELECT location_id, seq, date_trunc('second', forecast_timestamp) AS forecast_timestamp, temperature,
  humidity, wind_speed, CASE WHEN seq % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE wind_speed + 5 END AS wind_gust,
  CASE WHEN seq % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE wind_direction END AS wind_direction,
  (CASE WHEN seq % 2 = 0 THEN precipitation ELSE 0 END) + (CASE WHEN seq % 7 = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END)
    AS precipitation, pressure, {_UV} AS uv_index,
  CASE WHEN seq % 11 = 0 THEN 'Clear' ELSE condition_text END AS condition_text
FROM (SELECT w.*, latitude, longitude, {_sun('forecast_timestamp')} AS height
  FROM raw_weather w JOIN locations USING (location_id))""",
    "current_weather_fallback": """
SELECT location_id, forecast_timestamp, temperature, humidity, wind_speed, wind_direction, precipitation,
  pressure, condition_text FROM raw_weather
UNION ALL SELECT location_id, forecast_timestamp, temperature, humidity, wind_speed, wind_direction,
  precipitation, pressure, condition_text FROM current_rows
WHERE location_id NOT IN (SELECT location_id FROM raw_weather)""",
    "air_json_flatten": """
SELECT location_id, seq, date_trunc('second', timestamp) AS timestamp, aqi,
  CASE aqi WHEN 1 THEN 'Good' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Moderate' WHEN 4 THEN 'Poor'
    WHEN 5 THEN 'Very Poor' ELSE 'Unknown' END AS aqi_label,
  CASE WHEN seq % 4 = 0 THEN CAST(0 AS DOUBLE) ELSE co END AS co, so2, CAST(0 AS DOUBLE) AS nh3 FROM raw_air""",
    "quake_json_flatten": """
SELECT id, CASE WHEN seq % 3 = 0 THEN 'Earthquake' ELSE title END AS title,
  CASE WHEN seq % 8 = 4 THEN NULL ELSE magnitude END AS magnitude,
  CASE WHEN seq % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE depth_km END AS depth_km, latitude, longitude,
  date_trunc('millisecond', timestamp) AS timestamp, 'open' AS status, 'Earthquakes' AS category
FROM raw_quakes""",
    "quality_report": """
SELECT CAST((SELECT count(*) FROM raw_hazards) AS BIGINT) AS rows_in,
  CAST((SELECT count(*) - count(DISTINCT event_id) FROM raw_hazards) AS BIGINT) AS duplicate_rows,
  CAST((SELECT count(DISTINCT event_id) FROM raw_hazards) - (SELECT count(*) FROM clean_hazards) AS BIGINT)
    AS invalid_coordinate_rows,
  CAST((SELECT count(*) FROM clean_hazards) AS BIGINT) AS rows_out""",
    "score_quality": "SELECT count(*) FILTER (WHERE risk_score BETWEEN 0 AND 100) AS valid_scores, "
    "count(*) FILTER (WHERE (risk_score BETWEEN 0 AND 100) IS NOT TRUE) AS invalid_scores FROM risk",
    "location_slug": "SELECT p_partkey, replace(replace(replace(replace(lower(p_type || ' (' || p_brand || '), ' "
    "|| p_name), ' ', '_'), ',', ''), '(', ''), ')', '') AS slug, "
    "replace(replace(lower(p_type || ' (' || p_brand || '), ' || p_name), ' ', '_'), ',', '') AS open_slug FROM part",
    "aqi_labels": "SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'Good' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Moderate' "
    "WHEN 4 THEN 'Poor' WHEN 5 THEN 'Very Poor' ELSE 'Unknown' END AS label FROM events",
    "risk_marks": "SELECT c_custkey, CASE WHEN c_acctbal <= 39 THEN 'green' WHEN c_acctbal <= 69 THEN 'orange' "
    "ELSE 'red' END AS colour, CASE c_custkey % 4 WHEN 0 THEN 'Safe' WHEN 1 THEN 'Caution' WHEN 2 THEN 'Avoid' "
    "ELSE '?' END AS mark, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(c_custkey AS INT)), "
    "'%Y-%m-%d %H:%M UTC') AS stamp FROM customer",
    "reasons_decode": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, '; ', c_mktsegment) "
    "ELSE c_name END AS reasons, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM customer",
    "time_features": "SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week, "
    "CAST(CASE WHEN isodow(ts) IN (6, 7) THEN 1 ELSE 0 END AS INT) AS weekend FROM events",
    "uv_index": f"SELECT seq, {_UV} AS uv FROM (SELECT seq, latitude, longitude, {_sun('forecast_timestamp')} "
    "AS height FROM raw_weather JOIN locations USING (location_id))",
    "hourly_resample": "SELECT location_id, forecast_timestamp, condition_text, "
    + ", ".join(f"round({_between(c)}, 8) AS {c}" for c in _RESAMPLED)
    + " FROM anchored",
    "trend_features": "SELECT location_id, forecast_timestamp, round(temp_3h_avg, 4) AS temp_3h_avg, "
    "round(temp_6h_avg, 4) AS temp_6h_avg, round(temp_1h_change, 4) AS temp_1h_change, "
    "round(temp_3h_change, 4) AS temp_3h_change, round(wind_3h_avg, 4) AS wind_3h_avg, "
    "round(wind_1h_change, 4) AS wind_1h_change, round(precip_3h_sum, 4) AS precip_3h_sum FROM trends",
    "target_distance": "SELECT seq, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN round("
    + _km("latitude", "longitude", "CAST(19.076 AS DOUBLE)", "CAST(72.8777 AS DOUBLE)")
    + ", 2) END AS distance_km FROM raw_hazards",
    "hazard_bands": f"SELECT location_id, {_INT_COUNTS} FROM counted",
    "hazard_types_near": "SELECT location_id, hazard_types FROM counted",
    "nearest_hazard": "SELECT location_id, nearest_hazard_distance_km, nearest_hazard_type FROM closest",
    "hazards_with_quakes": "SELECT feed, seq, id, category, latitude, longitude, magnitude FROM all_hazards",
    "max_quake_100km": f"""
SELECT l.location_id, coalesce(max(q.magnitude) FILTER (WHERE
  {_km('q.latitude', 'q.longitude', 'l.latitude', 'l.longitude')} <= 100), 0) AS max_eq_magnitude
FROM locations l CROSS JOIN raw_quakes q GROUP BY l.location_id""",
    "quakes_near": f"""
SELECT l.location_id, q.id, q.title, q.magnitude, q.timestamp,
  round({_km('q.latitude', 'q.longitude', 'l.latitude', 'l.longitude')}, 2) AS distance_km
FROM locations l CROSS JOIN raw_quakes q
WHERE q.magnitude >= 2.5 AND {_km('q.latitude', 'q.longitude', 'l.latitude', 'l.longitude')} <= 300
QUALIFY row_number() OVER (PARTITION BY l.location_id ORDER BY q.timestamp DESC, q.id) <= 50""",
    "wind_alignment": "SELECT location_id, timestamp, wind_alignment_score FROM features",
    "wind_alignment_first": """
SELECT w.seq, fmod(fmod(degrees(atan2(h.latitude - l.latitude, h.longitude - l.longitude)), 360) + 360, 360) AS angle,
  abs(angle - fmod(w.wind_direction, 360)) AS turn,
  round(greatest(0, 1 - least(turn, 360 - turn) / CAST(180 AS DOUBLE)) * 100, 2) AS wind_alignment_score
FROM clean_weather w JOIN locations l USING (location_id)
CROSS JOIN (SELECT * FROM all_hazards ORDER BY feed, seq LIMIT 1) h""",
    "asof_air_quality": "SELECT location_id, forecast_timestamp, seq, aqi, co, so2 FROM matched",
    "feature_table": f"SELECT {_FEATURE_OUT} FROM features",
    "score_components": f"SELECT location_id, timestamp, {_COMPONENTS}, c_quake AS component_earthquake FROM risk",
    "risk_scores": "SELECT location_id, timestamp, risk_score, risk_band, recommendation FROM risk",
    "risk_band_histogram": "SELECT risk_band, count(*) AS rows FROM risk GROUP BY risk_band",
    "risk_summary": "SELECT round(avg(risk_score), 1) AS mean_score, round(min(risk_score), 1) AS min_score, "
    "round(max(risk_score), 1) AS max_score FROM risk",
    "source_counts": "SELECT 'hazards' AS source, count(*) AS rows FROM clean_hazards UNION ALL "
    "SELECT 'weather', count(*) FROM clean_weather UNION ALL SELECT 'risk', count(*) FROM risk",
    "locations_with_data": "SELECT location_id, location_id IN (SELECT location_id FROM raw_weather) AS has_data "
    "FROM locations",
    "current_risk_view": """
SELECT location_name, city, region, timestamp, risk_score, risk_band, recommendation, hazard_count_10km,
  hazard_count_50km, nearest_hazard_distance_km, nearest_hazard_type, summary AS explanation_text
FROM risk JOIN explained USING (location_id, timestamp, risk_score, risk_band, recommendation)
JOIN locations USING (location_id) WHERE timestamp = (SELECT max(timestamp) FROM risk)""",
    "risk_trend_view": "SELECT location_id, timestamp, risk_score, risk_band, predicted_risk_6h, "
    "predicted_risk_12h FROM held",
    "current_risk": "SELECT location_id, timestamp, risk_score, risk_band, recommendation FROM risk "
    + _LAST.format("location_id", "timestamp"),
    "risk_card": "SELECT location_id, risk_score AS score, risk_band AS band, recommendation, "
    "CASE WHEN risk_score <= 39 THEN 'green' WHEN risk_score <= 69 THEN 'orange' ELSE 'red' END AS color, "
    f"CASE WHEN risk_band = 'Unknown' THEN '?' ELSE risk_band END AS emoji, {_INT_COUNTS}, "
    f"nearest_hazard_distance_km, nearest_hazard_type, {_COMPONENTS}, c_quake AS component_earthquake FROM risk "
    + _LAST.format("location_id", "timestamp"),
    "latest_weather": "SELECT location_id, seq, temperature, humidity, wind_speed, pressure, uv_index, "
    "condition_text FROM raw_weather " + _LAST.format("location_id", "forecast_timestamp"),
    "latest_air_quality": "SELECT location_id, seq, aqi, co, so2 FROM raw_air "
    + _LAST.format("location_id", "timestamp"),
    "forecast_last48": "SELECT location_id, timestamp, risk_score FROM risk QUALIFY row_number() OVER "
    "(PARTITION BY location_id ORDER BY timestamp DESC) <= 48",
    "weather_chart": "SELECT location_id, forecast_timestamp, temperature, wind_speed, precipitation FROM clean_weather",
    "hazard_map_top50": "SELECT * FROM nearby_hazards",
    "hazard_quake_map": """
SELECT location_id, id, category, title, distance_km
FROM (SELECT *, 0 AS feed FROM nearby_hazards UNION ALL SELECT *, 1 FROM nearby_quakes)
QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY distance_km, feed, id) <= 50""",
    "forecast_metrics": "SELECT location_id, round(predicted_risk_6h, 1) AS risk_6h, "
    "round(predicted_risk_12h, 1) AS risk_12h, CASE WHEN predicted_risk_12h > predicted_risk_6h THEN 'worsening' "
    "ELSE 'improving' END AS trend FROM held " + _LAST.format("location_id", "timestamp"),
    "horizon_labels_lag": "SELECT location_id, timestamp, predicted_risk_6h AS risk_6h, "
    "predicted_risk_12h AS risk_12h FROM held",
    "horizon_labels_lead": "SELECT location_id, timestamp, lead(risk_score, 6) OVER w AS risk_6h, "
    "lead(risk_score, 12) OVER w AS risk_12h FROM risk WINDOW w AS (PARTITION BY location_id ORDER BY timestamp)",
    "model_features": "SELECT location_id, timestamp, "
    + ", ".join(
        f"CAST({c} AS DOUBLE) AS {c}"
        for c in (
            "hazard_count_10km", "hazard_count_50km", "hazard_count_100km", "temperature", "humidity",
            "wind_speed", "precipitation", "pressure", "uv_index", "hour", "day_of_week", "weekend",
            "wind_alignment_score",
        )
    )
    + ", coalesce(nearest_hazard_distance_km, 0) AS nearest_hazard_distance_km, "
    "round(coalesce(temp_1h_change, 0), 4) AS temp_1h_change, round(coalesce(temp_3h_change, 0), 4) AS temp_3h_change, "
    "round(coalesce(wind_1h_change, 0), 4) AS wind_1h_change FROM features",
    "forecast_errors": """
SELECT count(*) AS n, round(avg(abs(risk_score - predicted_risk_6h)), 3) AS mae,
  round(sqrt(avg(pow(risk_score - predicted_risk_6h, 2))), 3) AS rmse,
  round(1 - sum(pow(risk_score - predicted_risk_6h, 2)) / (count(*) * var_pop(risk_score)), 3) AS r2
FROM held WHERE predicted_risk_6h IS NOT NULL""",
    "explanations": "SELECT location_id, timestamp, recommendation, risk_band, risk_score, summary, top_reasons, "
    "confidence, provider FROM explained",
    "latest_explanation": "SELECT location_id, summary, top_reasons FROM explained "
    + _LAST.format("location_id", "timestamp"),
    "explain_prompts": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat(
'You are an environmental safety advisor. Given the following data, provide a recommendation.

Location: Mumbai
Current risk score: ', printf('%.1f', risk_score), '/100
Risk band: ', risk_band, '
Active hazards within 100 km: ', coalesce(hazard_types, 'None'), '
Nearest hazard: None at ', CASE WHEN nearest_hazard_distance_km IS NULL THEN 'N/A'
  ELSE printf('%.1f', nearest_hazard_distance_km) END, ' km
Current weather: N/A°C, wind ', printf('%.1f', wind_speed), ' km/h, humidity ', printf('%.1f', humidity), '%
6h forecast risk: N/A
12h forecast risk: N/A

Provide:
1. Recommendation label (one of: Go now, Safe with caution, Wait until later, Avoid today)
2. Confidence score (0-1)
3. One short paragraph explaining the reasoning
4. Top 3 contributing factors

Respond in JSON format with keys: recommendation, confidence, explanation, top_reasons.') AS prompt
FROM bulk_scored""",
    "reply_decode": """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'Go now' END AS recommendation,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 100) / CAST(100 AS DOUBLE) END AS confidence,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS explanation,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat(c_mktsegment, '; wind') END AS top_reasons
FROM customer""",
    "seed_locations_merge": """
SELECT location_id, location_name, city FROM locations UNION ALL
SELECT 0, 'Mumbai Central', 'Mumbai' WHERE 0 NOT IN (SELECT location_id FROM locations)
UNION ALL SELECT 1, 'Mumbai Central', 'Mumbai' WHERE 1 NOT IN (SELECT location_id FROM locations)""",
    "align_schema": """
SELECT forecast_timestamp, temperature, humidity, wind_speed, CAST(NULL AS DOUBLE) AS wind_gust, wind_direction,
  precipitation, pressure, uv_index, condition_text, location_id, 'openweathermap' AS source_name
FROM raw_weather""",
    "migrate_schema": "SELECT location_id, timestamp, CAST(0 AS DOUBLE) AS component_air_quality, "
    "CAST(0 AS DOUBLE) AS max_eq_magnitude, CAST(NULL AS INT) AS aqi, CAST(0.8 AS DOUBLE) AS confidence_score "
    "FROM (SELECT user_id AS location_id, ts AS timestamp FROM events)",
    "place_lookup": """
SELECT r.request_id, r.text, n.location_id, n.location_name AS place_name, CAST(row_number() OVER
  (PARTITION BY r.request_id ORDER BY n.location_id) AS INT) AS rank
FROM requests r JOIN (SELECT DISTINCT location_id, location_name, request_id FROM named
  JOIN requests ON starts_with(name, lower(trim(text)))) n ON r.request_id = n.request_id
WHERE length(trim(r.text)) >= 2 QUALIFY rank <= 5""",
    "requested_locations": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE "
    "concat(CAST(c_custkey % 90 AS VARCHAR), ', ', CAST(c_custkey % 180 AS VARCHAR)) END AS name, "
    "CAST(c_custkey % 90 AS DOUBLE) AS latitude, CAST(c_custkey % 180 AS DOUBLE) AS longitude "
    "FROM customer WHERE c_acctbal >= 0",
    "bulk_row_scoring": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, risk_score, risk_band, "
    "recommendation FROM bulk_scored",
    "short_key_scoring": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_hazard AS component_hazard, "
    "risk_score FROM bulk_short",
    "latest_snapshot": "SELECT seq, event_id, date_trunc('day', event_timestamp) AS snapshot FROM raw_hazards "
    "WHERE date_trunc('day', event_timestamp) = (SELECT max(date_trunc('day', event_timestamp)) FROM raw_hazards)",
    "latest_snapshot_per_location": "SELECT location_id, seq FROM raw_weather QUALIFY date_trunc('day', "
    "forecast_timestamp) = max(date_trunc('day', forecast_timestamp)) OVER (PARTITION BY location_id)",
    "stored_locations": "SELECT location_id, location_name, latitude, longitude, "
    "replace(lower(location_name), ' ', '_') AS location_slug FROM locations",
    "loaded_hazards": "SELECT event_id, category, title, status, event_timestamp, latitude, longitude FROM clean_hazards",
    "landed_documents": """
SELECT event_id, CASE WHEN seq % 7 = 0 THEN 'Unknown' ELSE category END AS category,
  CASE WHEN seq % 11 = 0 THEN '' ELSE title END AS title, 'open' AS status,
  date_trunc('second', event_timestamp) AS event_timestamp, latitude, longitude
FROM raw_hazards WHERE longitude IS NOT NULL""",
    "newest_snapshot": "SELECT seq, event_id, strftime(event_timestamp, '%Y-%m-%d') AS snapshot FROM raw_hazards "
    "WHERE date_trunc('day', event_timestamp) = (SELECT max(date_trunc('day', event_timestamp)) FROM raw_hazards)",
    "one_location_scan": "SELECT location_id, seq, forecast_timestamp FROM raw_weather WHERE location_id = 7",
    "served_forecast": "SELECT location_id, timestamp, risk_score, risk_band FROM risk QUALIFY row_number() OVER "
    "(PARTITION BY location_id ORDER BY timestamp DESC) <= 48",
    "stored_components": "SELECT location_id, timestamp, c_quake AS component_earthquake, true AS adds_up FROM risk",
    "documents_to_facts": "SELECT location_id, timestamp, round(temperature, 6) AS temperature, "
    "round(wind_speed, 6) AS wind_speed, aqi, risk_score, risk_band FROM doc_risk",
    "rejected_documents": """
SELECT 'forecast' AS feed, CASE WHEN seq % 19 = 0 AND location_id % 10 <> 0 THEN 'missing' ELSE 'malformed' END
  AS reason, count(*) AS documents
FROM raw_weather WHERE (seq % 19 = 0 AND location_id % 10 <> 0) OR seq % 13 = 0 GROUP BY ALL
UNION ALL SELECT 'current', 'malformed', count(*) FROM locations WHERE location_id % 17 = 0 GROUP BY ALL""",
    "enriched_weather": "SELECT location_id, 'openweathermap' AS source_name, count(*) AS hours, "
    "count(*) AS stamped FROM doc_weather GROUP BY location_id",
    "chosen_explanations": """
SELECT location_id, timestamp, risk_band, risk_score,
  CASE WHEN location_id % 3 = 0 THEN 'Wait until later' ELSE recommendation END AS recommendation,
  CASE WHEN location_id % 3 = 0 THEN concat('Score ', risk_band) ELSE summary END AS summary,
  CASE WHEN location_id % 3 = 0 AND hour(timestamp) % 4 <> 0 THEN concat(risk_band, '; air') ELSE top_reasons END
    AS top_reasons,
  CASE WHEN location_id % 3 = 0 THEN risk_score / 200 ELSE confidence END AS confidence,
  CASE WHEN location_id % 3 = 0 THEN 'model' ELSE provider END AS provider
FROM explained""",
    "forecast_quality": "\nUNION ALL ".join(
        f"SELECT 'risk_{n}h' AS target, count(risk_{n}h) FILTER (WHERE NOT tested) AS n_train, "
        f"count(risk_{n}h) FILTER (WHERE tested) AS n_test, true AS mae_within_rmse, true AS beats_mean, "
        f"true AS explains FROM labelled"
        for n in (6, 12)
    ),
    "rf_forecast": "SELECT location_id, timestamp, risk_score, true AS predicted_risk_6h_ok, true AS predicted_risk_12h_ok, "
    "true AS first_risk_6h_kept, true AS first_risk_12h_kept FROM risk",
    "location_refresh_times": "SELECT replace(lower(location_name), ' ', '_') AS location_slug, true AS fresh, "
    "true AS as_shown FROM locations",
    "forecast_rows": "SELECT location_id, timestamp, risk_score, true AS predicted_risk_6h_ok, "
    "true AS predicted_risk_12h_ok FROM risk",
    "sql_query": "SELECT city, count(*) AS locations, round(max(latitude), 2) AS northmost FROM locations GROUP BY city",
    "refresh_stream": "SELECT event_id, seq, category, status, latitude, longitude FROM clean_hazards",
    "stream_scoring": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, risk_score, risk_band FROM bulk_scored",
    "refreshed_risk": "SELECT location_id, timestamp, risk_score, risk_band FROM risk",
}
QUERIES["active_hazards_view"] = QUERIES["active_hazards"]
QUERIES["split_risk_scores"] = QUERIES["risk_scores"]

# Helper columns some statements define for their own use.
_HIDDEN = {"wind_alignment_first": ("angle", "turn")}


def _query(name: str) -> str:
    body = QUERIES[name]
    if name in _HIDDEN:
        body = f"SELECT * EXCLUDE ({', '.join(_HIDDEN[name])}) FROM ({body})"
    needed: list[str] = []

    def visit(text: str) -> None:
        for step in STEPS:
            used = re.search(rf"\b(?:FROM|JOIN)\s+{step}\b", text)
            if used and step not in needed:
                visit(STEPS[step])
                needed.append(step)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{step} AS ({STEPS[step]})" for step in needed) + "\n" + body


SQL = {name: _query(name) for name in QUERIES}
