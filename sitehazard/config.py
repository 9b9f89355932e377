"""Rule settings, folded into the plans as literals."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Band:
    low: float
    high: float
    label: str
    advice: str


# Rule weights, thresholds, bands and scores that the results depend on.

HAZARD_WEIGHTS = {
    "Wildfires": 30.0,
    "Severe Storms": 28.0,
    "Floods": 28.0,
    "Volcanoes": 30.0,
    "Dust and Haze": 22.0,
    "Landslides": 25.0,
    "Droughts": 15.0,
    "Extreme Temperature": 20.0,
    "Sea and Lake Ice": 10.0,
}

# The same weights under short keys. Feed categories are titles, so with these keys every
# category falls through to the default weight.
SHORT_KEY_WEIGHTS = {
    "wildfires": 30.0,
    "severeStorms": 28.0,
    "floods": 28.0,
    "volcanoes": 30.0,
    "dustHaze": 22.0,
    "landslides": 25.0,
    "droughts": 15.0,
    "extremeTemperature": 20.0,
    "seaLakeIce": 10.0,
}

RISK_BANDS = (
    Band(0, 39, "Safe", "Go now"),
    Band(40, 69, "Caution", "Safe with caution"),
    Band(70, 100, "Avoid", "Avoid today"),
)


@dataclass(frozen=True)
class RiskRules:
    hazard_weights: dict[str, float] = field(default_factory=lambda: dict(HAZARD_WEIGHTS))
    default_weight: float = 15.0
    bands_km: tuple[float, ...] = (10.0, 50.0, 100.0)
    band_scores: tuple[float, ...] = (25.0, 15.0, 5.0)
    hazard_step: float = 5.0
    hazard_step_cap: float = 15.0
    high_wind: float = 30.0
    high_wind_score: float = 10.0
    extreme_wind: float = 60.0
    extreme_wind_score: float = 20.0
    high_humidity: float = 70.0
    high_humidity_score: float = 5.0
    heavy_rain: float = 10.0
    heavy_rain_score: float = 10.0
    warming: float = 5.0
    warming_score: float = 10.0
    cooling: float = -5.0
    cooling_score: float = -5.0
    # None leaves a term out of the score.
    poor_air_index: float | None = 4.0
    poor_air_score: float = 25.0
    fair_air_index: float | None = 3.0
    fair_air_score: float = 15.0
    co_limit: float | None = 10.0
    co_score: float = 5.0
    so2_limit: float | None = 20.0
    so2_score: float = 5.0
    quake_steps: tuple[tuple[float, float], ...] = ((6.0, 15.0), (5.0, 10.0), (4.0, 5.0))
    risk_bands: tuple[Band, ...] = RISK_BANDS


DEFAULT_RULES = RiskRules()
SHORT_KEY_RULES = RiskRules(hazard_weights=dict(SHORT_KEY_WEIGHTS))

WEATHER_DEFAULTS = {
    "temperature": 25.0,
    "humidity": 50.0,
    "wind_speed": 0.0,
    "wind_direction": 0.0,
    "precipitation": 0.0,
    "pressure": 1013.0,
    "uv_index": 0.0,
}

HOME_SITE = {
    "location_id": 1,
    "location_name": "Mumbai Central",
    "latitude": 19.0760,
    "longitude": 72.8777,
    "city": "Mumbai",
    "region": "Maharashtra",
    "country": "India",
}

WEATHER_PROVIDER = "openweathermap"
AIR_MATCH_HOURS = 3
QUAKE_REACH_KM = 300.0
QUAKE_MIN_MAGNITUDE = 2.5
QUAKE_FEED_LIMIT = 50
HAZARD_FEED_LIMIT = 100
MAP_LIMIT = 50
MAP_QUAKE_LIMIT = 20
FORECAST_LIMIT = 48
PLACE_LIMIT = 5
HORIZONS = {"risk_6h": 6, "risk_12h": 12}

FOREST = {"numTrees": 100, "maxDepth": 10, "seed": 42, "featureSubsetStrategy": "all"}
TEST_PERCENT = 20
MIN_TRAINING_ROWS = 10


@dataclass(frozen=True)
class Sizing:
    """Bounds the plans are chosen by. They steer the strategy, never the result."""

    # A key with more rows than this is split over several tasks.
    rows_per_task: int = 1_000_000
    # A grid cell with more distinct points than this is refined.
    points_per_cell: int = 4_096


DEFAULT_SIZING = Sizing()
