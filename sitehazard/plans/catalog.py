"""Every operator as a query over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitehazard.config import (
    DEFAULT_SIZING,
    HAZARD_FEED_LIMIT,
    HOME_SITE,
    HORIZONS,
    SHORT_KEY_RULES,
    Sizing,
)
from sitehazard.functions import text
from sitehazard.functions.scoring import with_risk
from sitehazard.functions.solar import uv_index
from sitehazard.operators import cleaning, explain, features, forecast, serving, spatial
from sitehazard.operators.series import (
    horizon_labels,
    hourly_grid,
    match_nearest,
    time_features,
    trend_features,
)
from sitehazard.operators.skew import HotKeys, Series, bring_together, hot_keys, measure_series
from sitehazard.plans import documents, pipeline, views
from sitehazard.schemas import add_missing_columns, align_to_table
from sitehazard.session import shared_path, tune
from sitehazard.sources import feeds, tables
from sitehazard.sources.derived import feed, project, table
from sitehazard.streaming import refresh as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

GRID = [
    "temperature", "humidity", "wind_speed", "wind_direction", "precipitation", "pressure",
    "uv_index",
]
TRENDS = [
    "temp_3h_avg", "temp_6h_avg", "temp_1h_change", "temp_3h_change", "wind_3h_avg",
    "wind_1h_change", "precip_3h_sum",
]
#: Bounds so low that the test tables exceed them.
SMALL = Sizing(rows_per_task=60, points_per_cell=8)
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


class Tables:
    """The derived feeds of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("locations", "raw_hazards", "raw_quakes", "raw_weather", "raw_air", "bulk_rows"):
            return feed(self.spark, self.folder, name)
        return table(self.spark, self.folder, name)

    def inputs(self) -> pipeline.Inputs:
        return pipeline.Inputs(
            self.locations, self.raw_hazards, self.raw_quakes, self.raw_weather, self.raw_air
        )

    def feeds(self) -> list[DataFrame]:
        return [self.locations, self.raw_hazards, self.raw_quakes, self.raw_weather, self.raw_air]

    def risk(self) -> DataFrame:
        return features.risk_table(*self.feeds())

    def all_hazards(self) -> DataFrame:
        return features.hazards_and_quakes(self.raw_hazards, self.raw_quakes)

    def hot_locations(self) -> HotKeys | None:
        return hot_keys(self.raw_weather, "location_id", DEFAULT_SIZING.rows_per_task)

    def risk_series(self) -> Series:
        series = _weather_series(self)
        return Series("location_id", "timestamp", series.cuts, series.hot)

    def held(self) -> DataFrame:
        """Risk rows with a persistence forecast: the score 6 and 12 rows earlier."""
        names = {f"predicted_{target}": rows for target, rows in HORIZONS.items()}
        return horizon_labels(self.risk(), self.risk_series(), "risk_score", names, "lag")


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def unzoned(*names: str) -> dict[str, Column]:
    return {name: F.col(name).cast("timestamp_ntz") for name in names}


# --- filters, cleaning, validation ---------------------------------------------------------


@query
def active_hazards(t):
    clean = cleaning.clean_hazards(t.raw_hazards)
    return clean.where("status = 'open'").select(
        "event_id", "category", "title", "latitude", "longitude", "event_timestamp"
    )


@query
def active_hazards_view(t):
    return views.active_hazards(t.spark, cleaning.clean_hazards(t.raw_hazards))


@query
def open_unknown_hazards(t):
    return cleaning.active_hazards(t.raw_hazards).select("seq", "event_id", "status")


@query
def hazard_feed(t):
    clean = cleaning.clean_hazards(t.raw_hazards)
    return cleaning.open_hazard_feed(clean, HAZARD_FEED_LIMIT).select(
        "event_id", "seq", "event_timestamp"
    )


@query
def valid_coordinates(t):
    return cleaning.valid_coordinates(t.raw_hazards).select("seq", "latitude", "longitude")


@query
def clean_hazards(t):
    return cleaning.clean_hazards(t.raw_hazards)


@query
def clean_weather(t):
    return cleaning.clean_weather(t.raw_weather)


@query
def parsed_timestamps(t):
    written = (
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("no time given")
    )
    parsed = cleaning.parse_timestamps(t.orders.select("o_orderkey", written.alias("parsed")), ["parsed"])
    return parsed.withColumns(unzoned("parsed"))


@query
def hazard_categories(t):
    return t.all_hazards().select("category").distinct()


@query
def quality_report(t):
    return cleaning.hazard_quality(t.raw_hazards)


@query
def score_quality(t):
    return cleaning.score_quality(t.risk())


@query
def split_risk_scores(t):
    """The scores by the ways for large data: long series cut, crowded cells opened, hot keys dealt."""
    return features.risk_table(*t.feeds(), sizing=SMALL).select(
        "location_id", "timestamp", "risk_score", "risk_band", "recommendation"
    )


# --- documents -------------------------------------------------------------------------------


def _iso(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _every(n: int, otherwise: Column) -> Column:
    """The value, left out of the document on every n-th row."""
    return F.when(F.col("seq") % n != 0, otherwise)


def _hazard_documents(t) -> DataFrame:
    place = F.struct(
        _iso("event_timestamp").alias("date"),
        F.array_compact(F.array("longitude", "latitude")).alias("coordinates"),
    )
    earlier = F.struct(
        F.lit("2000-01-01T00:00:00Z").alias("date"),
        F.array(F.lit(0.0), F.lit(0.0)).alias("coordinates"),
    )
    titles = F.when(F.col("seq") % 7 != 0, F.array(F.struct(F.col("category").alias("title"))))
    event = F.struct(
        F.col("event_id").alias("id"),
        _every(11, F.col("title")).alias("title"),
        "status",
        titles.alias("categories"),
        F.array(earlier, place).alias("geometry"),
    )
    return t.raw_hazards.select(
        "seq", F.to_json(F.struct(F.array(event).alias("events"))).alias("document")
    )


@query
def hazard_json_flatten(t):
    documents = feeds.parse_documents(_hazard_documents(t), "hazards")
    return feeds.flatten_hazards(documents, keep=["seq"]).withColumns(unzoned("event_timestamp"))


def _reading() -> list[Column]:
    sky = F.array(F.struct(F.lower("condition_text").alias("description")))
    return [
        F.unix_seconds(F.col("forecast_timestamp").cast("timestamp")).alias("dt"),
        F.struct(F.col("temperature").alias("temp"), "humidity", "pressure").alias("main"),
        _every(11, sky).alias("weather"),
        F.struct(
            F.col("wind_speed").alias("speed"),
            _every(3, F.col("wind_speed") + 5).alias("gust"),
            _every(5, F.col("wind_direction")).alias("deg"),
        ).alias("wind"),
        F.when(F.col("seq") % 2 == 0, F.struct(F.col("precipitation").alias("3h"))).alias("rain"),
        F.when(F.col("seq") % 7 == 0, F.struct(F.lit(1.0).alias("3h"))).alias("snow"),
    ]


@query
def forecast_json_flatten(t):
    placed = spatial.with_place(t.raw_weather, t.locations, t.hot_locations())
    document = F.to_json(F.struct(F.array(F.struct(*_reading())).alias("list")))
    documents = placed.select("location_id", "seq", "latitude", "longitude", document.alias("document"))
    parsed = feeds.parse_documents(documents, "forecast")
    return feeds.flatten_forecast(parsed, keep=["location_id", "seq"]).withColumns(
        unzoned("forecast_timestamp")
    )


def _cut_short(document: Column, when: Column) -> Column:
    """A document whose end got lost."""
    return F.when(when, F.expr("left(document, length(document) - 3)")).otherwise(document)


def _forecast_documents(t) -> DataFrame:
    """A document a reading, on the full hour. Some are cut short, some missing, some list nothing."""
    full_hour = t.raw_weather.withColumn("forecast_timestamp", F.date_trunc("hour", "forecast_timestamp"))
    listed = F.to_json(F.struct(F.array(F.struct(*_reading())).alias("list")))
    document = (
        F.when(F.col("location_id") % 10 == 0, '{"list": []}')
        .when(F.col("seq") % 19 == 0, F.lit(None))
        .otherwise(listed)
    )
    texts = full_hour.select("location_id", "seq", document.alias("document"))
    return texts.withColumn("document", _cut_short(F.col("document"), F.col("seq") % 13 == 0))


def _current_documents(t) -> DataFrame:
    """A document a location; some have a word where a number belongs."""
    number = F.col("location_id")
    reading = F.struct(
        (F.lit(1704067200) + number * 60).alias("dt"),
        F.struct(
            F.when(number % 17 == 0, F.lit("mild")).otherwise((number % 40).cast("string")).alias("temp"),
            F.lit(75).alias("humidity"),
            F.lit(1001.5).alias("pressure"),
        ).alias("main"),
        F.when(number % 11 != 0, F.array(F.struct(F.lit("light rain").alias("description")))).alias("weather"),
        F.struct(
            (number % 70).alias("speed"), F.when(number % 5 != 0, number % 360).alias("deg")
        ).alias("wind"),
    )
    # Numbers stand without quotes in a document.
    plain = F.regexp_replace(F.to_json(reading), '"temp":"([0-9]+)"', '"temp":$1')
    return t.locations.select("location_id", number.alias("seq"), plain.alias("document"))


def _documented(t):
    return documents.weather(_forecast_documents(t), _current_documents(t), t.locations)


@query
def current_weather_fallback(t):
    """Locations without a forecast fall back to their current conditions."""
    good, _ = feeds.opened(_current_documents(t), "current")
    placed = good.join(t.locations.select("location_id", "latitude", "longitude"), "location_id")
    current = feeds.flatten_current(placed)
    either = feeds.fall_back_to_current(t.raw_weather.select(*current.columns[:1], *(
        F.col(c) if c in t.raw_weather.columns else F.lit(None).cast("double").alias(c) for c in current.columns[1:]
    )), current.withColumns(unzoned("forecast_timestamp")))
    return either.select(
        "location_id", "forecast_timestamp", "temperature", "humidity", "wind_speed", "wind_direction",
        "precipitation", "pressure", "condition_text",
    )


@query
def documents_to_facts(t):
    """Landed forecasts and current conditions to hourly, scored rows."""
    weather = _documented(t).rows.withColumns(unzoned("forecast_timestamp"))
    risk = features.risk_table(t.locations, t.raw_hazards, t.raw_quakes, weather, t.raw_air)
    return risk.select(
        "location_id",
        "timestamp",
        F.round("temperature", 6).alias("temperature"),
        F.round("wind_speed", 6).alias("wind_speed"),
        "aqi",
        "risk_score",
        "risk_band",
    )


@query
def rejected_documents(t):
    """How many documents of each feed weren't read, and why."""
    return _documented(t).rejected.groupBy("feed", "reason").agg(F.count("*").alias("documents"))


@query
def enriched_weather(t):
    """The columns that a load adds to weather from documents."""
    rows = _documented(t).rows
    return rows.groupBy("location_id", "source_name").agg(
        F.count("*").alias("hours"), F.count("ingestion_ts").alias("stamped")
    )


@query
def air_json_flatten(t):
    entry = F.struct(
        F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("dt"),
        F.struct("aqi").alias("main"),
        F.struct(_every(4, F.col("co")).alias("co"), "so2").alias("components"),
    )
    document = F.to_json(F.struct(F.array(entry).alias("list"))).alias("document")
    parsed = feeds.parse_documents(t.raw_air.select("location_id", "seq", document), "air")
    flat = feeds.flatten_air(parsed, keep=["location_id", "seq"]).withColumns(unzoned("timestamp"))
    return flat.select("location_id", "seq", "timestamp", "aqi", "aqi_label", "co", "so2", "nh3")


@query
def quake_json_flatten(t):
    depth = F.when(F.col("seq") % 5 != 0, F.col("depth_km"))
    feature = F.struct(
        "id",
        F.struct(
            _every(3, F.col("title")).alias("title"),
            F.when(F.col("seq") % 8 != 4, F.col("magnitude")).alias("mag"),
            F.unix_millis(F.col("timestamp").cast("timestamp")).alias("time"),
        ).alias("properties"),
        F.struct(
            F.array_compact(F.array("longitude", "latitude", depth)).alias("coordinates")
        ).alias("geometry"),
    )
    document = F.to_json(F.struct(F.array(feature).alias("features"))).alias("document")
    parsed = feeds.parse_documents(t.raw_quakes.select(document), "quakes")
    return feeds.flatten_quakes(parsed).withColumns(unzoned("timestamp"))


@query
def landed_documents(t):
    """Documents written as files, read back with the feed's schema and flattened."""
    path = shared_path(t.spark, "landing")
    _hazard_documents(t).select("document").write.text(path)
    flat = feeds.flatten_hazards(feeds.read_documents(t.spark, "hazards", path))
    return flat.select(
        "event_id", "category", "title", "status", "event_timestamp", "latitude", "longitude"
    ).withColumns(unzoned("event_timestamp"))


# --- scalar functions --------------------------------------------------------------------------


@query
def location_slug(t):
    name = F.concat(F.col("p_type"), F.lit(" ("), F.col("p_brand"), F.lit("), "), F.col("p_name"))
    return t.part.select(
        "p_partkey", text.slug(name).alias("slug"), text.slug(name, True).alias("open_slug")
    )


@query
def aqi_labels(t):
    index = (F.col("event_id") % 8).cast("int")
    return t.events.select("event_id", text.air_label(index).alias("label"))


@query
def risk_marks(t):
    bands = F.array(*[F.lit(b) for b in ("Safe", "Caution", "Avoid", "Other")])
    band = F.get(bands, (F.col("c_custkey") % 4).cast("int"))
    minutes = F.make_dt_interval(mins=F.col("c_custkey").cast("int"))
    return t.customer.select(
        "c_custkey",
        text.risk_colour(F.col("c_acctbal")).alias("colour"),
        text.risk_mark(band).alias("mark"),
        text.refresh_stamp(F.lit("2024-01-01").cast("timestamp") + minutes).alias("stamp"),
    )


@query
def reasons_decode(t):
    listed = F.to_json(F.array("c_name", "c_mktsegment"))
    stored = F.when(F.col("c_custkey") % 2 == 0, listed).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", text.decode_reasons(stored).alias("_r")).select(
        "c_custkey",
        F.array_join("_r", "; ").alias("reasons"),
        F.size("_r").alias("n"),
    )


@query
def time_features_of_events(t):
    return time_features(t.events, "ts").select("event_id", "hour", "day_of_week", "weekend")


QUERIES["time_features"] = QUERIES.pop("time_features_of_events")


@query
def uv_index_of_weather(t):
    placed = spatial.with_place(t.raw_weather, t.locations, t.hot_locations())
    uv = uv_index(F.col("latitude"), F.col("longitude"), F.col("forecast_timestamp"))
    return placed.select("seq", uv.alias("uv"))


QUERIES["uv_index"] = QUERIES.pop("uv_index_of_weather")


# --- time series ---------------------------------------------------------------------------------


def _weather_series(t) -> Series:
    return measure_series(
        t.raw_weather, "location_id", "forecast_timestamp", DEFAULT_SIZING.rows_per_task
    )


@query
def hourly_resample(t):
    series = _weather_series(t)
    hour = F.date_trunc("hour", "forecast_timestamp").cast("timestamp_ntz")
    on_hour = bring_together(t.raw_weather, series).withColumn("forecast_timestamp", hour)
    observed = cleaning.keep_last(on_hour, ["location_id", "forecast_timestamp"])
    return rounded(hourly_grid(observed, series, GRID, ["condition_text"]), GRID, 8)


@query
def weather_trends(t):
    series = _weather_series(t)
    clean = cleaning.clean_weather(bring_together(t.raw_weather, series))
    trended = trend_features(clean, series)
    return rounded(trended, TRENDS).select("location_id", "forecast_timestamp", *TRENDS)


QUERIES["trend_features"] = QUERIES.pop("weather_trends")


@query
def asof_air_quality(t):
    series = features.weather_series(t.raw_weather, t.raw_air)
    clean = cleaning.clean_weather(bring_together(t.raw_weather, series))
    weather = clean.select("location_id", "forecast_timestamp", "seq")
    return match_nearest(weather, t.raw_air, series, "timestamp", ["aqi", "co", "so2"])


# --- space ---------------------------------------------------------------------------------------


@query
def target_distance(t):
    return spatial.with_home_distance(
        t.raw_hazards, HOME_SITE["latitude"], HOME_SITE["longitude"]
    ).select("seq", "distance_km")


def _profile(t) -> DataFrame:
    return spatial.hazard_profile(t.locations, t.all_hazards())


@query
def hazard_bands(t):
    return spatial.band_counts(t.locations, t.all_hazards()).select(
        "location_id", "hazard_count_10km", "hazard_count_50km", "hazard_count_100km"
    )


@query
def hazard_types_near(t):
    return spatial.band_counts(t.locations, t.all_hazards()).select("location_id", "hazard_types")


@query
def nearest_hazard(t):
    return _profile(t).select("location_id", "nearest_hazard_distance_km", "nearest_hazard_type")


@query
def hazards_with_quakes(t):
    hazards = t.all_hazards()
    return hazards.select(
        "feed", "seq", "id", "category", "latitude", "longitude", "magnitude"
    )


@query
def max_quake_100km(t):
    return spatial.max_quake_magnitude(t.locations, t.raw_quakes).select(
        "location_id", "max_eq_magnitude"
    )


@query
def quakes_near(t):
    return spatial.quakes_near(t.locations, t.raw_quakes)


@query
def wind_alignment(t):
    return features.feature_table(*t.feeds()).select(
        "location_id", "timestamp", "wind_alignment_score"
    )


@query
def wind_alignment_first(t):
    weather = cleaning.clean_weather(t.raw_weather)
    weather = spatial.with_place(weather, t.locations, t.hot_locations())
    first = features.first_hazard(t.all_hazards())
    return features.with_wind_alignment(weather, first).select("seq", "wind_alignment_score")


@query
def hazard_map_top50(t):
    clean = cleaning.active_hazards(cleaning.clean_hazards(t.raw_hazards))
    return spatial.nearest_hazards(t.locations, clean)


@query
def hazard_quake_map(t):
    clean = cleaning.active_hazards(cleaning.clean_hazards(t.raw_hazards))
    return spatial.hazard_and_quake_map(t.locations, clean, t.raw_quakes)


# --- features and scores ---------------------------------------------------------------------------


@query
def feature_table(t):
    return rounded(features.feature_table(*t.feeds()), TRENDS)


@query
def score_components(t):
    risk = t.risk()
    return risk.select(
        "location_id", "timestamp", *[c for c in risk.columns if c.startswith("component_")]
    )


@query
def risk_scores(t):
    return t.risk().select("location_id", "timestamp", "risk_score", "risk_band", "recommendation")


@query
def bulk_row_scoring(t):
    return with_risk(t.bulk_rows).select(*LINE, "risk_score", "risk_band", "recommendation")


@query
def short_key_scoring(t):
    return with_risk(t.bulk_rows, SHORT_KEY_RULES).select(*LINE, "component_hazard", "risk_score")


@query
def risk_band_histogram(t):
    return serving.band_histogram(t.risk())


@query
def risk_summary(t):
    return serving.risk_summary(t.risk())


@query
def source_counts(t):
    return serving.source_counts(
        {
            "hazards": cleaning.clean_hazards(t.raw_hazards),
            "weather": cleaning.clean_weather(t.raw_weather),
            "risk": t.risk(),
        }
    )


@query
def locations_with_data(t):
    return serving.locations_with_data(t.locations, t.raw_weather)


# --- serving ---------------------------------------------------------------------------------------


@query
def current_risk_view(t):
    facts = explain.with_explanation(t.risk())
    return views.current_risk(t.spark, facts, t.locations)


@query
def risk_trend_view(t):
    return views.risk_trend(t.spark, t.held())


@query
def current_risk(t):
    return serving.current_risk(t.risk()).select(
        "location_id", "timestamp", "risk_score", "risk_band", "recommendation"
    )


@query
def risk_card(t):
    return serving.risk_card(t.risk())


@query
def latest_weather(t):
    return serving.latest_weather(t.raw_weather).select(
        "location_id", "seq", "temperature", "humidity", "wind_speed", "pressure", "uv_index",
        "condition_text",
    )


@query
def latest_air_quality(t):
    return serving.latest_air_quality(t.raw_air).select("location_id", "seq", "aqi", "co", "so2")


@query
def forecast_last48(t):
    return serving.forecast_series(t.risk()).select("location_id", "timestamp", "risk_score")


@query
def weather_chart(t):
    return serving.chart_series(
        cleaning.clean_weather(t.raw_weather),
        "forecast_timestamp",
        ["temperature", "wind_speed", "precipitation"],
    )


@query
def forecast_metrics(t):
    return serving.forecast_metrics(t.held())


@query
def place_lookup(t):
    typed = t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("request_id"),
        F.concat(F.lit("  "), F.lower(F.substring("n_name", 1, 3))).alias("text"),
    )
    numbered = t.supplier.select(
        F.col("s_suppkey") + 1000, F.concat(F.lit("Site "), F.col("s_suppkey"))
    )
    short = t.region.select(F.col("r_regionkey") + 500, F.substring("r_name", 1, 1))
    requests = typed.union(numbered).union(short)
    return serving.place_lookup(requests, t.locations).select(
        "request_id", "text", "location_id", "place_name", "rank"
    )


@query
def requested_locations(t):
    """Coordinates as typed; of those that aren't given some are empty, some words, some missing."""
    given = F.col("c_acctbal") >= 0
    other = F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 4 == 1, "12 north")
    requests = t.customer.select(
        "c_custkey",
        F.when(given, (F.col("c_custkey") % 90).cast("string")).otherwise(other).alias("lat"),
        F.when(given, (F.col("c_custkey") % 180).cast("string")).otherwise("5").alias("lon"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("").alias("name"),
    )
    return serving.requested_locations(requests)


# --- explanations ------------------------------------------------------------------------------------


def _explanations(t) -> DataFrame:
    return explain.explain(t.risk()).withColumn("top_reasons", F.array_join("top_reasons", "; "))


@query
def explanations(t):
    return _explanations(t)


@query
def latest_explanation(t):
    return explain.latest_explanation(_explanations(t)).select("location_id", "summary", "top_reasons")


@query
def chosen_explanations(t):
    """Replies for two thirds of the rows, half of them unreadable, one in four without reasons."""
    risk = t.risk()
    written = F.struct(
        F.lit("Wait until later").alias("recommendation"),
        (F.col("risk_score") / 200).alias("confidence"),
        F.concat(F.lit("Score "), F.col("risk_band")).alias("explanation"),
        F.when(F.col("hour") % 4 != 0, F.array(F.col("risk_band"), F.lit("air"))).alias("top_reasons"),
    )
    number = F.col("location_id") % 3
    reply = F.when(number == 0, F.concat(F.lit("```json\n"), F.to_json(written), F.lit("\n```"))).when(
        number == 1, "Sorry, no answer."
    )
    replies = risk.select("location_id", "timestamp", reply.alias("reply"))
    chosen = explain.choose(explain.explain(risk), replies)
    return chosen.withColumn("top_reasons", F.array_join("top_reasons", "; "))


@query
def explain_prompts(t):
    return explain.prompts(with_risk(t.bulk_rows), keep=LINE)


@query
def reply_decode(t):
    answer = F.to_json(
        F.struct(
            F.lit("Go now").alias("recommendation"),
            ((F.col("c_custkey") % 100) / 100).alias("confidence"),
            F.col("c_name").alias("explanation"),
            F.array(F.col("c_mktsegment"), F.lit("wind")).alias("top_reasons"),
        )
    )
    fenced = F.concat(F.lit("```json\n"), answer, F.lit("\n```"))
    reply = (
        F.when(F.col("c_custkey") % 5 == 0, "no JSON at all")
        .when(F.col("c_custkey") % 5 == 1, answer)
        .otherwise(fenced)
    )
    replies = explain.decode_replies(t.customer.select("c_custkey", reply.alias("reply")))
    return replies.withColumn("top_reasons", F.array_join("top_reasons", "; "))


# --- forecasting ---------------------------------------------------------------------------------------


@query
def horizon_labels_lag(t):
    labels = horizon_labels(t.risk(), t.risk_series(), "risk_score", HORIZONS, "lag")
    return labels.select("location_id", "timestamp", *HORIZONS)


@query
def horizon_labels_lead(t):
    labels = horizon_labels(t.risk(), t.risk_series(), "risk_score", HORIZONS, "lead")
    return labels.select("location_id", "timestamp", *HORIZONS)


@query
def model_features(t):
    inputs = forecast.model_inputs(features.feature_table(*t.feeds()))
    changes = ["temp_1h_change", "temp_3h_change", "wind_1h_change"]
    return rounded(inputs, changes).select("location_id", "timestamp", *forecast.INPUTS)


@query
def forecast_errors(t):
    return forecast.errors(t.held(), "risk_score", "predicted_risk_6h")


def _trained(t):
    """Risk rows as a file, and both horizons' models with their test measures."""
    work = shared_path(t.spark, "forecast")
    t.risk().write.parquet(f"{work}/facts")
    risk = tables.read_table(t.spark, f"{work}/facts")
    return risk, *forecast.train(risk, t.risk_series(), work)


@query
def forecast_quality(t):
    """How the models do on the test rows, as what must hold whatever the forest."""
    _, _, metrics = _trained(t)
    return metrics.select(
        "target",
        "n_train",
        "n_test",
        (F.col("mae") <= F.col("rmse")).alias("mae_within_rmse"),
        (F.col("mae") < F.col("mean_mae")).alias("beats_mean"),
        (F.col("r2") > 0).alias("explains"),
    )


@query
def forecast_rows(t):
    """Every fact with both predictions, in range."""
    _, models, _ = _trained(t)
    facts = pipeline.fact_table(t.inputs(), models)
    ok = {f"{c}_ok": F.coalesce(F.col(c).between(0, 100), F.lit(False)) for c in ("predicted_risk_6h", "predicted_risk_12h")}
    return facts.withColumns(ok).select("location_id", "timestamp", "risk_score", *ok)


@query
def rf_forecast(t):
    """Every row predicted by the trained models and by the same ones saved and loaded again."""
    risk, models, _ = _trained(t)
    work = shared_path(t.spark, "models")
    forecast.save_models(models, work)
    names = {f"predicted_{target}": f"first_{target}" for target in models}
    first = forecast.predict(risk, models).withColumnsRenamed(names)
    again = forecast.predict(first, forecast.load_models(work, list(models)))
    return again.select(
        "location_id",
        "timestamp",
        "risk_score",
        *(F.col(name).between(0, 100).alias(f"{name}_ok") for name in names),
        *(F.col(name).eqNullSafe(F.col(held)).alias(f"{held}_kept") for name, held in names.items()),
    )


# --- tables --------------------------------------------------------------------------------------------


@query
def seed_locations_merge(t):
    sites = t.locations.select("location_id", "location_name", "city")
    home = [
        (0, HOME_SITE["location_name"], HOME_SITE["city"]),
        (HOME_SITE["location_id"], HOME_SITE["location_name"], HOME_SITE["city"]),
    ]
    seed = t.spark.createDataFrame(home, sites.schema)
    return tables.insert_missing(sites, seed)


@query
def align_schema(t):
    return align_to_table(t.raw_weather, "raw_weather", "timestamp_ntz").drop("ingestion_ts")


@query
def migrate_schema(t):
    old = t.events.select(F.col("user_id").alias("location_id"), F.col("ts").alias("timestamp"))
    return add_missing_columns(old, "fact_environment_risk").select(
        "location_id", "timestamp", "component_air_quality", "max_eq_magnitude", "aqi",
        "confidence_score",
    )


@query
def latest_snapshot(t):
    day = F.date_trunc("day", "event_timestamp").cast("timestamp_ntz")
    snapshots = t.raw_hazards.select("seq", "event_id", day.alias("snapshot"))
    return tables.latest_snapshot(snapshots)


@query
def latest_snapshot_per_location(t):
    day = F.date_trunc("day", "forecast_timestamp")
    snapshots = t.raw_weather.select("location_id", "seq", day.alias("snapshot"))
    hot = t.hot_locations()
    return tables.latest_snapshot(snapshots, "location_id", hot=hot).select("location_id", "seq")


@query
def stored_locations(t):
    path = shared_path(t.spark, "locations")
    tables.store(t.locations, path, 0)
    return tables.scan_location(t.spark, path).select(
        "location_id", "location_name", "latitude", "longitude", "location_slug"
    )


@query
def newest_snapshot(t):
    """A table stored by day, and the rows of its newest."""
    path = shared_path(t.spark, "daily-hazards")
    days = t.raw_hazards.withColumn("snapshot", F.date_format("event_timestamp", "yyyy-MM-dd"))
    days.write.partitionBy("snapshot").parquet(path)
    return tables.newest_snapshot(t.spark, path).select("seq", "event_id", F.col("snapshot").cast("string"))


@query
def one_location_scan(t):
    """One location's stored rows, newest first."""
    path = shared_path(t.spark, "weather-by-location")
    named = t.raw_weather.withColumn("location_name", F.concat(F.lit("Site "), F.col("location_id").cast("string")))
    tables.store(named, path, 0)
    rows = tables.scan_location(t.spark, path, "Site 7")
    return tables.newest_first(rows, "forecast_timestamp").select("location_id", "seq", "forecast_timestamp")


@query
def served_forecast(t):
    """The newest rows of each location as kept beside the facts."""
    path = shared_path(t.spark, "served")
    pipeline.refresh(t.inputs(), path, 1)
    return pipeline.served(t.spark, path).select("location_id", "timestamp", "risk_score", "risk_band")


@query
def stored_components(t):
    """The stored facts' components, which add up to the score before it is cut to 0 to 100."""
    path = shared_path(t.spark, "components")
    pipeline.refresh(t.inputs(), path, 1)
    parts = [c for c in pipeline.refreshed(t.spark, path).columns if c.startswith("component_")]
    total = sum((F.col(c) for c in parts), F.lit(0.0))
    facts = pipeline.refreshed(t.spark, path)
    return facts.select(
        "location_id",
        "timestamp",
        "component_earthquake",
        (F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)) == F.col("risk_score")).alias("adds_up"),
    )


@query
def loaded_hazards(t):
    path = shared_path(t.spark, "raw-hazards")
    tables.load(cleaning.clean_hazards(t.raw_hazards), path, "raw_hazards")
    return tables.read_table(t.spark, path).withColumns(unzoned("event_timestamp"))


@query
def location_refresh_times(t):
    """When each location was written: within the last hour, and spelt as the dashboard does."""
    path = shared_path(t.spark, "locations")
    tables.store(t.locations, path, 0)
    times = tables.last_refresh(t.spark, path)
    age = F.unix_seconds(F.current_timestamp()) - F.unix_seconds("at")
    return times.select(
        "location_slug",
        age.between(-60, 3600).alias("fresh"),
        (F.col("formatted") == F.date_format("at", "yyyy-MM-dd HH:mm 'UTC'")).alias("as_shown"),
    )


@query
def sql_query(t):
    tables.register(t.spark, {"site_locations": t.locations})
    return tables.query(
        t.spark,
        "SELECT city, count(*) AS locations, round(max(latitude), 2) AS northmost "
        "FROM site_locations GROUP BY city",
    )


# --- streaming -----------------------------------------------------------------------------------------


def _stream(t, name: str) -> DataFrame:
    schema = table(t.spark, t.folder, name).schema
    reader = t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(t.folder)


@query
def refresh_stream(t):
    """Hazards arriving as a stream, kept at their last version, then cleaned."""
    path = shared_path(t.spark, "hazard-stream")
    arriving = project(_stream(t, "events"), "raw_hazards")
    streaming.upsert(arriving, f"{path}/rows", f"{path}/state", ["event_id"]).awaitTermination()
    rows = streaming.upserted(t.spark, f"{path}/rows", ["event_id"])
    return cleaning.clean_hazards(rows).select(
        "event_id", "seq", "category", "status", "latitude", "longitude"
    )


@query
def stream_scoring(t):
    path = shared_path(t.spark, "scored-stream")
    arriving = project(_stream(t, "lineitem"), "bulk_rows")
    streaming.score(arriving, f"{path}/rows", f"{path}/state").awaitTermination()
    return tables.read_table(t.spark, f"{path}/rows").select(*LINE, "risk_score", "risk_band")


@query
def refreshed_risk(t):
    """The refresh job over three arrivals of events, and what readers then see.

    Hazards and quakes come after the first weather, and the last arrival has neither.
    """
    path = shared_path(t.spark, "refresh")

    def arrivals(batch: DataFrame) -> dict[str, DataFrame]:
        return {name: project(batch, f"raw_{name}") for name in streaming.FEEDS}

    kind = F.col("event_type")
    turn = F.when(kind.isin("error", "purchase"), 1).when(
        kind.isin("click", "view") & (F.col("event_id") % 2 == 0), 0
    )
    for number in range(3):
        landed = t.events.where(F.coalesce(turn, F.lit(2)) == number)
        landed.write.mode("append").parquet(f"{path}/landed")
        stream = t.spark.readStream.schema(t.events.schema).parquet(f"{path}/landed")
        streaming.refresh_on_arrival(
            stream, arrivals, t.locations, f"{path}/tables", f"{path}/state"
        ).awaitTermination()
    return pipeline.refreshed(t.spark, f"{path}/tables").select(
        "location_id", "timestamp", "risk_score", "risk_band"
    )
