"""Hazards around many locations: band counts, nearest hazard, nearest k, newest k in reach.

Everything is computed once per distinct site coordinate and then handed to the locations
there, so neither copies of a hazard nor locations sharing a spot multiply the work.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from sitehazard.config import (
    DEFAULT_RULES,
    DEFAULT_SIZING,
    MAP_LIMIT,
    MAP_QUAKE_LIMIT,
    QUAKE_FEED_LIMIT,
    QUAKE_MIN_MAGNITUDE,
    QUAKE_REACH_KM,
    RiskRules,
    Sizing,
)
from sitehazard.functions.geo import haversine_km
from sitehazard.operators import grid
from sitehazard.operators.cleaning import valid_coordinates
from sitehazard.operators.grid import SITE
from sitehazard.operators.skew import HotKeys, hot_keys, join_few
from sitehazard.session import settle, settle_measured


#: The part of all quakes that is looked at first for the newest ones.
RECENT_SHARE = 1 / 16


@dataclass(frozen=True)
class Sites:
    """Distinct coordinates of a location table, and which joins on them need spreading.

    A cell or coordinate is met by each site at most once. So with no more sites than one task
    takes, no join of sites with cells can be hot, and with no more locations at any one
    coordinate than that, neither can the way back.
    """

    locations: DataFrame
    points: DataFrame
    many: bool
    crowded: bool
    limit: int

    def join(self, many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
        hot = hot_keys(many, keys, self.limit) if self.many else None
        return join_few(many, few, keys, hot)

    def give_back(self, per_site: DataFrame, how: str = "inner") -> DataFrame:
        """Site results for every location standing there."""
        placed = self.locations.withColumns(
            {"site_lat": F.col("latitude"), "site_lon": F.col("longitude")}
        )
        hot = hot_keys(placed, SITE, self.limit) if self.crowded else None
        return join_few(placed, per_site, SITE, hot, how).drop(*SITE)


def sites_of(locations: DataFrame, sizing: Sizing = DEFAULT_SIZING) -> Sites:
    points, size = settle_measured(
        grid.distinct_sites(locations), "sites", n=F.count(F.lit(1)), most=F.max("locations")
    )
    limit = sizing.rows_per_task
    return Sites(
        locations, points.select(*SITE), size["n"] > limit, (size["most"] or 0) > limit, limit
    )


def with_place(df: DataFrame, locations: DataFrame, hot: HotKeys | None) -> DataFrame:
    """The position of each row's location beside the row."""
    place = locations.select("location_id", "latitude", "longitude")
    return join_few(df, place, ["location_id"], hot)


def with_home_distance(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """Distance of every row to one target point."""
    return df.withColumn(
        "distance_km",
        F.round(haversine_km("latitude", "longitude", f"({lat}D)", f"({lon}D)"), 2),
    )


def union_hazards(hazards: DataFrame, quakes: DataFrame) -> DataFrame:
    """Quakes join the hazards by column name, as open ones. ``feed`` keeps hazards first."""
    as_hazards = quakes.select(
        "id",
        "latitude",
        "longitude",
        "title",
        "category",
        F.lit("open").alias("status"),
        "magnitude",
        "seq",
        F.lit(1).alias("feed"),
    )
    named = hazards.withColumns({"id": F.col("event_id"), "feed": F.lit(0)})
    return named.unionByName(as_hazards, allowMissingColumns=True)


def distinct_spots(hazards: DataFrame) -> DataFrame:
    columns = hazards.columns
    feed = F.col("feed") if "feed" in columns else F.lit(0)
    seq = F.col("seq") if "seq" in columns else F.monotonically_increasing_id()
    magnitude = F.col("magnitude") if "magnitude" in columns else F.lit(None).cast("double")
    return (
        valid_coordinates(hazards)
        .groupBy("latitude", "longitude", F.col("category"))
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct(feed.alias("feed"), seq.alias("seq"))).alias("turn"),
            F.max(magnitude).alias("magnitude"),
        )
    )


def _settled_spots(spots: DataFrame, name: str, sizing: Sizing) -> tuple[DataFrame, int]:
    """The spots as a file, and the cell side that suits them."""
    settled, size = settle_measured(spots, name, n=F.count(F.lit(1)))
    return settled, grid.leaf_size(settled, sizing.points_per_cell, size["n"])


def hazard_profile(
    locations: DataFrame,
    hazards: DataFrame,
    rules: RiskRules = DEFAULT_RULES,
    sizing: Sizing = DEFAULT_SIZING,
) -> DataFrame:
    """One row per location: band counts, types and quake strength in reach, nearest hazard.

    Counts use the exact distance, the reported distance is rounded to 2 places. Without any
    hazard the counts are 0, the types empty and the nearest hazard null. Equally near hazards
    go by feed, then ``seq``.
    """
    sites = sites_of(locations, sizing)
    spots, leaf = _settled_spots(distinct_spots(hazards), "hazard-spots", sizing)
    near = in_bands(sites, spots, leaf, rules)
    nearest = nearest_spot(sites, spots, leaf)
    per_site = nearest.join(near, SITE, "left")
    *counts, types, magnitude = _band_columns(rules)
    return sites.give_back(per_site, "left").select(
        *locations.columns,
        *counts,
        F.round("nearest.km", 2).alias("nearest_hazard_distance_km"),
        F.when(F.col("nearest").isNotNull(), F.coalesce("nearest.category", F.lit("Unknown")))
        .alias("nearest_hazard_type"),
        types,
        F.col("nearest.latitude").alias("hazard_lat"),
        F.col("nearest.longitude").alias("hazard_lon"),
        magnitude,
    )


def band_counts(
    locations: DataFrame,
    hazards: DataFrame,
    rules: RiskRules = DEFAULT_RULES,
    sizing: Sizing = DEFAULT_SIZING,
) -> DataFrame:
    """The part of a location's profile that lies in the bands, without the nearest search."""
    sites = sites_of(locations, sizing)
    spots, leaf = _settled_spots(distinct_spots(hazards), "hazard-spots", sizing)
    near = in_bands(sites, spots, leaf, rules)
    return sites.give_back(near, "left").select(*locations.columns, *_band_columns(rules))


def _band_columns(rules: RiskRules) -> list[Column]:
    counts = [
        F.coalesce(F.col(f"_in_{band:g}"), F.lit(0)).cast("int").alias(f"hazard_count_{band:g}km")
        for band in rules.bands_km
    ]
    types = F.coalesce("hazard_types", F.lit("")).alias("hazard_types")
    return [*counts, types, F.coalesce("magnitude", F.lit(0.0)).alias("max_eq_magnitude")]


def in_bands(sites: Sites, spots: DataFrame, leaf: int, rules: RiskRules) -> DataFrame:
    bands = list(rules.bands_km)

    def counted(reached: Column) -> list[Column]:
        return [
            F.when(reached <= band, F.col("n")).otherwise(0).alias(f"_in_{band:g}")
            for band in bands
        ]

    inside, edge = grid.cover(sites.points, spots, bands, leaf, sites.join)
    lat, lon = "latitude", "longitude"
    celled = spots.withColumn("cell", grid.cell_of(lat, lon, leaf))
    pairs = grid.with_distance(sites.join(edge, celled, ["cell"]))
    found = pairs.where(F.col("km") <= bands[-1]).select(
        *SITE, "category", "magnitude", *counted(F.col("km"))
    )
    for size, cells in inside:
        totals = spots.groupBy(grid.cell_of(lat, lon, size).alias("cell"), "category").agg(
            F.sum("n").alias("n"), F.max("magnitude").alias("magnitude")
        )
        found = found.unionByName(
            sites.join(cells, totals, ["cell"]).select(
                *SITE, "category", "magnitude", *counted(F.col("_most"))
            )
        )
    return found.groupBy(*SITE).agg(
        *[F.sum(f"_in_{band:g}").alias(f"_in_{band:g}") for band in bands],
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("hazard_types"),
        F.max("magnitude").alias("magnitude"),
    )


def nearest_spot(sites: Sites, spots: DataFrame, leaf: int) -> DataFrame:
    coordinates = spots.groupBy("latitude", "longitude").agg(
        F.min("turn").alias("turn"), F.min_by("category", "turn").alias("category")
    )
    lat, lon = "latitude", "longitude"
    cells = grid.nearest_cells(sites.points, coordinates, 1, leaf, join=sites.join)
    celled = coordinates.withColumn("cell", grid.cell_of(lat, lon, leaf))
    pairs = grid.with_distance(sites.join(cells, celled, ["cell"]))
    return pairs.groupBy(*SITE).agg(
        F.min_by(F.struct("km", "latitude", "longitude", "category"), F.struct("km", "turn"))
        .alias("nearest")
    )


def max_quake_magnitude(
    locations: DataFrame, quakes: DataFrame, sizing: Sizing = DEFAULT_SIZING
) -> DataFrame:
    """Strongest quake within the widest band of every location, else 0."""
    sites = sites_of(locations, sizing)
    spots, leaf = _settled_spots(distinct_spots(quakes), "quake-spots", sizing)
    near = in_bands(sites, spots, leaf, DEFAULT_RULES).select(*SITE, "magnitude")
    return sites.give_back(near, "left").select(
        *locations.columns, F.coalesce("magnitude", F.lit(0.0)).alias("max_eq_magnitude")
    )


def _first_per(df: DataFrame, group: list, order: list[Column], k: int) -> DataFrame:
    # A row_number filter like this one is also applied before the shuffle, so a hot group
    # sends k rows per input task.
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_nth") <= k).drop("_nth")


def nearest_per_site(sites: Sites, hazards: DataFrame, k: int, sizing: Sizing) -> DataFrame:
    """The k hazards nearest to every site by (distance rounded to 1 place, ``id``).

    Of the hazards sharing a coordinate only the first k ids can be among a site's k nearest, and
    only the first k coordinates by (rounded distance, first id) can hold one of them.
    """
    spot = ["latitude", "longitude"]
    kept = _first_per(hazards.dropna(subset=spot), spot, [F.col("id")], k)
    kept = settle(kept, "marker-spots")
    coordinates = kept.groupBy(*spot).agg(F.min("id").alias("first_id"))
    leaf = grid.leaf_size(coordinates, sizing.points_per_cell)
    cells = grid.nearest_cells(sites.points, coordinates, k, leaf, 0.11, sites.join)
    celled = coordinates.withColumn(
        "cell", grid.cell_of("latitude", "longitude", leaf)
    )
    pairs = grid.with_distance(sites.join(cells, celled, ["cell"]))
    pairs = pairs.withColumn("distance_km", F.round("km", 1))
    by_distance = [F.col("distance_km"), F.col("first_id")]
    spots = _first_per(pairs, SITE, by_distance, k).select(*SITE, *spot, "distance_km")
    rows = sites.join(spots, kept, spot)
    return _first_per(rows, SITE, [F.col("distance_km"), F.col("id")], k)


def nearest_hazards(
    locations: DataFrame, hazards: DataFrame, k: int = MAP_LIMIT, sizing: Sizing = DEFAULT_SIZING
) -> DataFrame:
    """The map markers of every location: its k nearest hazards."""
    sites = sites_of(locations.select("location_id", "latitude", "longitude"), sizing)
    markers = hazards.select(
        F.col("event_id").alias("id"), "category", "title", "latitude", "longitude"
    )
    near = nearest_per_site(sites, markers, k, sizing).drop("latitude", "longitude")
    return sites.give_back(near).select("location_id", "id", "category", "title", "distance_km")


def hazard_and_quake_map(
    locations: DataFrame,
    hazards: DataFrame,
    quakes: DataFrame,
    k: int = MAP_LIMIT,
    k_quakes: int = MAP_QUAKE_LIMIT,
    sizing: Sizing = DEFAULT_SIZING,
) -> DataFrame:
    """Nearest hazards and nearest real quakes in one list, cut to k again.

    Placeholder quakes are left out. Equal distances list hazards first.
    """
    sites = sites_of(locations.select("location_id", "latitude", "longitude"), sizing)
    markers = hazards.select(
        F.col("event_id").alias("id"), "category", "title", "latitude", "longitude"
    )
    real = quakes.where(~F.coalesce(F.col("id").startswith("mock_"), F.lit(False))).select(
        "id", F.lit("Earthquakes").alias("category"), "title", "latitude", "longitude"
    )
    both = (
        nearest_per_site(sites, markers, k, sizing)
        .withColumn("feed", F.lit(0))
        .unionByName(nearest_per_site(sites, real, k_quakes, sizing).withColumn("feed", F.lit(1)))
    )
    order = [F.col("distance_km").asc_nulls_last(), F.col("feed"), F.col("id")]
    merged = _first_per(both, SITE, order, k).drop("latitude", "longitude")
    return sites.give_back(merged).select("location_id", "id", "category", "title", "distance_km")


def _newest_in_reach(
    sites: Sites, quakes: DataFrame, reach_km: float, newest: list[Column], k: int, sizing: Sizing
) -> DataFrame:
    lat, lon = "latitude", "longitude"
    leaf = grid.leaf_size(quakes, sizing.points_per_cell)
    inside, edge = grid.cover(sites.points, quakes, [reach_km], leaf, sites.join)
    celled = quakes.withColumn("cell", grid.cell_of(lat, lon, leaf))
    exact = grid.with_distance(sites.join(edge, celled, ["cell"]))
    found = exact.where(F.col("km") <= reach_km).select(*SITE, *quakes.columns)
    for size, cells in inside:
        top = _first_per(quakes.withColumn("cell", grid.cell_of(lat, lon, size)), ["cell"], newest, k)
        found = found.unionByName(sites.join(cells, top, ["cell"]).select(*SITE, *quakes.columns))
    return _first_per(found, SITE, newest, k)


def quakes_near(
    locations: DataFrame,
    quakes: DataFrame,
    reach_km: float = QUAKE_REACH_KM,
    min_magnitude: float = QUAKE_MIN_MAGNITUDE,
    k: int = QUAKE_FEED_LIMIT,
    sizing: Sizing = DEFAULT_SIZING,
) -> DataFrame:
    """Per location the newest k quakes of a minimum strength within reach, newest first.

    A coordinate, or a cell wholly in reach, can add only its own newest k. The newest part of all
    quakes is looked at first: a site that finds k there needs no older ones. Only the other
    sites meet the whole table.
    """
    sites = sites_of(locations.select("location_id", "latitude", "longitude"), sizing)
    newest = [F.col("timestamp").desc(), F.col("id")]
    lat, lon = "latitude", "longitude"
    strong = quakes.where(F.col("magnitude") >= min_magnitude).dropna(subset=[lat, lon])
    kept = _first_per(strong, ["latitude", "longitude"], newest, k).select(
        "id", "title", "magnitude", "timestamp", "latitude", "longitude"
    )
    seconds = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    kept, size = settle_measured(kept, "quake-spots", start=F.percentile_approx(seconds, 1 - RECENT_SHARE, 1000))
    start = size["start"]
    found = None
    if start is not None:
        recent = kept.where(seconds >= start)
        found = settle(_newest_in_reach(sites, recent, reach_km, newest, k, sizing), "newest-in-reach")
        full = found.groupBy(*SITE).agg(F.count("*").alias("n")).where(F.col("n") >= k).select(*SITE)
        rest = settle(sites.points.join(full, SITE, "left_anti"), "sites-with-fewer")
        if rest.isEmpty():
            others = None
        else:
            found = found.join(full, SITE, "left_semi")
            others = replace(sites, points=rest)
    else:
        others = sites
    if others is not None:
        more = _newest_in_reach(others, kept, reach_km, newest, k, sizing)
        found = more if found is None else found.unionByName(more)
    ranked = found.withColumn("distance_km", F.round(haversine_km(lat, lon, *SITE), 2))
    return sites.give_back(ranked.drop("latitude", "longitude")).select(
        "location_id", "id", "title", "magnitude", "timestamp", "distance_km"
    )
