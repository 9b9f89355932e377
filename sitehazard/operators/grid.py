"""A latitude/longitude grid in several resolutions, for radius and nearest-point questions.

Cells exist at five sizes, each dividing the next larger one. A cell is named by one long. All
distance bounds between a point and a cell come from the triangle inequality on the sphere, so
poles and the antimeridian need no special case.

Work is done on *distinct coordinates*: copies of a point are counted before anything is
joined. Joins are equi-joins on a cell; where one cell holds more distinct points than
``Sizing.points_per_cell``, cells that lie wholly inside or outside a radius are settled by
their totals, and only the cells on its edge are opened, down to the finest size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sitehazard.functions.geo import EARTH_RADIUS_KM, haversine_km
from sitehazard.operators.cleaning import valid_coordinates
from sitehazard.session import settle

PER_DEGREE = 64  # finest cells per degree
SIZES = (960, 64, 16, 4, 1)  # cell sides in finest cells: 15°, 1°, 1/4°, 1/16°, 1/64°
DEGREE = 64
COLUMNS = 360 * PER_DEGREE
ROWS = 180 * PER_DEGREE + 1  # latitude 90 starts a row of its own
SLACK_KM = 1e-6  # covers rounding in the bounds
SITE = ["site_lat", "site_lon"]

# How a side with many sites per key meets one with few rows per key.
Join = Callable[[DataFrame, DataFrame, list[str]], DataFrame]


def plain_join(many: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    return many.join(few, keys)


# Cell arithmetic is SQL text over column names, which keeps the many plans small to build.


def cell_of(lat: str, lon: str, size: int) -> Column:
    row = f"floor(({lat} + 90) * {PER_DEGREE})"
    column = f"pmod(floor(({lon} + 180) * {PER_DEGREE}), {COLUMNS})"
    return F.expr(f"floor({row} / {size}) * {COLUMNS} + floor({column} / {size})")


def parent_of(cell: str, size: int, larger: int) -> Column:
    times = larger // size
    return F.expr(
        f"floor(floor({cell} / {COLUMNS}) / {times}) * {COLUMNS}"
        f" + floor(pmod({cell}, {COLUMNS}) / {times})"
    )


def _middle(cell: str, size: int, prefix: str) -> list[Column]:
    """The middle of a cell, and a radius around it that holds the whole cell."""
    side = size / PER_DEGREE
    lat = f"((floor({cell} / {COLUMNS}) + 0.5D) * {side}D - 90)"
    lon = f"((pmod({cell}, {COLUMNS}) + 0.5D) * {side}D - 180)"
    # Along the meridian, then along the widest parallel.
    widest = f"cos(radians(greatest(0D, abs({lat}) - {side / 2}D)))"
    radius = f"radians({side / 2}D) * ({widest} + 1) * {EARTH_RADIUS_KM}D + {SLACK_KM:.7f}D"
    return [
        F.expr(lat).alias(f"{prefix}lat"),
        F.expr(lon).alias(f"{prefix}lon"),
        F.expr(radius).alias(f"{prefix}radius"),
    ]


def _judge(pairs: DataFrame, keep: list[str], lat: str, lon: str, own: str = "0D") -> DataFrame:
    """Least and greatest distance between a place (of radius ``own``) and a cell's points."""
    middle = haversine_km(lat, lon, "_cell_lat", "_cell_lon")
    return pairs.select(
        *keep, middle.alias("_km"), F.expr(f"_cell_radius + {own}").alias("_away")
    ).selectExpr(*keep, "greatest(0D, _km - _away) AS _least", "_km + _away AS _most")


def _occupied(points: DataFrame, size: int) -> DataFrame:
    """Cells with points: how many rows, the cell's middle, and the next larger cell."""
    cells = points.groupBy(cell_of("latitude", "longitude", size).alias("cell"))
    return _described(cells.agg(F.count("*").alias("_n")), size)


def _described(cells: DataFrame, size: int) -> DataFrame:
    place = SIZES.index(size)
    larger = SIZES[place - 1] if place else size
    parent = parent_of("cell", size, larger).alias("_parent")
    return cells.select("cell", "_n", *_middle("cell", size, "_cell_"), parent)


def _opened(frontier: DataFrame, occupied: DataFrame, join: Join = plain_join) -> DataFrame:
    """Each cell replaced by the occupied cells of the next size inside it."""
    parents = frontier.withColumnRenamed("cell", "_parent")
    return join(parents, occupied, ["_parent"]).drop("_parent")


def distinct_sites(locations: DataFrame) -> DataFrame:
    """Every coordinate on the globe where locations stand, with their number."""
    return (
        valid_coordinates(locations)
        .groupBy(F.col("latitude").alias("site_lat"), F.col("longitude").alias("site_lon"))
        .agg(F.count("*").alias("locations"))
    )


def leaf_size(points: DataFrame, limit: int, rows: int | None = None) -> int:
    """Largest cell side from 1° down at which no cell holds more than ``limit`` rows.

    ``rows`` is their number, where it is known.
    """
    if (points.count() if rows is None else rows) <= limit:
        return DEGREE
    for size in SIZES[SIZES.index(DEGREE):]:
        cell = cell_of("latitude", "longitude", size)
        fullest = points.groupBy(cell.alias("c")).count().agg(F.max("count")).first()[0]
        if fullest is None or fullest <= limit:
            return size
    return SIZES[-1]


def cells_in_reach(sites: DataFrame, reach_km: float) -> DataFrame:
    """Every 1° cell that can hold a point within reach of the site, as ``cell``."""
    lat, lon = F.col("site_lat"), F.col("site_lon")
    angle = reach_km / EARTH_RADIUS_KM
    spread = F.degrees(F.lit(angle))
    low = F.greatest(F.lit(0), F.floor(lat + 90 - spread))
    high = F.least(F.lit(180), F.floor(lat + 90 + spread))
    round_pole = F.abs(lat) + spread >= 90
    ratio = F.sin(F.lit(angle)) / F.cos(F.radians(lat))
    turn = F.degrees(F.asin(F.least(F.lit(1.0), ratio)))
    first = F.when(round_pole, F.lit(0)).otherwise(F.floor(lon + 180 - turn))
    last = F.when(round_pole, F.lit(359)).otherwise(
        F.least(F.floor(lon + 180 + turn), F.floor(lon + 180 - turn) + 359)
    )
    return (
        sites.withColumn("_r", F.explode(F.sequence(low, high)))
        .withColumn("_c", F.explode(F.sequence(first, last)))
        .select(
            *sites.columns,
            (F.col("_r") * COLUMNS + F.pmod(F.col("_c"), F.lit(360))).alias("cell"),
        )
    )


def cover(
    sites: DataFrame, points: DataFrame, radii: list[float], leaf: int, join: Join = plain_join
) -> tuple[list[tuple[int, DataFrame]], DataFrame]:
    """Split the cells around each site into settled ones and ones on the edge of a radius.

    Returns ``(inside, edge)``. ``inside`` lists per cell size the (site, cell, ``_most``) whose
    points all lie on one side of every radius, and within the largest. ``edge`` holds (site,
    cell) at the leaf size, whose points need their exact distance. A point falls under exactly
    one of them, or lies beyond the largest radius. With 1° leaves everything is edge.
    """
    frontier = cells_in_reach(sites, max(radii))
    inside: list[tuple[int, DataFrame]] = []
    size = DEGREE
    while size != leaf:
        occupied = _occupied(points, size)
        if size == DEGREE:  # at most 181 × 360 rows
            met = frontier.join(F.broadcast(occupied), "cell")
        else:
            met = _opened(frontier, occupied, join)
        judged = _judge(met, [*SITE, "cell"], "site_lat", "site_lon").where(
            F.col("_least") <= max(radii)
        )
        # Each level is worked out once, for what is settled there and for the next one.
        judged = settle(judged, "cells-around")
        on_edge = F.lit(False)
        for radius in radii:
            on_edge = on_edge | ((F.col("_least") <= radius) & (F.col("_most") > radius))
        inside.append((size, judged.where(~on_edge).select(*SITE, "cell", "_most")))
        frontier = judged.where(on_edge).select(*SITE, "cell")
        size = SIZES[SIZES.index(size) + 1]
        if size == leaf:
            frontier = _opened(frontier, _occupied(points, size), join).select(*SITE, "cell")
    return inside, frontier


def _keep_nearest(judged: DataFrame, group: list[str], k: int, slack_km: float) -> DataFrame:
    """Drop cells that cannot hold one of the k nearest points of the group."""
    kept = [c for c in judged.columns if c not in ("_least", "_most", "_n")]
    names = ", ".join(group)
    so_far = f"sum(_n) OVER (PARTITION BY {names} ORDER BY _most, cell ROWS UNBOUNDED PRECEDING)"
    reach = f"min(CASE WHEN _sum >= {k} THEN _most END) OVER (PARTITION BY {names})"
    return (
        judged.selectExpr("*", f"{so_far} AS _sum")
        .selectExpr("*", f"{reach} AS _reach")
        .where(f"_reach IS NULL OR _least <= _reach + {slack_km}D")
        .select(*kept)
    )


def nearest_cells(
    sites: DataFrame,
    points: DataFrame,
    k: int,
    leaf: int,
    slack_km: float = 0.0,
    join: Join = plain_join,
) -> DataFrame:
    """(site, cell) at the leaf size: every cell that can hold one of the k nearest points.

    ``points`` has one row per distinct coordinate; ``slack_km`` widens the search for orders
    that round the distance. Down to 1° the search runs once per occupied 1° cell of the sites
    instead of per site: there are at most 181 × 360 of those, and of the points' cells, so
    these tables have a fixed bound and are broadcast.
    """
    degree = _occupied(points, DEGREE)
    top = SIZES[0]
    roots = _described(
        degree.groupBy(parent_of("cell", DEGREE, top).alias("cell")).agg(
            F.sum("_n").alias("_n")
        ),
        top,
    )
    located = sites.withColumn("site_cell", cell_of("site_lat", "site_lon", DEGREE))
    areas = located.select("site_cell").distinct()
    across = COLUMNS // top
    count = ((ROWS - 1) // top + 1) * across
    area = ["site_cell", "_site_lat", "_site_lon", "_site_radius"]
    everywhere = areas.select(
        "site_cell",
        *_middle("site_cell", DEGREE, "_site_"),
        F.expr(f"explode(sequence(0, {count - 1}))").alias("_i"),
    ).selectExpr(*area, f"floor(_i / {across}) * {COLUMNS} + _i % {across} AS cell")
    frontier = everywhere.join(F.broadcast(roots), "cell")
    for occupied in (None, degree):
        if occupied is not None:
            frontier = _opened(frontier.select(*area, "cell"), F.broadcast(occupied))
        keep = [*area, "cell", "_n"]
        judged = _judge(frontier, keep, "_site_lat", "_site_lon", "_site_radius")
        frontier = _keep_nearest(judged, ["site_cell"], k, slack_km)

    found = join(located, frontier.select("site_cell", "cell"), ["site_cell"]).select(*SITE, "cell")
    size = DEGREE
    while size != leaf:
        size = SIZES[SIZES.index(size) + 1]
        opened = _opened(found, _occupied(points, size), join)
        judged = _judge(opened, [*SITE, "cell", "_n"], "site_lat", "site_lon")
        found = settle(_keep_nearest(judged, SITE, k, slack_km).select(*SITE, "cell"), "nearest-cells")
    return found


def with_distance(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("km", haversine_km("latitude", "longitude", *SITE))
