"""What newly arrived hazards and quakes change: the spots, and the locations that they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitehazard.config import DEFAULT_RULES, DEFAULT_SIZING, RiskRules, Sizing
from sitehazard.operators import grid, spatial
from sitehazard.operators.grid import SITE
from sitehazard.session import settle

COMPARED = ["feed", "seq", "category", "latitude", "longitude", "magnitude"]
ROUNDED_KM = 0.01  # the stored distance is rounded to this


def changed_spots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct coordinates of hazards that only one of two states has, or has otherwise.

    An event that moved gives its old and its new place.
    """
    states = before.select(*COMPARED, F.lit(-1).alias("state")).unionByName(
        after.select(*COMPARED, F.lit(1).alias("state"))
    )
    differing = states.groupBy(*COMPARED).agg(F.sum("state").alias("state")).where("state <> 0")
    return differing.select("latitude", "longitude").distinct()


def reached(
    profiles: DataFrame,
    changed: DataFrame,
    rules: RiskRules = DEFAULT_RULES,
    sizing: Sizing = DEFAULT_SIZING,
) -> DataFrame:
    """Ids of the locations whose profile the changed spots can alter.

    Those are the ones with a changed spot in the widest band, and the ones for which a changed
    spot is no farther than the nearest hazard so far. The first are looked for in the 1° cells
    around the changed spots only (at most 181 × 360 cells). The second lie beyond the widest band
    from every hazard, or the first have them; only such remote locations are searched.
    """
    widest = max(rules.bands_km)
    marked = changed.withColumns({"category": F.lit(""), "seq": F.lit(0)})
    spots = settle(spatial.distinct_spots(marked), "changed-spots")
    leaf = grid.leaf_size(spots, sizing.points_per_cell)
    around = spots.select(F.col("latitude").alias("site_lat"), F.col("longitude").alias("site_lon"))
    cells = grid.cells_in_reach(around, widest).select("cell").distinct()
    columns = ["location_id", "latitude", "longitude", "nearest_hazard_distance_km"]
    here = profiles.select(*columns, grid.cell_of("latitude", "longitude", grid.DEGREE).alias("cell"))
    near = settle(here.join(F.broadcast(cells), "cell", "left_semi").drop("cell"), "near-changes")
    sites = spatial.sites_of(near, sizing)
    within = spatial.in_bands(sites, spots, leaf, rules).select(*SITE)
    found = sites.give_back(within).select("location_id")

    so_far = F.col("nearest_hazard_distance_km")
    remote = settle(profiles.select(*columns).where(so_far.isNull() | (so_far > widest)), "remote")
    if remote.isEmpty():
        return found
    sites = spatial.sites_of(remote, sizing)
    closest = sites.give_back(spatial.nearest_spot(sites, spots, leaf))
    nearer = closest.where(so_far.isNull() | (F.col("nearest.km") <= so_far + ROUNDED_KM))
    return found.unionByName(nearer.select("location_id"))
