"""Extrapolation grids: one reader with the differences of the known regions as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.functions.geo import find_zone, utm_forward
from seamark.operators.spatial import stratum_area, with_total


@dataclass(frozen=True)
class Region:
    """How a region's table becomes a grid.

    area: SQL for the area in km2; depth: SQL for the depth in m; include: SQL for what counts;
    member: whether strata are sets of ids in the column stratum rather than bounds.
    """

    area: str = "Area_km2"
    depth: str = "Depth"
    include: str = "true"
    member: bool = False
    bounds: tuple[str, ...] = ("Lat", "Lon", "Depth")


#: Regions by name; those that are not listed are read as "user".
REGIONS = {
    "aleutian_islands": Region(bounds=("Lat",)),
    "british_columbia": Region(area="coalesce(HS, 0) + coalesce(QCS, 0) + coalesce(WCHG, 0) + coalesce(WCVI, 0)"),
    "bering_sea_slope": Region(depth="ELEV * 1000"),
    "eastern_bering_sea": Region(bounds=("Lat",)),
    "northern_bering_sea": Region(bounds=("Lat",)),
    "chukchi_sea": Region(bounds=("Lat",)),
    "gulf_of_alaska": Region(),
    "gulf_of_mexico": Region(),
    "gulf_of_st_lawrence": Region(bounds=("Lat", "Lon")),
    "habcam": Region(bounds=("Lat", "Lon")),
    "northwest_atlantic": Region(member=True),
    "new_zealand": Region(),
    "south_africa": Region(area="nm2 * 3.4299", member=True),
    "st_matthews_island": Region(bounds=("Lat", "Lon")),
    "california_current": Region(area="4 * least(propInWCGBTS, propInSurvey)", include="propInWCGBTS > 0 AND Depth >= 55"),
    "wcghl": Region(),
    "bfish_mhi": Region(),
    "user": Region(),
}


def region(name: str) -> Region:
    """Names are compared without regard to case, and unknown ones are user grids."""
    return REGIONS.get(name.lower().replace(" ", "_").replace("-", "_"), REGIONS["user"])


def load_grid(table: DataFrame, name: str, strata: list[tuple], by: tuple[str, ...] | None = None, zone: int | None = None, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """(grid, cell_area): g, lon, lat, e_km, n_km, include, area; and g, l, area of every stratum that holds a cell.

    table: Lat, Lon and what the region's expressions read; stream grids need child_i too.
    by: the columns that the strata's bounds are on, the region's own unless given.
    Cells without area stay in the grid and have no rows in cell_area.
    """
    known = region(name)
    need = {"Lat", "Lon"} | ({"child_i"} if stream else set())
    if known.area in ("Area_km2",):
        need.add(known.area)
    if missing := need - set(table.columns):
        raise ValueError(f"the grid lacks {', '.join(sorted(missing))}")
    rows = table.withColumn("area", F.expr(known.area).cast("double")).withColumn("include", F.expr(known.include))
    if "Depth" not in table.columns and "ELEV" in table.columns:
        rows = rows.withColumn("Depth", F.expr(known.depth))
    if zone is None:
        zone, south = find_zone(rows, "Lon", "Lat")
    else:
        south = (rows.agg(F.avg("Lat")).first()[0] or 0.0) < 0
    e, n = utm_forward(F.col("Lon"), F.col("Lat"), zone, south)
    grid = rows.withColumn("g", F.monotonically_increasing_id()).withColumns({"e_km": e, "n_km": n})
    if known.member and strata and isinstance(strata[0][1], (set, frozenset, list)):
        tests: list[Column] = [F.when(F.col("stratum").isin(*ids), F.lit(label)) for label, ids in strata]
        area = grid.where("area > 0").withColumn("l", F.explode(F.array_compact(F.array(*tests)))).select("g", "l", "area")
    else:
        area = stratum_area(grid.where("area > 0"), strata, known.bounds[: (len(strata[0]) - 1) if strata else 1] if by is None else by).select("g", "l", "area")
    return grid, area


def load_regions(tables: dict[str, DataFrame], strata: list[tuple], total: bool = False, per_region: bool = False) -> tuple[DataFrame, DataFrame]:
    """Grids of several regions as one; with a Total stratum, or strata told apart by region."""
    grids, areas = None, None
    for k, (name, table) in enumerate(tables.items()):
        g, a = load_grid(table, name, strata)
        key = lambda d, k=k: d.withColumn("g", F.concat_ws("/", F.lit(str(k)), F.col("g").cast("string")))
        g, a = key(g).select("g", "Lat", "Lon", "e_km", "n_km", "include", "area").withColumn("region", F.lit(name)), key(a)
        if per_region:
            a = a.withColumn("l", F.concat_ws("/", F.lit(name), "l"))
        grids, areas = (g, a) if grids is None else (grids.unionByName(g), areas.unionByName(a))
    return grids, with_total(areas) if total else areas


def read_observations(spark: SparkSession, path: str, columns: dict[str, str], sentinel: float | None = None, covariate: str = "1.0D") -> DataFrame:
    """A table of samples as Catch_KG, Year, Vessel, AreaSwept_km2, Lat, Lon, Pass; columns: SQL for each of them.

    Rows whose covariate (SQL over the table) is at the sentinel or below go.
    """
    rows = spark.read.parquet(path)
    if sentinel is not None:
        rows = rows.where(F.expr(covariate) > sentinel)
    return rows.select(*(F.expr(sql).alias(name) for name, sql in ({"Pass": "0.0D", "Vessel": "'missing'"} | columns).items()))
