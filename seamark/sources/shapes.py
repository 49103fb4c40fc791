"""Polygons: shapefiles as rows, and regular grids of the points inside."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from seamark.functions.geo import utm_forward, utm_inverse, utm_zone

#: Shape types that are polygons (fixed values of the format: plain, with heights, with measures).
POLYGONS = (5, 15, 25)
VERTICES = "path string, shape int, ring int, seq int, x double, y double"


def _rings(data: bytes):
    """(shape, ring, seq, x, y) of a .shp file's polygons."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 12 <= len(data):
        number, words = struct.unpack(">2i", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        if len(body) < 2 * words:
            raise ValueError("the shapefile ends within a record")
        if struct.unpack("<i", body[:4])[0] in POLYGONS:
            parts, points = struct.unpack("<2i", body[36:44])
            begin = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            for ring, (a, b) in enumerate(zip(begin, begin[1:])):
                for k in range(a, b):
                    yield number, ring, k - a, xy[2 * k], xy[2 * k + 1]
        at += 8 + 2 * words


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """path, shape, ring, seq, x, y: the vertices of all polygons, in order; shapes of other types go.

    path may name many files; each is read by one task.
    """

    def parse(batches):
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                rows = list(_rings(bytes(content)))
                if rows:
                    yield pd.DataFrame([(where, *r) for r in rows], columns=["path", "shape", "ring", "seq", "x", "y"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, VERTICES)


def edges(vertices: DataFrame) -> DataFrame:
    """path, shape, ring, x0, y0, x1, y1: each vertex to the next; a ring that is open is closed."""
    w = Window.partitionBy("path", "shape", "ring").orderBy("seq")
    first = Window.partitionBy("path", "shape", "ring")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.min_by(c, "seq").over(first))
    return vertices.select("path", "shape", "ring", F.col("x").alias("x0"), F.col("y").alias("y0"), nxt("x").alias("x1"), nxt("y").alias("y1"))


def polygon_area(sides: DataFrame) -> float:
    """Area by the shoelace sum; holes run against their shell and count against it."""
    total = sides.groupBy("path", "shape").agg(F.abs(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("a"))
    return float(total.agg(F.sum("a")).first()[0] or 0.0)


def polygon_grid(sides: DataFrame, step: tuple[float, float] = (2.0, 2.0), tolerance: float | None = 0.05) -> DataFrame:
    """e_km, n_km, area: the points of a regular grid that lie inside, by the even-odd rule.

    sides (edges in km): each is put on the grid lines that it crosses, and a line's points are those between its odd
    and even crossings, left end included; no point is compared with all edges.  An error
    is raised if the points' area is off the polygons' by more than tolerance, none where tolerance is None.
    """
    dx, dy = map(float, step)
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    lines = sides.where("y0 <> y1").select("*", F.explode(F.sequence(F.ceil(low / dy), F.ceil(high / dy))).alias("j")).where((F.col("j") * dy >= low) & (F.col("j") * dy < high))
    at = F.col("x0") + (F.col("j") * dy - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossed = lines.select("path", "shape", "j", at.alias("x")).groupBy("path", "shape", "j").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    spans = crossed.select("j", F.explode(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2))).alias("k"), "xs").select("j", F.ceil(F.get("xs", F.col("k")) / dx).alias("a"), (F.ceil(F.get("xs", F.col("k") + 1) / dx) - 1).alias("b"))
    points = spans.where("a <= b").select("j", F.explode(F.sequence("a", "b")).alias("i")).distinct()
    grid = points.select((F.col("i") * dx).alias("e_km"), (F.col("j") * dy).alias("n_km"), F.lit(dx * dy).alias("area"))
    if tolerance is not None:
        whole, got = polygon_area(sides), grid.count() * dx * dy
        if whole == 0 or abs(got / whole - 1) > tolerance:
            raise ValueError(f"the grid's area is {got:g} and the polygons' {whole:g}; take a finer grid or another projection")
    return grid


def shapefile_grid(spark: SparkSession, path: str, step: tuple[float, float] = (2.0, 2.0), zone: int | None = None, tolerance: float | None = 0.05) -> tuple[DataFrame, int]:
    """(grid, zone): Lat, Lon, Area_km2, Include, E_km, N_km of the points inside polygons in degrees, and the zone they are projected to.

    The zone is that of the middle of the polygons' longitudes unless given; the hemisphere that of their mean
    latitude.  Areas are compared in the projection.
    """
    vertices = read_shapefile(spark, path)
    box = vertices.agg(F.min("x").alias("w"), F.max("x").alias("e"), F.avg("y").alias("y")).first()
    if box.w is None:
        raise ValueError(f"no polygons in {path}")
    zone, south = zone or utm_zone((box.w + box.e) / 2), box.y < 0
    east, north = utm_forward(F.col("x"), F.col("y"), zone, south)
    grid = polygon_grid(edges(vertices.withColumns({"x": east, "y": north})), step, tolerance)
    lon, lat = utm_inverse(F.col("e_km"), F.col("n_km"), zone, south)
    return grid.select(lat.alias("Lat"), lon.alias("Lon"), F.col("area").alias("Area_km2"), F.lit(1).alias("Include"), F.col("e_km").alias("E_km"), F.col("n_km").alias("N_km")), zone
