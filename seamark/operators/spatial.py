"""Spatial joins, grids, areas, lattices and networks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from seamark.functions.geo import barycentric, squared_distance

#: Sites that nearest() broadcasts: about 24 bytes each, so some MB; larger tables are joined by cell.
BROADCAST_SITES = 10_000


def one_for_a_place(sites: DataFrame, site_id: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The site of smallest id of each place, which is nearest wherever another of the place is; sites without a place or id are none."""
    placed = sites.where(f"e_km IS NOT NULL AND n_km IS NOT NULL AND `{site_id}` IS NOT NULL")
    return placed.groupBy(*by, "e_km", "n_km").agg(F.min(site_id).alias(site_id))


def nearest(query: DataFrame, sites: DataFrame, site_id: str, limit: int = BROADCAST_SITES) -> DataFrame:
    """query with the nearest site (ties: smallest id) as site_id and its squared distance d2.

    Both have e_km, n_km; sites with site_id, a number.  A small, counted table of places is
    broadcast, and distances are taken in Arrow batches, so query is neither shuffled nor multiplied; a larger
    one, or one with other ids, is joined by cells.
    """
    rows = one_for_a_place(sites, site_id).limit(limit + 1).collect()  # bounded by limit
    kind = sites.schema[site_id].dataType
    if len(rows) > limit or not isinstance(kind, IntegralType):
        return nearest_bucketed(query, sites, site_id)
    if not rows:
        return query.withColumn(site_id, F.lit(None).cast(kind)).withColumn("d2", F.lit(None).cast("double"))
    rows.sort(key=lambda r: r[2])  # the first of equal distances is then the smallest id
    e, n, ids = (np.array([r[k] for r in rows], t) for k, t in ((0, float), (1, float), (2, np.int64)))
    shared = sites.sparkSession.sparkContext.broadcast((e, n, ids))

    @F.pandas_udf("id bigint, d2 double")
    def best(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        e, n, ids = shared.value
        x, y = x.to_numpy(float), y.to_numpy(float)
        at, d2 = np.zeros(len(x), np.int64), np.zeros(len(x))
        step = max(1, 1_000_000 // len(e))
        for k in range(0, len(x), step):
            dx, dy = x[k : k + step, None] - e, y[k : k + step, None] - n
            d = dx * dx + dy * dy
            at[k : k + step] = d.argmin(axis=1)
            d2[k : k + step] = np.take_along_axis(d, at[k : k + step, None], axis=1)[:, 0]
        none = np.isnan(d2)  # a query without a place has no nearest site
        return pd.DataFrame({"id": pd.Series(ids[at]).astype("Int64").mask(none), "d2": pd.Series(d2).mask(none)})

    return query.withColumn("_best", best("e_km", "n_km")).withColumn(site_id, F.col("_best.id").cast(kind)).withColumn("d2", F.col("_best.d2")).drop("_best")


def nearest_bucketed(query: DataFrame, sites: DataFrame, site_id: str, width: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """As nearest, by an equi-join on cells: each query looks into the 3 by 3 cells around it, in growing cells until all are settled.

    A query is settled once its best site is no farther than a cell is wide.  Widths
    double, so few rounds are needed and the last holds few queries.  by: columns that a
    query and its site must share; queries without such a site get nulls.
    """
    keyed = query.withColumn("_q", F.monotonically_increasing_id())
    from seamark.operators.lineage import written

    keyed, kind = written(keyed), sites.schema[site_id].dataType
    sites = written(one_for_a_place(sites, site_id, by))
    box = sites.agg(F.min("e_km"), F.max("e_km"), F.min("n_km"), F.max("n_km"), F.count("*")).first()
    if not box[4]:
        return query.withColumn(site_id, F.lit(None).cast(kind)).withColumn("d2", F.lit(None).cast("double"))
    span = max(float(box[1] - box[0]), float(box[3] - box[2]), 1e-9)
    width = width or 2 * span / max(1.0, box[4] ** 0.5)
    plain = sites.select(*by, F.col(site_id), F.col("e_km").alias("_e"), F.col("n_km").alias("_n"))
    points = keyed.select("_q", *by, "e_km", "n_km")
    reach = max(span, *(abs(float(x)) for x in points.agg(F.min("e_km"), F.max("e_km"), F.min("n_km"), F.max("n_km")).first() if x is not None), *(abs(float(x)) for x in box[:4]))
    parts, todo = [], points
    while True:
        cell = lambda c, w=width: F.floor(c / w)
        around = F.explode(F.array(*(F.struct((cell(F.col("e_km")) + i).alias("i"), (cell(F.col("n_km")) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("_c")
        near = todo.select("_q", *by, "e_km", "n_km", around).select("_q", *by, "e_km", "n_km", "_c.i", "_c.j").join(plain.withColumn("i", cell(F.col("_e"))).withColumn("j", cell(F.col("_n"))), [*by, "i", "j"])
        best = near.groupBy("_q").agg(F.min(F.struct(squared_distance(F.col("e_km"), F.col("n_km"), F.col("_e"), F.col("_n")).alias("d2"), F.col(site_id).alias("id"))).alias("best"))
        settled = written(best.where(F.col("best.d2") <= width * width)) if width < 4 * reach else written(best)
        parts.append(settled)
        todo = written(todo.join(settled, "_q", "left_anti"))
        if width >= 4 * reach or todo.isEmpty():
            break
        width *= 2
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return keyed.join(found, "_q", "left").withColumn(site_id, F.col("best.id")).withColumn("d2", F.col("best.d2")).drop("_q", "best")


def match_strata(strata: list[tuple], by: tuple[str, ...] = ("n_km",)) -> Column:
    """The first stratum whose bounds hold a cell: lower bound exclusive, upper inclusive; null if none does.

    strata: (name, (low, high) or None for each column of by); None leaves a column free.
    """
    out = F.lit(None).cast("string")
    for name, *bounds in reversed(strata):
        ok = F.lit(True)
        for column, pair in zip(by, bounds):
            if pair is not None:
                ok &= (F.col(column) > pair[0]) & (F.col(column) <= pair[1])
        out = F.when(ok, F.lit(name)).otherwise(out)
    return out


def stratum_area(cells: DataFrame, strata: list[tuple], by: tuple[str, ...] = ("n_km",)) -> DataFrame:
    """g, l, area for every cell and every stratum that holds it; strata may overlap."""
    tests = []
    for name, *bounds in strata:
        ok = F.lit(True)
        for column, pair in zip(by, bounds):
            if pair is not None:
                ok &= (F.col(column) > pair[0]) & (F.col(column) <= pair[1])
        tests.append(F.when(ok, F.lit(name)))
    return cells.withColumn("l", F.explode(F.array_compact(F.array(*tests))))


def with_total(cell_area: DataFrame) -> DataFrame:
    """Add a stratum Total that holds every cell's sum."""
    total = cell_area.groupBy("g").agg(F.sum("area").alias("area")).withColumn("l", F.lit("Total"))
    return cell_area.select("g", "l", "area").unionByName(total.select("g", "l", "area"))


def knot_source(cells: DataFrame, cell_area: DataFrame) -> DataFrame:
    """Cells that are included, have area and some stratum's area."""
    some = cell_area.groupBy("g").agg(F.sum("area").alias("_s")).where("_s > 0").select("g")
    return cells.where("include AND area > 0").join(some, "g", "left_semi")


def knot_areas(cells: DataFrame, knots: DataFrame, groups: list[str]) -> DataFrame:
    """x, groups, area: the area of the cells nearest to each knot, 0 for knots without any."""
    got = nearest(cells, knots.select(F.col("x"), "e_km", "n_km"), "x").groupBy("x", *groups).agg(F.sum("area").alias("area"))
    every = knots.select("x") if not groups else knots.select("x").join(F.broadcast(cells.select(*groups).distinct()))
    return every.join(got, ["x", *groups], "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def grid(e0: float, e1: float, n0: float, n1: float, step: float, spark) -> DataFrame:
    """Regular points (i, j, e_km, n_km); generated on the executors, rows first."""
    ni, nj = int((e1 - e0) // step) + 1, int((n1 - n0) // step) + 1
    if ni * nj > 10_000_000:
        raise ValueError(f"{ni * nj} cells; coarsen the grid")
    return spark.range(ni).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nj - 1))).alias("j")).withColumn("e_km", F.lit(e0) + F.col("i") * F.lit(step)).withColumn("n_km", F.lit(n0) + F.col("j") * F.lit(step))


def auto_grid(obs: DataFrame, step: float, reach: float | None = None) -> DataFrame:
    """Grid cells over the samples' box, padded to 1.2 times its range, whose nearest sample is closer than reach (half a cell's diagonal)."""
    sites = obs.select("e_km", "n_km").distinct()
    box = sites.agg(F.min("e_km"), F.max("e_km"), F.min("n_km"), F.max("n_km")).first()
    pad = [(float(box[k + 1]) - float(box[k])) * 0.1 for k in (0, 2)]
    reach2 = (reach * reach) if reach is not None else step * step / 2
    cells = grid(box[0] - pad[0], box[1] + pad[0], box[2] - pad[1], box[3] + pad[1], step, obs.sparkSession)
    numbered = sites.select("e_km", "n_km", F.xxhash64("e_km", "n_km").alias("site"))
    return nearest(cells, numbered, "site").where(F.col("d2") < reach2).drop("site").withColumn("area", F.lit(step * step))


def lattice(cells: DataFrame) -> DataFrame:
    """g, h, kind of a 2-D lattice (columns g, i, j): 0 itself, 1 shares an edge, 2 a corner. An equi-join on integer places."""
    steps = F.explode(F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), F.lit(abs(di) + abs(dj)).alias("kind")) for di in (-1, 0, 1) for dj in (-1, 0, 1)))).alias("s")
    moved = cells.select("g", "i", "j", steps).select("g", (F.col("i") + F.col("s.di")).alias("i"), (F.col("j") + F.col("s.dj")).alias("j"), "s.kind")
    return moved.join(cells.select(F.col("g").alias("h"), "i", "j"), ["i", "j"]).select("g", "h", "kind")


def network_precision(edges: DataFrame, theta: float) -> DataFrame:
    """(row, col, val) of the precision of an exponential process on a tree of (edge, parent, child, dist); edge 0 is the root."""
    rho = F.exp(F.lit(-theta) * F.col("dist"))
    v = 1 - rho * rho
    live = edges.where("edge > 0").withColumn("rho", rho).withColumn("v", v)
    entry = lambda r, c, x: F.struct(r.alias("row"), c.alias("col"), x.alias("val"))
    p, c, rho, v = F.col("parent"), F.col("child"), F.col("rho"), F.col("v")
    added = live.select(F.explode(F.array(entry(p, p, rho * rho / v), entry(c, c, rho * rho / v), entry(p, c, -rho / v), entry(c, p, -rho / v))).alias("x")).select("x.*")
    ones = edges.select(F.explode(F.array("parent", "child")).alias("row")).distinct().select("row", F.col("row").alias("col"), F.lit(1.0).alias("val"))
    return added.union(ones).groupBy("row", "col").agg(F.sum("val").alias("val"))


def in_polygon(polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a closed polygon; a bounded constant of the plan."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 == y2:
            continue
        over = (F.lit(y1) > F.col("n_km")) != (F.lit(y2) > F.col("n_km"))
        at = (F.lit(x2 - x1) * (F.col("n_km") - y1)) / F.lit(y2 - y1) + x1
        crossings = crossings + F.when(over & (F.col("e_km") < at), 1).otherwise(0)
    return crossings % 2 == 1


def locate(points: DataFrame, triangles: DataFrame, width: float) -> DataFrame:
    """g, s, w: barycentric weights on the corners of the triangle that holds a point (first id on shared edges); none outside.

    triangles: tri, s0, x0, y0, s1, x1, y1, s2, x2, y2; joined by cells that their boxes touch.
    """
    floor = lambda c: F.floor(c / width)
    lo = lambda a: F.least(*(f"{a}{k}" for k in range(3)))
    hi = lambda a: F.greatest(*(f"{a}{k}" for k in range(3)))
    boxed = triangles.withColumn("i", F.explode(F.sequence(floor(lo("x")), floor(hi("x"))))).withColumn("j", F.explode(F.sequence(floor(lo("y")), floor(hi("y")))))
    w = barycentric(F.col("e_km"), F.col("n_km"), [(F.col(f"x{k}"), F.col(f"y{k}")) for k in range(3)])
    tried = points.select("g", "e_km", "n_km", floor(F.col("e_km")).alias("i"), floor(F.col("n_km")).alias("j")).join(boxed, ["i", "j"]).withColumns({f"w{k}": w[k] for k in range(3)})
    held = tried.where("w0 >= -1e-12 AND w1 >= -1e-12 AND w2 >= -1e-12").groupBy("g").agg(F.min_by(F.struct("s0", "w0", "s1", "w1", "s2", "w2"), "tri").alias("b"))
    return held.select("g", F.explode(F.array(*(F.struct(F.col(f"b.s{k}").alias("s"), F.col(f"b.w{k}").alias("w")) for k in range(3)))).alias("x")).select("g", "x.s", "x.w")


def project(weights: DataFrame, field: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """Sparse product: for each g and keys, the sum of weight times the field at its vertices (column s)."""
    return weights.join(field, "s").groupBy("g", *keys).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def combine_regions(grids: list[DataFrame]) -> DataFrame:
    """UNION ALL of grids with cell ids told apart by region."""
    out = None
    for k, one in enumerate(grids):
        one = one.withColumn("region", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out
