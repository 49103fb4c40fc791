"""Spatial, covariate and sampling operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions import geo
from seamark.operators import covariates as cov
from seamark.operators import sampling, spatial
from seamark.plans import views as v
from seamark.plans.registry import query, r6
from seamark.plans.views import with_


@query(with_("meta") + "SELECT c, t, num_nonzero, num_notna, num_total, round(sum_posdens, 6) AS sum_posdens, round(prop_nonzero, 6) AS prop_nonzero, round(mean_posdens, 6) AS mean_posdens FROM meta")
def a1_encounter_metadata(spark, sf_dir):
    return sampling.encounter_metadata(v.obs(spark, sf_dir)).select("c", "t", "num_nonzero", "num_notna", "num_total", r6("sum_posdens"), r6("prop_nonzero"), r6("mean_posdens"))


@query(with_("meta") + "SELECT c, t FROM ct")
def a1_dense_time_axis(spark, sf_dir):
    return sampling.dense_axes(v.obs(spark, sf_dir))


@query(with_("meta") + "SELECT o.c, o.t, count(*) AS n, count(CASE WHEN num_nonzero > 0 THEN b END) AS n_left, round(sum(CASE WHEN num_nonzero > 0 THEN b END), 6) AS sum_b FROM obs o JOIN meta m ON o.c = m.c AND o.t = m.t GROUP BY o.c, o.t")
def f7_all_zero_to_null(spark, sf_dir):
    return sampling.null_all_zero(v.obs(spark, sf_dir)).groupBy("c", "t").agg(F.count("*").alias("n"), F.count("b").alias("n_left"), F.round(F.sum("b"), 6).alias("sum_b"))


@query(with_("meta") + "SELECT c, t, round(CASE WHEN prop_nonzero = 0 THEN -2e1 WHEN prop_nonzero = 1 THEN 2e1 ELSE ln((1e-2 + 98e-2 * prop_nonzero) / (1 - (1e-2 + 98e-2 * prop_nonzero))) END, 6) AS beta1, round(CASE WHEN mean_posdens > 0 THEN ln(mean_posdens) END, 6) AS beta2 FROM meta")
def e4_start_values(spark, sf_dir):
    return sampling.start_values(sampling.encounter_metadata(v.obs(spark, sf_dir))).select("c", "t", r6("beta1"), r6("beta2"))


@query(with_("obs") + "SELECT count(*) AS n, count(DISTINCT v) AS n_v, count(DISTINCT g) AS n_g, count(DISTINCT (c, t)) AS n_ct, round(avg(a), 6) AS mean_a FROM obs")
def a31_distinct_levels(spark, sf_dir):
    return v.obs(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("v").alias("n_v"), F.countDistinct("g").alias("n_g"), F.countDistinct("c", "t").alias("n_ct"), F.round(F.avg("a"), 6).alias("mean_a"))


@query(with_("obs") + "SELECT v, v_code, n FROM (SELECT v, count(*) AS n, row_number() OVER (ORDER BY v) - 1 AS v_code FROM obs WHERE v IS NOT NULL GROUP BY v)")
def j18_vessel_codes(spark, sf_dir):
    return sampling.vessel_codes(v.obs(spark, sf_dir)).groupBy("v", F.col("v_code").cast("bigint").alias("v_code")).agg(F.count("*").alias("n"))


@query(with_("grid") + "SELECT g, e_km, round(n_km, 6) AS n_km, area FROM grid WHERE area > 0")
def f1_positive_area(spark, sf_dir):
    return v.grid(spark, sf_dir).where("area > 0").select("g", "e_km", r6("n_km"), "area")


@query(with_("grid", "cell_area") + "SELECT g FROM grid WHERE include AND area > 0 AND g IN (SELECT g FROM cell_area GROUP BY g HAVING sum(area) > 0)")
def f2_knot_source(spark, sf_dir):
    return spatial.knot_source(v.grid(spark, sf_dir), v.cell_area(spark, sf_dir)).select("g")


@query(with_("grid", "strata") + "SELECT g, (SELECT l FROM strata WHERE n_km > lo AND n_km <= hi ORDER BY lo LIMIT 1) AS l FROM grid")
def f3_half_open_strata(spark, sf_dir):
    return v.grid(spark, sf_dir).select("g", spatial.match_strata(v.STRATA).alias("l"))


@query("SELECT p_partkey AS g, CASE WHEN p_size IN (1, 5, 9, 13) THEN 'odd' WHEN p_size IN (2, 4, 8, 16, 32) THEN 'power' END AS l FROM part WHERE p_size IN (1, 5, 9, 13, 2, 4, 8, 16, 32)")
def f4_stratum_membership(spark, sf_dir):
    size = F.col("p_size")
    part = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("g"), F.when(size.isin(1, 5, 9, 13), "odd").when(size.isin(2, 4, 8, 16, 32), "power").alias("l"))
    return part.where("l IS NOT NULL")


_LL = "ll AS (SELECT g, -126e0 + 6e0 * (g % 83) / 83e0 AS lon, -5e1 + 1e2 * (g % 97) / 97e0 AS lat FROM grid)"


def _utm_sql() -> str:
    k = geo.CONSTANTS
    c = 2 * k["n"] ** 0.5 / (1 + k["n"])
    e = " + ".join(["eta", *(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(k["alpha"], 1))])
    n = " + ".join(["xi", *(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(k["alpha"], 1))])
    return (
        f"{_LL}, u1 AS (SELECT g, radians(lat) AS phi, radians(lon + 123e0) AS lam FROM ll), u2 AS (SELECT g, lam, sinh(atanh(sin(phi)) - {c!r} * atanh({c!r} * sin(phi))) AS tt FROM u1), "
        f"u3 AS (SELECT g, atan2(tt, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + tt * tt)) AS eta FROM u2) "
        f"SELECT g, round(5e2 + {geo.K0 * k['a']!r} * ({e}), 4) AS e_km, round({geo.K0 * k['a']!r} * ({n}), 4) AS n_km FROM u3"
    )


def _lon_lat(spark, sf_dir):
    g = F.col("g")
    return v.grid(spark, sf_dir).select("g", (-126.0 + 6.0 * (g % 83) / 83.0).alias("lon"), (-50.0 + 100.0 * (g % 97) / 97.0).alias("lat"))


@query(with_("grid").rstrip() + ", " + _utm_sql())
def f14_utm_forward(spark, sf_dir):
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), 10)
    return _lon_lat(spark, sf_dir).select("g", F.round(e, 4).alias("e_km"), F.round(n, 4).alias("n_km"))


@query(with_("grid").rstrip() + f", {_LL} SELECT g, round(lon, 5) AS lon, round(lat, 5) AS lat FROM ll")
def f14_utm_inverse(spark, sf_dir):
    """There and back again is the identity."""
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), 10)
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"), 10)
    return _lon_lat(spark, sf_dir).select("g", e.alias("e"), n.alias("n")).select("g", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


_NEAR = "near AS (SELECT g, min(struct_pack(d2 := (q.e_km - k.e_km) * (q.e_km - k.e_km) + (q.n_km - k.n_km) * (q.n_km - k.n_km), x := x)) AS b FROM grid q, knot k GROUP BY g)"


@query(with_("grid", "knot").rstrip() + f", {_NEAR} SELECT g, b.x AS x, round(b.d2, 6) AS d2 FROM near")
def j1_nearest_knot(spark, sf_dir):
    return spatial.nearest(v.grid(spark, sf_dir), v.knots(spark, sf_dir), "x").select("g", "x", r6("d2"))


@query(with_("grid", "knot").rstrip() + f", {_NEAR} SELECT g, b.x AS x, round(b.d2, 6) AS d2 FROM near")
def j1_nearest_bucketed(spark, sf_dir):
    return spatial.nearest_bucketed(v.grid(spark, sf_dir), v.knots(spark, sf_dir), "x").select("g", "x", r6("d2"))


def _queries(spark, sf_dir):
    """Places and years to look covariates up for; every hundredth customer."""
    k = F.col("c_custkey")
    return v.table(spark, sf_dir, "customer").select(k.alias("q"), (1996 + k % 5).cast("int").alias("year"), (30.0 + (k % 53) * 0.4).alias("lat"), (-20.0 + (k % 47) * 0.4).alias("lon"))


_Q = "q AS (SELECT c_custkey AS q, CAST(1996 + c_custkey % 5 AS INT) AS year, 30e0 + (c_custkey % 53) * 4e-1 AS lat, -20e0 + (c_custkey % 47) * 4e-1 AS lon FROM customer)"


def _sites(spark, sf_dir):
    """Covariates by year and place: the smallest id of each, so that a year's table is bounded by its places."""
    return v.covariates(spark, sf_dir).where("year IS NOT NULL").groupBy("year", "lat", "lon").agg(F.min("id").alias("id"), F.min_by("val", "id").alias("val"))


@query(with_("cov").rstrip() + f", {_Q}, s AS (SELECT year, lat, lon, min(id) AS id, arg_min(val, id) AS val FROM cov WHERE year IS NOT NULL GROUP BY 1, 2, 3), m AS (SELECT q.q, q.year, min(struct_pack(d2 := (q.lat - s.lat) * (q.lat - s.lat) + (q.lon - s.lon) * (q.lon - s.lon), id := s.id, val := s.val)) AS b FROM q JOIN s ON q.year = s.year GROUP BY q.q, q.year) SELECT q, year, b.id AS cov_id, round(b.val, 6) AS val FROM m")
def j3_covariate_nearest_in_year(spark, sf_dir):
    return cov.nearest_in_year(_queries(spark, sf_dir), _sites(spark, sf_dir), ["val"]).select("q", "year", "cov_id", r6("val"))


@query(with_("cov") + ", e AS (SELECT id, year, val FROM cov WHERE year IS NOT NULL UNION ALL SELECT id, CAST(1995 + y AS INT), val FROM cov, range(7) AS r(y) WHERE year IS NULL) SELECT CAST(year AS INT) AS year, count(*) AS n, round(avg(val), 4) AS mean_val FROM e GROUP BY year")
def j4_static_covariates(spark, sf_dir):
    return cov.spread_static(v.covariates(spark, sf_dir), list(range(1995, 2002))).groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg("val"), 4).alias("mean_val"))


@query(with_("cov") + ", nw AS (SELECT id, year, lat, lon, val * 2 AS val FROM cov WHERE id % 5 = 0 AND year IS NOT NULL), u AS (SELECT * FROM cov o WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.lat = o.lat AND nw.lon = o.lon AND nw.year = o.year) UNION ALL SELECT * FROM nw) SELECT id, CAST(coalesce(year, 0) AS INT) AS year, round(val, 4) AS val FROM u")
def j5_anti_join_replaced(spark, sf_dir):
    old = v.covariates(spark, sf_dir)
    new = old.where("id % 5 = 0 AND year IS NOT NULL").withColumn("val", F.col("val") * 2)
    return cov.replace_rows(old, new).select("id", F.coalesce("year", F.lit(0)).alias("year"), F.round("val", 4).alias("val"))


_MEAS = "meas AS (SELECT s_suppkey AS id, CAST(t AS INT) AS t, 5e1 * (s_suppkey % 10) AS e_km, 5e1 * ((s_suppkey // 10) % 10) AS n_km, CAST(s_suppkey * 3 + t AS DOUBLE) AS val FROM supplier, range(3) AS y(t))"


@query(with_("grid").rstrip() + f", {_MEAS}, r AS (SELECT q.g, m.t, m.val, row_number() OVER (PARTITION BY q.g, m.t ORDER BY (q.e_km - m.e_km) * (q.e_km - m.e_km) + (q.n_km - m.n_km) * (q.n_km - m.n_km), m.id) AS r FROM grid q, meas m) SELECT g, t, round(avg(val), 6) AS val FROM r WHERE r <= 5 GROUP BY g, t")
def j6_knn_mean(spark, sf_dir):
    t = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t")
    meas = v.knots(spark, sf_dir).select(F.col("x").alias("id"), "e_km", "n_km", t).withColumn("val", (F.col("id") * 3 + F.col("t")).cast("double"))
    return cov.nearest_mean(v.grid(spark, sf_dir).select("g", "e_km", "n_km", t), meas, 5).select("g", "t", r6("val"))


_WEIGHTS = "w AS (SELECT g, CAST((g * 7 + k) % 500 AS INT) AS s, (k + 1) / 6e0 AS w FROM grid, range(3) AS r(k))"


@query(with_("grid", "scores").rstrip() + f", {_WEIGHTS} SELECT g, f, round(sum(w * val), 6) AS val FROM w JOIN scores USING (s) GROUP BY g, f")
def j7_sparse_projection(spark, sf_dir):
    w = v.grid(spark, sf_dir).select("g", F.explode(F.array(*(F.struct(((F.col("g") * 7 + k) % 500).cast("int").alias("s"), F.lit((k + 1) / 6.0).alias("w")) for k in range(3)))).alias("x")).select("g", "x.s", "x.w")
    return spatial.project(w, v.scores(spark, sf_dir), ["f"]).select("g", "f", r6("val"))


@query(with_("grid", "knot").rstrip() + f", {_NEAR} SELECT b.x AS x, count(*) AS n, 1e0 AS w FROM near GROUP BY b.x")
def j8_one_hot(spark, sf_dir):
    """Coarse projection: weight 1 at the nearest knot."""
    near = spatial.nearest(v.grid(spark, sf_dir), v.knots(spark, sf_dir), "x").select("g", F.col("x").alias("s"), F.lit(1.0).alias("w"))
    return near.groupBy(F.col("s").alias("x")).agg(F.count("*").alias("n"), F.max("w").alias("w"))


def _triangles(spark):
    """The lower and upper triangles of a lattice of squares of 100 km; vertex number 10 i + j."""
    t = spark.range(100).select((F.col("id") % 10).alias("i"), F.floor(F.col("id") / 10).alias("j"))
    one = lambda up: F.struct(*((c.alias(n)) for n, c in _corners(up)))
    return t.select(F.explode(F.array(one(0), one(1))).alias("x")).select("x.*")


def _corners(up: int):
    i, j = F.col("i"), F.col("j")
    places = [(i, j), (i + 1, j), (i + 1, j + 1)] if not up else [(i, j), (i + 1, j + 1), (i, j + 1)]
    out = [("tri", (i * 10 + j) * 2 + up)]
    for k, (a, b) in enumerate(places):
        out += [(f"s{k}", a * 11 + b), (f"x{k}", 100.0 * a), (f"y{k}", 100.0 * b)]
    return out


@query(with_("grid") + ", p AS (SELECT g, e_km, n_km, CAST(floor(e_km / 1e2) AS INT) AS i, CAST(floor(n_km / 1e2) AS INT) AS j, e_km / 1e2 - floor(e_km / 1e2) AS u, n_km / 1e2 - floor(n_km / 1e2) AS v FROM grid), "
       "w AS (SELECT g, i * 11 + j AS s, CASE WHEN v <= u THEN 1 - u ELSE 1 - v END AS w FROM p UNION ALL SELECT g, (i + 1) * 11 + j + 1, CASE WHEN v <= u THEN v ELSE u END FROM p UNION ALL SELECT g, CASE WHEN v <= u THEN (i + 1) * 11 + j ELSE i * 11 + j + 1 END, abs(u - v) FROM p) "
       "SELECT g, round(sum(w), 6) AS total, round(sum(w * (s // 11)), 4) AS e_back, round(sum(w * (s % 11)), 4) AS n_back FROM w GROUP BY g")
def j9_barycentric(spark, sf_dir):
    w = spatial.locate(v.grid(spark, sf_dir), _triangles(spark), 100.0)
    e, n = F.floor(F.col("s") / 11), F.col("s") % 11
    return w.groupBy("g").agg(F.round(F.sum("w"), 6).alias("total"), F.round(F.sum(F.col("w") * e), 4).alias("e_back"), F.round(F.sum(F.col("w") * n), 4).alias("n_back"))


_POLY = [(55.0, 33.0), (405.0, 63.0), (455.0, 403.0), (205.0, 253.0), (105.0, 443.0)]
_EDGES = "poly AS (SELECT * FROM (VALUES " + ", ".join(f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(_POLY, [*_POLY[1:], _POLY[0]])) + ") AS v(x1, y1, x2, y2))"


@query(with_("grid").rstrip() + f", {_EDGES} SELECT g, sum(CASE WHEN (y1 > n_km) <> (y2 > n_km) AND e_km < (x2 - x1) * (n_km - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM grid, poly GROUP BY g")
def j10_point_in_polygon(spark, sf_dir):
    return v.grid(spark, sf_dir).select("g", spatial.in_polygon(_POLY).alias("inside"))


@query("SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, 5e0 + i * 25e0 AS e_km, 1e1 + j * 25e0 AS n_km FROM range(20) AS a(i), range(18) AS b(j)")
def j11_grid(spark, sf_dir):
    return spatial.grid(5.0, 499.0, 10.0, 440.0, 25.0, spark).select("i", "j", "e_km", "n_km")


@query("WITH l AS (SELECT CAST(i * 40 + j AS INT) AS g, i, j FROM range(30) AS a(i), range(40) AS b(j)) SELECT a.g, b.g AS h, CAST(abs(a.i - b.i) + abs(a.j - b.j) AS INT) AS kind FROM l a JOIN l b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1")
def j12_lattice_neighbours(spark, sf_dir):
    cells = spatial.grid(0.0, 29.0, 0.0, 39.0, 1.0, spark).withColumn("g", (F.col("i") * 40 + F.col("j")).cast("int"))
    return spatial.lattice(cells)


@query(with_("net") + ", e AS (SELECT *, exp(-3e-1 * dist) AS rho, 1 - exp(-3e-1 * dist) * exp(-3e-1 * dist) AS vv FROM net WHERE edge > 0), q AS (SELECT parent AS row, parent AS col, rho * rho / vv AS val FROM e UNION ALL SELECT child, child, rho * rho / vv FROM e UNION ALL SELECT parent, child, -rho / vv FROM e UNION ALL SELECT child, parent, -rho / vv FROM e UNION ALL SELECT n, n, 1e0 FROM (SELECT parent AS n FROM net UNION SELECT child FROM net)) SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(sum(val), 6) AS val FROM q GROUP BY 1, 2")
def j13_network_precision(spark, sf_dir):
    return spatial.network_precision(v.network(spark, sf_dir), 0.3).select("row", "col", r6("val"))


@query(with_("grid", "knot").rstrip() + f", {_NEAR}, a AS (SELECT b.x AS x, sum(area) AS area FROM near JOIN grid USING (g) GROUP BY b.x) SELECT knot.x, coalesce(area, 0e0) AS area FROM knot LEFT JOIN a ON knot.x = a.x")
def a2_knot_area(spark, sf_dir):
    return spatial.knot_areas(v.grid(spark, sf_dir), v.knots(spark, sf_dir), [])


@query(with_("cell_area") + "SELECT g, l, area FROM cell_area UNION ALL SELECT g, 'Total', sum(area) FROM cell_area GROUP BY g")
def a4_total_stratum(spark, sf_dir):
    return spatial.with_total(v.cell_area(spark, sf_dir))


@query(with_("knot") + ", box AS (SELECT min(e_km) AS e0, max(e_km) AS e1, min(n_km) AS n0, max(n_km) AS n1 FROM knot), c AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, e0 - (e1 - e0) / 1e1 + i * 2e1 AS e_km, n0 - (n1 - n0) / 1e1 + j * 2e1 AS n_km FROM box, range(100) AS a(i), range(100) AS b(j) WHERE i <= floor((e1 - e0) * 12e-1 / 2e1) AND j <= floor((n1 - n0) * 12e-1 / 2e1)) SELECT i, j, e_km, n_km FROM c WHERE (SELECT min((c.e_km - k.e_km) * (c.e_km - k.e_km) + (c.n_km - k.n_km) * (c.n_km - k.n_km)) FROM knot k) < 2e2")
def s8_auto_grid(spark, sf_dir):
    return spatial.auto_grid(v.knots(spark, sf_dir), 20.0).select("i", "j", "e_km", "n_km")


@query(with_("grid") + "SELECT g, CAST(0 AS INT) AS region, area FROM grid WHERE g % 2 = 0 UNION ALL SELECT g, 1, area FROM grid WHERE g % 2 = 1")
def u1_union_regions(spark, sf_dir):
    g = v.grid(spark, sf_dir).select("g", "area")
    return spatial.combine_regions([g.where("g % 2 = 0"), g.where("g % 2 = 1")]).select("g", "region", "area")


@query(with_("obs", "grid", "knot").rstrip() + f", {_NEAR}, d AS (SELECT near.b.x AS x, t, o.b AS val FROM obs o JOIN near ON near.g = o.g WHERE o.b IS NOT NULL), m AS (SELECT x, t, avg(val) AS m FROM d GROUP BY x, t), ov AS (SELECT x, avg(val) AS m FROM d GROUP BY x) SELECT xs.x, ts.t, round(coalesce(m.m, ov.m), 6) AS val FROM (SELECT DISTINCT x FROM d) xs CROSS JOIN (SELECT DISTINCT t FROM d) ts LEFT JOIN m ON m.x = xs.x AND m.t = ts.t JOIN ov ON ov.x = xs.x")
def a23_knot_covariates(spark, sf_dir):
    return cov.knot_covariates(_by_knot(spark, sf_dir)).select("x", "t", r6("val"))


@query(with_("obs", "grid", "knot").rstrip() + f", {_NEAR}, d AS (SELECT near.b.x AS x, t, o.b AS val FROM obs o JOIN near ON near.g = o.g WHERE o.b IS NOT NULL), m AS (SELECT x, t, avg(val) AS m FROM d GROUP BY x, t) SELECT round(1 - var_samp(m) / var_samp(val), 6) AS lost FROM d JOIN m USING (x, t)")
def a23_covariate_variance_lost(spark, sf_dir):
    return cov.variance_lost(_by_knot(spark, sf_dir)).select(r6("lost"))


def _by_knot(spark, sf_dir):
    near = spatial.nearest(v.grid(spark, sf_dir), v.knots(spark, sf_dir), "x").select("g", "x")
    return v.obs(spark, sf_dir).where("b IS NOT NULL").join(near.hint("merge"), "g").select("x", "t", F.col("b").alias("val"))


@query("SELECT count(*) AS n, round(avg(x1), 6) AS x1, round(avg(x2), 6) AS x2, round(avg(x3), 6) AS x3 FROM (SELECT CAST(p_size AS DOUBLE) AS x1, CAST(p_size AS DOUBLE) * p_size AS x2, CASE WHEN p_brand = (SELECT p_brand FROM (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 2) ORDER BY 1 DESC LIMIT 1) THEN CAST(p_size AS DOUBLE) ELSE 0e0 END AS x3 FROM part)")
def x18_design_columns(spark, sf_dir):
    part = v.table(spark, sf_dir, "part").select("p_size", "p_brand")
    rows, names = cov.design(part, "~ p_size + I(p_size^2) + p_size:factor(p_brand)")
    return rows.agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(f"`{c}`")), 6).alias(f"x{k}") for k, c in enumerate(names[:3], 1)))
