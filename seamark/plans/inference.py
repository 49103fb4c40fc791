"""Density-dependent covariates, interactions, errors and draws from a precision, counterfactuals, polygons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seamark.operators import indices, posterior, predict
from seamark.plans import views as v
from seamark.plans.registry import query, r6
from seamark.sources import shapes

_N_K = 6


def _axes(spark):
    return spark.range(v.N_C).select(F.col("id").cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(v.N_T - 1))).alias("t"))


def _field(spark, sf_dir):
    s, c, t = F.col("s"), F.col("c"), F.col("t")
    places = v.knots(spark, sf_dir).select(F.col("x").alias("s")).join(F.broadcast(_axes(spark)))
    return places.withColumn("val", ((s * 7 + c * 3 + t * 5) % 11 - 5) / 10.0)


_BETA = "beta AS (SELECT CAST(c AS INT) AS c, CAST(t AS INT) AS t, 13e-1 + 3e-1 * c - 2e-2 * t + (t * t % 5) / 1e1 AS val FROM range(3) a(c), range(7) b(t)), centred AS (SELECT c, t, val - avg(val) OVER (PARTITION BY c) AS x FROM beta)"
_EPS = "eps AS (SELECT x AS s, c, t, ((x * 7 + c * 3 + t * 5) % 11 - 5) / 1e1 AS val FROM knot, beta)"


def _beta(spark):
    c, t = F.col("c"), F.col("t")
    return _axes(spark).withColumn("val", 1.3 + 0.3 * c - 0.02 * t + (t * t % 5) / 10.0)


@query(f"WITH {_BETA} SELECT c, t, round(x, 6) AS x FROM centred")
def m8_centred_intercepts(spark, sf_dir):
    return posterior.centred_response(_beta(spark)).select("c", "t", r6("x"))


@query(v.with_("knot").rstrip() + f", {_BETA}, {_EPS}, m AS (SELECT c, t, avg(val) AS a FROM eps GROUP BY c, t) SELECT c, t, round(x + a, 6) AS x FROM centred JOIN m USING (c, t)")
def m8_mean_field(spark, sf_dir):
    return posterior.centred_response(_beta(spark), _field(spark, sf_dir)).select("c", "t", r6("x"))


@query(v.with_("knot").rstrip() + f", {_BETA}, {_EPS}, m AS (SELECT c, t, sum(val * exp((s % 5 + c) / 4e0)) / sum(exp((s % 5 + c) / 4e0)) AS a FROM eps GROUP BY c, t) SELECT c, t, round(x + a, 6) AS x FROM centred JOIN m USING (c, t)")
def m8_weighted_field(spark, sf_dir):
    weight = _field(spark, sf_dir).where("t = 0").select("s", "c", ((F.col("s") % 5 + F.col("c")) / 4.0).alias("val"))
    return posterior.centred_response(_beta(spark), _field(spark, sf_dir), weight).select("c", "t", r6("x"))


@query(v.with_("grid").rstrip() + f", {_BETA} SELECT g, c, t, round((c + 1) * (t % 3) / 4e0 * 5e-1 + (g % 7 - 3) / 1e1 * x, 6) AS eta FROM grid, centred")
def m8_density_covariate(spark, sf_dir):
    c, t = F.col("c"), F.col("t")
    rows = v.grid(spark, sf_dir).select("g")
    design = rows.select("g", F.explode(F.sequence(F.lit(0), F.lit(v.N_T - 1))).alias("t")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("p")).withColumn("x", F.when(F.col("p") == 0, t % 3 / 4.0).otherwise(99.0))
    k = spark.range(v.N_C).select(F.col("id").cast("int").alias("c"), F.explode(F.array(F.lit(0), F.lit(1))).alias("p")).withColumns({"gamma": (c + 1) * 0.5, "config": F.when(F.col("p") == 0, 1).otherwise(4)})
    xi = rows.select("g", F.explode(F.sequence(F.lit(0), F.lit(v.N_C - 1))).alias("c"), F.lit(1).alias("p"), ((F.col("g") % 7 - 3) / 10.0).alias("xi"))
    return predict.covariate_effect(design, k, xi, posterior.centred_response(_beta(spark))).select("g", "c", "t", r6("eta"))


@query(v.with_("idx").rstrip() + f", {_BETA} SELECT c, round(25e-1 * sum((val - ln(index)) ** 2), 6) AS nll FROM beta JOIN idx USING (c, t) WHERE l = 'south' GROUP BY c")
def m8_lagrange_penalty(spark, sf_dir):
    idx = indices.index(v.cells(spark, sf_dir)).where("l = 'south'")
    return posterior.lagrange_penalty(_beta(spark), idx, 2.5).select("c", r6("nll"))


#: Interactions of three categories, and the same for the oracle.
_B = np.array([[0.6, 0.1, 0.0], [-0.2, 0.5, 0.1], [0.0, 0.3, 0.4]])
_B_SQL = "b(i, j, val) AS (VALUES (0, 0, 6e-1), (0, 1, 1e-1), (0, 2, 0e0), (1, 0, -2e-1), (1, 1, 5e-1), (1, 2, 1e-1), (2, 0, 0e0), (2, 1, 3e-1), (2, 2, 4e-1))"
_MORTALITY = "mort AS (SELECT c, t, avg(b) / 1e2 AS f FROM obs WHERE b IS NOT NULL GROUP BY c, t)"


def _mortality(spark, sf_dir):
    return v.obs(spark, sf_dir).where("b IS NOT NULL").groupBy("c", "t").agg((F.avg("b") / 100).alias("f"))


@query(v.with_("obs").rstrip() + f", {_MORTALITY}, {_B_SQL}, target AS (SELECT i AS c, -sum((CASE WHEN i = j THEN 1 ELSE 0 END - val) * ln(4e-1)) AS target FROM b GROUP BY i) SELECT c, t, round(f, 6) AS f, round(target, 6) AS target, round(f / target, 6) AS ratio FROM mort JOIN target USING (c)")
def m17_target_mortality(spark, sf_dir):
    return posterior.target_mortality(_mortality(spark, sf_dir), _B).select("c", "t", r6("f"), r6("target"), r6("ratio"))


@query(
    v.with_("obs").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f", {_MORTALITY}, {_B_SQL}, wide AS (SELECT t, coalesce(sum(f) FILTER (c = 0), 0) AS f0, coalesce(sum(f) FILTER (c = 1), 0) AS f1, coalesce(sum(f) FILTER (c = 2), 0) AS f2, row_number() OVER (ORDER BY t) AS k FROM mort GROUP BY t), "
    "walk AS (SELECT k, t, -f0 AS v0, -f1 AS v1, -f2 AS v2 FROM wide WHERE k = 1 UNION ALL SELECT n.k, n.t, 6e-1 * v0 + 1e-1 * v1 - f0, -2e-1 * v0 + 5e-1 * v1 + 1e-1 * v2 - f1, 3e-1 * v1 + 4e-1 * v2 - f2 FROM walk w JOIN wide n ON n.k = w.k + 1) "
    "SELECT 0 AS c, t, round(v0, 6) AS impact FROM walk UNION ALL SELECT 1, t, round(v1, 6) FROM walk UNION ALL SELECT 2, t, round(v2, 6) FROM walk"
)
def w5_category_impact(spark, sf_dir):
    return posterior.category_impact(_mortality(spark, sf_dir), _B).select("c", "t", r6("impact"))


def _design(spark, sf_dir):
    g = F.col("g")
    return v.grid(spark, sf_dir).select("g", F.explode(F.array(F.struct((g % _N_K).alias("k"), F.lit(0.7).alias("w")), F.struct(((g + 1) % _N_K).alias("k"), F.lit(0.3).alias("w")))).alias("e")).select("g", F.col("e.k").cast("int").alias("k"), "e.w")


def _covariance(spark):
    return spark.createDataFrame([(a, b, 0.05 * (a == b) + 0.01) for a in range(_N_K) for b in range(_N_K)], "a int, b int, cov double")


_DESIGN = "design AS (SELECT g, g % 6 AS k, 7e-1 AS w FROM grid UNION ALL SELECT g, (g + 1) % 6, 3e-1 FROM grid), covar AS (SELECT a, b, CASE WHEN a = b THEN 6e-2 ELSE 1e-2 END AS cov FROM range(6) x(a), range(6) y(b))"


@query(
    v.with_("cells").rstrip() + f", {_DESIGN}, var AS (SELECT p.g, sum(p.w * q.w * cov) AS var FROM design p JOIN design q ON p.g = q.g JOIN covar ON a = p.k AND b = q.k GROUP BY p.g), "
    "total AS (SELECT c, t, l, sum(index_g) AS index, sum(index_g * (1 + var / 2)) AS unbiased FROM cells JOIN var USING (g) GROUP BY c, t, l), slope AS (SELECT c, t, l, k, sum(index_g * w) AS s FROM cells JOIN design USING (g) GROUP BY c, t, l, k), "
    "sq AS (SELECT p.c, p.t, p.l, sum(p.s * q.s * cov) AS v FROM slope p JOIN slope q ON p.c = q.c AND p.t = q.t AND p.l = q.l JOIN covar ON a = p.k AND b = q.k GROUP BY p.c, p.t, p.l) SELECT c, t, l, round(index, 4) AS index, round(sqrt(v), 4) AS se, round(unbiased, 4) AS unbiased FROM total JOIN sq USING (c, t, l)"
)
def e10_index_errors(spark, sf_dir):
    got = posterior.delta_method(v.cells(spark, sf_dir), _design(spark, sf_dir), _covariance(spark))
    return got.select("c", "t", "l", *(F.round(x, 4).alias(x) for x in ("index", "se", "unbiased")))


@query()
def e11_index_draws(spark, sf_dir):
    """Indices of a hundred draws of all effects, and their spread."""
    q = np.linalg.inv(np.full((_N_K, _N_K), 0.01) + 0.05 * np.eye(_N_K))
    drawn = posterior.index_draws(v.cells(spark, sf_dir).groupBy("g", "t", "l").agg(F.sum("index_g").alias("index_g")), _design(spark, sf_dir), posterior.draw_effects(spark, np.zeros(_N_K), q), ("t", "l"))
    return posterior.spread(drawn, ["t", "l"], "index")


def _counterfactual(spark, sf_dir, off):
    c, t, g = F.col("c"), F.col("t"), F.col("g")
    axes, cells = _axes(spark), v.grid(spark, sf_dir).where("area > 0").select("g", "e_km", "n_km")
    first = {"intercepts": (axes.withColumn("val", 0.3 + 0.1 * c - 0.05 * t), ["c", "t"]), "space": (cells.select("g", ((g % 7 - 3) / 10.0).alias("val")), ["g"])}
    second = {"intercepts": (axes.withColumn("val", 1.0 + 0.2 * c + 0.03 * t), ["c", "t"]), "space_2": (cells.select("g", ((g * 13 % 9 - 4) / 10.0).alias("val")), ["g"])}
    return indices.cell_index(posterior.counterfactual(cells.join(F.broadcast(axes)), first, second, off), v.cell_area(spark, sf_dir))


_OFF = "p AS (SELECT g, e_km, c, t, 3e-1 + 1e-1 * c - 5e-2 * t AS p1, 1 + 2e-1 * c + 3e-2 * t + (g * 13 % 9 - 4) / 1e1 AS p2 FROM grid, range(3) a(c), range(7) b(t) WHERE area > 0), q AS (SELECT p.g, e_km, c, t, l, 1 / (1 + exp(-p1)) * exp(p2) * a.area AS index_g FROM p JOIN cell_area a ON a.g = p.g)"


@query(v.with_("cell_area").rstrip() + f", {_OFF} SELECT CAST(c AS INT) AS c, CAST(t AS INT) AS t, l, round(sum(index_g), 4) AS index, round(sum(e_km * index_g) / sum(index_g), 6) AS e_km FROM q GROUP BY c, t, l")
def e18_without_space(spark, sf_dir):
    rows = _counterfactual(spark, sf_dir, {"space"})
    return rows.groupBy("c", "t", "l").agg(F.round(F.sum("index_g"), 4).alias("index"), F.round(F.sum(F.col("e_km") * F.col("index_g")) / F.sum("index_g"), 6).alias("e_km"))


#: A shell with a square hole, in km: the shell counterclockwise.
_SHELL = [(0.5, 0.5), (41.5, 0.5), (50.5, 20.5), (41.5, 40.5), (0.5, 40.5)]
_HOLE = [(10.5, 10.5), (10.5, 20.5), (20.5, 20.5), (20.5, 10.5)]


@query(
    "SELECT 2e0 * i AS e_km, 2e0 * j AS n_km, 4e0 AS area FROM range(40) a(i), range(40) b(j) WHERE 2 * j >= 5e-1 AND 2 * j < 405e-1 AND 2 * i >= 5e-1 "
    "AND 2 * i < CASE WHEN 2 * j < 205e-1 THEN 415e-1 + (2 * j - 5e-1) * 9 / 20 ELSE 505e-1 - (2 * j - 205e-1) * 9 / 20 END AND NOT (2 * i >= 105e-1 AND 2 * i < 205e-1 AND 2 * j >= 105e-1 AND 2 * j < 205e-1)"
)
def s4_polygon_grid(spark, sf_dir):
    rows = [("made", 1, ring, k, *map(float, xy)) for ring, points in enumerate((_SHELL, _HOLE)) for k, xy in enumerate(points)]
    return shapes.polygon_grid(shapes.edges(spark.createDataFrame(rows, shapes.VERTICES)))
