"""Loadings, meshes, further observation models, settings, validation, row helpers and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions import geo, links
from seamark.operators import config, covariates, effects, reports, tables
from seamark.operators.lineage import written
from seamark.plans import views as v
from seamark.plans.registry import query, r6
from seamark.plans.spatial import _NEAR, _by_knot, _triangles

_PACKED = [0.9, -0.4, 0.7, 0.2, 0.5, -0.6, 0.3]


@query(
    "WITH n AS (SELECT CAST(a AS INT) AS c, CAST(b AS INT) AS f FROM range(4) x(a), range(4) y(b)), p AS (SELECT 2 / (1 + exp(-8e-1)) - 1 AS rho, exp(2e-1) AS sd), "
    "r AS (SELECT * FROM (VALUES (0, 0, 9e-1), (1, 0, -4e-1), (1, 1, 7e-1), (2, 0, 2e-1), (2, 1, 5e-1), (3, 0, -6e-1), (3, 1, 3e-1)) AS q(c, f, val)), z AS (SELECT sqrt(sum(val * val)) AS s FROM r) "
    "SELECT 'AR1' AS kind, c, f, round(sd * rho ** (c - f) * CASE WHEN f > 0 THEN sqrt(1 - rho * rho) ELSE 1 END, 9) AS val FROM n, p WHERE c >= f "
    "UNION ALL SELECT 'IID', c, f, 1e-1 * (c + 1) FROM n WHERE c = f UNION ALL SELECT 'identity', c, f, 1e0 FROM n WHERE c = f UNION ALL SELECT 'rank', c, f, round(val / s, 9) FROM r, z"
)
def m9_loading_configs(spark, sf_dir):
    kinds = {"AR1": ([0.8, 0.2], effects.AR1), "IID": ([0.1, 0.2, 0.3, 0.4], effects.IID), "identity": ([], effects.IDENTITY), "off": ([], effects.OFF), "rank": (_PACKED, 2)}
    rows = [(kind, c, f, round(val, 9)) for kind, (values, code) in kinds.items() for c, f, val in effects.loading_table(values, 4, code, unit_trace=kind == "rank")[0]]
    return spark.createDataFrame(rows, "kind string, c int, f int, val double")


_FACTORS = "fac AS (SELECT s AS t, f, val FROM scores)"


@query(v.with_("loading", "scores").rstrip() + f", {_FACTORS} SELECT l.c, CAST(a.t AS BIGINT) AS t, round(sum(a.val * l.val) + 1e-1 * l.c - 1e-3 * a.t, 6) AS beta FROM fac a JOIN loading l ON a.f = l.f GROUP BY l.c, a.t")
def m15_intercepts(spark, sf_dir):
    loading, factors = v.loading(spark, sf_dir), v.scores(spark, sf_dir).withColumnRenamed("s", "t")
    mean_c = loading.select("c").distinct().withColumn("val", 0.1 * F.col("c"))
    mean_t = factors.select("t").distinct().withColumn("val", -0.001 * F.col("t"))
    return effects.intercepts(factors, loading, mean_c, mean_t).select("c", F.col("t").cast("bigint").alias("t"), r6("beta"))


@query(v.with_("scores").rstrip() + f", {_FACTORS}, b AS (SELECT a.f, a.val - 6e-1 * coalesce(p.val, 0) AS e FROM fac a LEFT JOIN fac p ON p.f = a.f AND p.t + 1 = a.t) SELECT f, round(sum(5e-1 * ln(2 * pi()) + e * e / 2), 6) AS nll FROM b GROUP BY f")
def m15_autoregressive_nll(spark, sf_dir):
    return effects.autoregressive_penalty(v.scores(spark, sf_dir).withColumnRenamed("s", "t"), 0.6).select("f", r6("nll"))


@query(v.with_("loading", "scores") + "SELECT s.s AS v, l.c, round(sum(s.val * l.val), 6) AS eta FROM scores s JOIN loading l ON s.f = l.f GROUP BY s.s, l.c")
def m16_vessel_effects(spark, sf_dir):
    return effects.vessel_effects(v.scores(spark, sf_dir).withColumnRenamed("s", "v"), v.loading(spark, sf_dir)).select("v", "c", r6("eta"))


@query(v.with_("scores") + "SELECT f, round(sum(5e-1 * ln(2 * pi()) + val * val / 2), 6) AS nll FROM scores GROUP BY f")
def m21_normal_penalty(spark, sf_dir):
    return v.scores(spark, sf_dir).groupBy("f").agg(F.round(effects.normal_penalty(F.col("val")), 6).alias("nll"))


_TRI = """tri AS (SELECT (i * 10 + j) * 2 + up AS tri, i * 11 + j AS s0, 1e2 * i AS x0, 1e2 * j AS y0, CASE WHEN up = 0 THEN (i + 1) * 11 + j ELSE (i + 1) * 11 + j + 1 END AS s1, 1e2 * (i + 1) AS x1,
    1e2 * (j + up) AS y1, CASE WHEN up = 0 THEN (i + 1) * 11 + j + 1 ELSE i * 11 + j + 1 END AS s2, 1e2 * (i + 1 - up) AS x2, 1e2 * (j + 1) AS y2 FROM range(10) a(i), range(10) b(j), range(2) c(up)),
  ar AS (SELECT *, abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2 AS area FROM tri),
  vert AS (SELECT tri, s0 AS s, x2 - x1 AS ex, y2 - y1 AS ey, area FROM ar UNION ALL SELECT tri, s1, x0 - x2, y0 - y2, area FROM ar UNION ALL SELECT tri, s2, x1 - x0, y1 - y0, area FROM ar),
  h AS (SELECT exp(3e-1) AS a, 2e-1 AS b, exp(-3e-1) * (1 + 4e-2) AS d),
  mass AS (SELECT s AS row, s AS col, sum(area / 3) AS val FROM vert GROUP BY s),
  stiff AS (SELECT p.s AS row, q.s AS col, sum((h.d * p.ex * q.ex - h.b * (p.ex * q.ey + p.ey * q.ex) + h.a * p.ey * q.ey) / (4 * p.area)) AS val FROM vert p JOIN vert q ON p.tri = q.tri, h GROUP BY p.s, q.s)"""


def _mesh(spark):
    return effects.mesh_matrices(_triangles(spark), effects.anisotropy(0.3, 0.2))


@query(f"WITH {_TRI} SELECT row, col, round(val, 6) AS val FROM mass")
def m12_mesh_mass(spark, sf_dir):
    return _mesh(spark)[0].select("row", "col", r6("val"))


@query(f"WITH {_TRI} SELECT row, col, round(val, 6) AS val FROM stiff")
def m12_mesh_stiffness(spark, sf_dir):
    return _mesh(spark)[1].select("row", "col", r6("val"))


@query(
    f"WITH {_TRI}, second AS (SELECT a.row, b.col, sum(a.val / m.val * b.val) AS val FROM stiff a JOIN mass m ON m.row = a.col JOIN stiff b ON b.row = a.col GROUP BY a.row, b.col), "
    "e AS (SELECT row, col, 16e-8 * val AS val FROM mass UNION ALL SELECT row, col, 8e-4 * val FROM stiff UNION ALL SELECT row, col, val FROM second) SELECT row, col, round(sum(val), 9) AS val FROM e GROUP BY row, col"
)
def m12_mesh_precision(spark, sf_dir):
    return effects.mesh_precision(*_mesh(spark), 0.02).select("row", "col", F.round("val", 9).alias("val"))


@query("WITH h AS (SELECT exp(3e-1) AS a, 2e-1 AS b, exp(-3e-1) * (1 + 4e-2) AS d), e AS (SELECT (a + d) / 2 AS m, sqrt((a - d) * (a - d) / 4 + b * b) AS g, 5e-1 * atan2(2 * b, a - d) AS w FROM h) SELECT round((m + g) * 50, 9) AS major, round((m - g) * 50, 9) AS minor, round(w, 9) AS angle FROM e")
def v6_anisotropy_ellipse(spark, sf_dir):
    return spark.createDataFrame([tuple(round(x, 9) for x in effects.ellipse(0.3, 0.2, 50.0))], "major double, minor double, angle double")


_COUNTS = "n AS (SELECT o_custkey % 5 AS k, CAST(o_orderkey % 4 AS DOUBLE) AS b, 2e-1 + 6e-1 * (o_orderkey % 7) / 7 AS r1, 5e-1 + (o_orderkey % 11) / 4e0 AS r2, (o_orderkey % 13 - 6) / 6e0 AS delta FROM orders)"


def _counts(spark, sf_dir):
    k = F.col("o_orderkey")
    return v.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("k"), (k % 4).cast("double").alias("b"), (0.2 + 0.6 * (k % 7) / 7).alias("r1"), (0.5 + (k % 11) / 4.0).alias("r2"), ((k % 13 - 6) / 6.0).alias("delta"))


_POIS = "{x} * ln({m}) - ({m}) - lgamma({x} + 1)"


@query(
    f"WITH {_COUNTS}, q AS (SELECT *, r2 * 13e-1 + r2 * r2 * 2e-1 AS vv, r2 * exp(3e-1 * delta - 45e-3) AS m11, r1 * exp(3e-1 * delta - 45e-3) AS m14 FROM n), w AS (SELECT *, r2 * r2 / (vv - r2) AS size, r2 / vv AS p FROM q) "
    "SELECT k, round(sum(CASE WHEN b = 0 THEN ln(1 - r1 + r1 * exp(size * ln(p))) ELSE ln(r1) + lgamma(b + size) - lgamma(size) - lgamma(b + 1) + size * ln(p) + b * ln(1 - p) END), 4) AS zinb, "
    "round(sum(CASE WHEN b = 0 THEN ln(1 - r1 + r1 * exp(-r2)) ELSE ln(r1) + " + _POIS.format(x="b", m="r2") + " END), 4) AS zip, "
    "round(sum(CASE WHEN b = 0 THEN ln(1 - r1 + r1 * exp(-m11)) ELSE ln(r1) + " + _POIS.format(x="b", m="m11") + " END), 4) AS zilnp, "
    "round(sum(" + _POIS.format(x="b", m="r1") + "), 4) AS poisson, round(sum(CASE WHEN b = 0 THEN -r1 ELSE ln(1 - exp(-r1)) END), 4) AS cloglog, round(sum(" + _POIS.format(x="b", m="m14") + "), 4) AS lnp FROM w GROUP BY k"
)
def m18_count_likelihoods(spark, sf_dir):
    b, r1, r2, delta = (F.col(c) for c in ("b", "r1", "r2", "delta"))
    of = lambda kind: F.round(F.sum(links.count_log_likelihood(kind, b, r1, r2, F.lit(0.3), F.lit(0.2), delta)), 4)
    names = {5: "zinb", 7: "zip", 11: "zilnp", 12: "poisson", 13: "cloglog", 14: "lnp"}
    return _counts(spark, sf_dir).groupBy("k").agg(*(of(kind).alias(name) for kind, name in names.items()))


@query(
    f"WITH {_COUNTS}, d AS (SELECT DISTINCT b, r1, r2 FROM n), q AS (SELECT *, r2 ** 6e-1 / ((r1 + 5e-1) * 6e-1) AS rate, 15e-1 AS shape, (r1 + 5e-1) * 4e-1 * r2 ** 4e-1 AS scale, b ** 6e-1 / ((r1 + 5e-1) * 6e-1) AS peak FROM d), "
    "j AS (SELECT *, unnest(range(1, CAST(ceil(peak + 12 * sqrt(peak) + 30) AS BIGINT) + 1)) AS j FROM q WHERE b > 0), "
    "s AS (SELECT b, r1, r2, ln(sum(exp(j * ln(rate) - lgamma(j + 1e0) + (j * shape - 1) * ln(b) - lgamma(j * shape) - j * shape * ln(scale)))) - max(b / scale) - max(rate) AS ld FROM j GROUP BY b, r1, r2 UNION ALL SELECT b, r1, r2, -rate FROM q WHERE b = 0) "
    "SELECT k, round(sum(ld), 4) AS tweedie FROM n JOIN s USING (b, r1, r2) GROUP BY k"
)
def m18_tweedie(spark, sf_dir):
    return _counts(spark, sf_dir).groupBy("k").agg(F.round(F.sum(links.tweedie_density(F.col("b"), F.col("r2"), F.col("r1") + 0.5, 1.4)), 4).alias("tweedie"))


@query(f"WITH {_COUNTS} SELECT k, round(sum(lgamma(4e0) - lgamma(b + 1) - lgamma(4 - b) + b * ln(r1) + (3 - b) * ln(1 - r1)), 4) AS binomial, round(sum(ln(exp(r1) + exp(r2))), 4) AS added, round(sum(ln(exp(r2 + 1) - exp(r1))), 4) AS subtracted FROM n GROUP BY k")
def x6_binomial_log_space(spark, sf_dir):
    b, r1, r2 = F.col("b"), F.col("r1"), F.col("r2")
    sums = {"binomial": links.binomial_density(b, F.lit(3.0), r1), "added": links.log_space_add(r1, r2), "subtracted": links.log_space_subtract(r2 + 1, r1)}
    return _counts(spark, sf_dir).groupBy("k").agg(*(F.round(F.sum(c), 4).alias(n) for n, c in sums.items()))


@query(
    "WITH o AS (SELECT o_orderkey AS i, ((o_orderkey * 37) % 1000 + 5e-1) / 1000 AS u, 5e-1 + o_orderkey % 11 AS m FROM orders), d AS (SELECT DISTINCT u, m FROM o), j AS (SELECT u, m, unnest(range(0, 120)) AS j FROM d), "
    "c AS (SELECT u, m, j, sum(exp(j * ln(m) - m - lgamma(j + 1e0))) OVER (PARTITION BY u, m ORDER BY j) AS cum FROM j), k AS (SELECT u, m, count(*) FILTER (cum < u) AS k FROM c GROUP BY u, m) SELECT i, CAST(k AS INT) AS k FROM o JOIN k USING (u, m)"
)
def x16_poisson_draws(spark, sf_dir):
    i = F.col("o_orderkey")
    return v.table(spark, sf_dir, "orders").select(i.alias("i"), links.poisson_quantile(((i * 37) % 1000 + 0.5) / 1000, 0.5 + i % 11).alias("k"))


_BAD = "bad AS (SELECT CASE WHEN l_orderkey % 900 = 2 THEN 5 ELSE c END AS c, t, CASE WHEN l_orderkey % 500 = 0 THEN 0e0 ELSE a END AS a, CASE WHEN l_orderkey % 700 = 1 THEN -1e0 ELSE b END AS b, 1 AS v FROM obs)"
_RULES = config.Model(obs_model=((2, 0), (13, 0)), n_c=4, n_t=6, overdispersion=(1, 0), yearbounds=((0, 9),), overlaps=((0, 1, 1, 7, 0, 0.0, 1.0),))


@query(
    v.with_("obs").rstrip() + f", {_BAD}, p AS (SELECT c, t, avg(CASE WHEN b > 0 THEN 1e0 ELSE 0e0 END) AS p FROM bad WHERE b IS NOT NULL GROUP BY c, t), f AS ("
    "SELECT 'area must be positive' AS rule, count(*) FILTER (NOT a > 0) AS n FROM bad UNION ALL SELECT 'response is negative', count(*) FILTER (b < 0) FROM bad "
    "UNION ALL SELECT 'category outside 0 to n_c - 1', count(*) FILTER (c >= 4 OR c < 0) FROM bad UNION ALL SELECT 'time step outside 0 to n_t - 1', count(*) FILTER (t >= 6 OR t < 0) FROM bad "
    "UNION ALL SELECT 'category without rows', greatest(0, 4 - count(DISTINCT c)) FROM bad UNION ALL SELECT 'overdispersion with one vessel', CASE WHEN count(DISTINCT v) < 2 THEN 1 ELSE 0 END FROM bad "
    "UNION ALL SELECT 'all encounters with yearly intercepts', count(*) FILTER (p = 1) FROM p UNION ALL SELECT 'no encounters with yearly intercepts', count(*) FILTER (p = 0) FROM p "
    "UNION ALL SELECT unnest(['counts need the Poisson link', 'period outside the time steps', 'overlap outside the axes']), 1) SELECT rule, CAST(n AS BIGINT) AS n FROM f WHERE n > 0"
)
def f16_violations(spark, sf_dir):
    k, obs = F.col("l_orderkey"), v.obs(spark, sf_dir)
    bad = obs.select(F.when(k % 900 == 2, 5).otherwise(F.col("c")).alias("c"), "t", F.when(k % 500 == 0, 0.0).otherwise(F.col("a")).alias("a"), F.when(k % 700 == 1, -1.0).otherwise(F.col("b")).alias("b"), F.lit(1).alias("v"))
    return config.violations(bad, _RULES)


@query(
    "SELECT * FROM (VALUES ('vector', 'Omega', 1, 2), ('vector', 'Epsilon', 1, -1), ('vector', 'Omega', 2, 0), ('vector', 'Epsilon', 2, -2), ('vector', 'Beta', 1, -2), ('vector', 'Beta', 2, -2), ('vector', 'Epsilon_time', 1, -3), ('vector', 'Epsilon_time', 2, -3), "
    "('full', 'Omega', 1, 4), ('full', 'Omega', 2, 4), ('full', 'Epsilon', 1, 1), ('full', 'Epsilon', 2, 3), ('full', 'Beta', 1, -3), ('full', 'Beta', 2, -2), ('full', 'Epsilon_time', 1, 6), ('full', 'Epsilon_time', 2, -1)) AS t(given, field, component, code)"
)
def c214_field_config(spark, sf_dir):
    given = {"vector": [2, 0, "AR1", "iid"], "full": [["full", "Full"], [1, 3], ["identity", "IID"], [6, 0]]}
    return spark.createDataFrame([(name, *row) for name, value in given.items() for row in config.field_config(value, 4, 6)], "given string, field string, component int, code int")


@query(
    "SELECT * FROM (VALUES ('a', 'Beta1', 0, 'fixed', false, false, false), ('a', 'Beta2', 3, 'constant', false, false, false), ('a', 'Epsilon1', 4, 'random', true, true, false), ('a', 'Epsilon2', 6, 'random', false, false, false), "
    "('b', 'Beta1', 5, 'random', true, true, true), ('b', 'Beta2', 6, 'random', false, false, false), ('b', 'Epsilon1', 0, 'random', true, false, false), ('b', 'Epsilon2', 2, 'random', true, false, false)) AS t(given, part, code, effects, variance, correlation, by_category)"
)
def c214_rho_terms(spark, sf_dir):
    rows = [(name, *row) for name, given in (("a", (0, 3, 4, 6)), ("b", (5, 6, 0, 2))) for row in config.rho_terms(given)]
    return spark.createDataFrame(rows, "given string, part string, code int, effects string, variance boolean, correlation boolean, by_category boolean")


@query("SELECT p_partkey AS g, greatest(10e0, least(40e0, CASE WHEN p_size % 9 > 0 THEN CAST(p_size AS DOUBLE) ELSE 10e0 END)) + CASE WHEN p_size % 9 = 0 THEN NULL ELSE 0 END AS x FROM part")
def f18_clamp(spark, sf_dir):
    size = F.col("p_size").cast("double")
    return v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("g"), tables.clamp(F.when(F.col("p_size") % 9 > 0, size), 10.0, 40.0).alias("x"))


@query(v.with_("obs").rstrip() + ", m AS (SELECT avg(b) AS m FROM obs WHERE b IS NOT NULL) SELECT l_orderkey, l_linenumber, g, round(b - m, 6) AS gap FROM obs, m")
def f12_complete_cases(spark, sf_dir):
    """Deviations of complete rows; the others come back as nulls."""
    obs, keys = v.obs(spark, sf_dir), ["l_orderkey", "l_linenumber", "g"]
    whole = tables.complete_cases(obs, ["b"])
    done = whole.join(F.broadcast(whole.agg(F.avg("b").alias("m")))).select(*keys, F.round(F.col("b") - F.col("m"), 6).alias("gap"))
    missing = obs.join(done.select(*keys), keys, "left_anti").select(*keys, F.lit(None).cast("double").alias("gap"))
    return done.unionByName(missing)


@query(v.with_("dens") + "SELECT g, t, round(CASE WHEN g % 3 > 0 THEN d END, 6) AS d FROM dens WHERE c = 0")
def f12_restore(spark, sf_dir):
    rows = v.density(spark, sf_dir).where("c = 0").withColumn("d", F.when(F.col("g") % 3 > 0, F.col("d")))
    return tables.restore(tables.complete_cases(rows, ["d"]).select("g", "t", r6("d")), rows, ["g", "t"])


@query(v.with_("obs", "dens") + "SELECT t, c, pred_tf, count(*) AS n, round(coalesce(sum(b), 0), 4) AS b FROM (SELECT t, c, b, 0 AS pred_tf FROM obs UNION ALL SELECT t, c, 1e0, 1 FROM dens) GROUP BY t, c, pred_tf")
def u2_prediction_rows(spark, sf_dir):
    got = tables.with_predictions(v.obs(spark, sf_dir), v.density(spark, sf_dir).select("g", "t", "c"))
    return got.groupBy("t", "c", "pred_tf").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("b"), F.lit(0.0)), 4).alias("b"))


@query(
    "WITH a AS (SELECT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 5), b AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0) "
    "SELECT 'union' AS kind, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM b EXCEPT SELECT k FROM a)"
)
def u4_set_operations(spark, sf_dir):
    a = v.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity < 5").select(F.col("l_suppkey").alias("k"))
    b = v.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"))
    kind = lambda name, rows: rows.select(F.lit(name).alias("kind"), "k")
    return kind("union", tables.union(a, b)).unionByName(kind("intersect", tables.intersect(a, b))).unionByName(kind("except", tables.difference(b, a)))


@query(v.with_("grid") + "SELECT grid.g, area, coalesce(p_size, 0) AS p_size, round(p_retailprice, 4) AS price FROM grid LEFT JOIN part ON p_partkey = g AND p_size > 10")
def u6_bind_columns(spark, sf_dir):
    more = v.table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("g"), "p_size", F.round("p_retailprice", 4).alias("price"), F.lit(0.0).alias("area"))
    return tables.bind_columns(v.grid(spark, sf_dir).select("g", "area"), more, ["g"]).select("g", "area", F.coalesce("p_size", F.lit(0)).alias("p_size"), "price")


@query("SELECT o_orderkey AS k, 'head' AS part FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7) UNION ALL SELECT o_orderkey, 'tail' FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7)")
def o4_preview(spark, sf_dir):
    return tables.preview(v.table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 7).select(F.col("o_orderkey").alias("k"), "part")


@query(v.with_("reps") + "SELECT g, t, round(quantile_cont(val, 9e-1), 6) AS fun FROM reps GROUP BY g, t")
def a25_replicate_quantile(spark, sf_dir):
    got = tables.replicate_summary(v.replicates(spark, sf_dir), ["g", "t"], lambda x: F.percentile(x, F.lit(0.9)))
    return got.select("g", "t", r6("fun"))


@query(v.with_("reps") + "SELECT g, round(max(val) - min(val), 6) AS fun FROM reps GROUP BY g")
def d1_replicate_function(spark, sf_dir):
    """A function in Python, over each cell's replicates."""
    return tables.replicate_summary(v.replicates(spark, sf_dir), ["g"], lambda x: x.max() - x.min(), schema="double").select("g", r6("fun"))


@query(v.with_("obs", "grid", "knot").rstrip() + f", {_NEAR}, d AS (SELECT near.b.x AS x, t, o.b AS val FROM obs o JOIN near ON near.g = o.g WHERE o.b IS NOT NULL), m AS (SELECT x, t, max(val) AS m FROM d GROUP BY x, t), ov AS (SELECT x, max(val) AS m FROM d GROUP BY x) SELECT xs.x, ts.t, round(coalesce(m.m, ov.m), 6) AS val FROM (SELECT DISTINCT x FROM d) xs CROSS JOIN (SELECT DISTINCT t FROM d) ts LEFT JOIN m ON m.x = xs.x AND m.t = ts.t JOIN ov ON ov.x = xs.x")
def d2_covariate_function(spark, sf_dir):
    return covariates.knot_covariates(_by_knot(spark, sf_dir), fun=F.max).select("x", "t", r6("val"))


@query(v.with_("dens") + "SELECT CAST(floor(e_km / 6e1) AS INT) AS i, CAST(floor(n_km / 6e1) AS INT) AS j, round(max(d), 6) AS d FROM dens GROUP BY 1, 2")
def d3_raster_function(spark, sf_dir):
    return tables.binned(v.density(spark, sf_dir), 60.0, "d", F.max).select("i", "j", r6("d"))


@query(v.with_("dens") + "SELECT g, round(max(CASE WHEN t = 0 THEN ln(d) END), 6) AS t0, round(max(CASE WHEN t = 1 THEN ln(d) END), 6) AS t1 FROM dens WHERE c = 0 GROUP BY g")
def d4_cluster_features(spark, sf_dir):
    got = tables.cluster_features(v.density(spark, sf_dir).where("c = 0"), "g", "t", "d", F.ln, [0, 1])
    return got.select("g", r6("0", "t0"), r6("1", "t1"))


@query(v.with_("cell_area") + ", b AS (SELECT g AS x, CAST(t AS INT) AS t, CAST((g * 7 + t) % 23 AS DOUBLE) AS b FROM (SELECT DISTINCT g FROM cell_area), range(3) AS r(t)), w AS (SELECT g, sum(area) AS w FROM cell_area GROUP BY g) SELECT l, t, round(sum(b * area / w), 6) AS b FROM b JOIN cell_area a ON a.g = b.x JOIN w ON w.g = a.g GROUP BY l, t")
def a33_stratum_truth(spark, sf_dir):
    areas = v.cell_area(spark, sf_dir).withColumnRenamed("g", "x")
    sites = areas.select("x").distinct().select("x", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t")).withColumn("b", ((F.col("x") * 7 + F.col("t")) % 23).cast("double"))
    return tables.stratum_truth(sites, areas).select("l", "t", r6("b"))


_OVERLAPS = [(0, 0, 1, 1, 4, 0, 0.0, 1.0), (1, 0, 1, 1, 4, 1, 0.0, 1.0), (2, 2, 3, 0, 6, 2, 0.5, 2.0), (3, 1, 0, 1, 5, 1, 0.0, 1.0)]


@query(
    v.with_("dens").rstrip() + ", o AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in _OVERLAPS) + ") AS q(o, c1, t1, c2, t2, kind, threshold, slope)), "
    "p AS (SELECT o.*, a.g, a.d AS d1, b.d AS d2, a.area FROM o JOIN dens a ON a.c = c1 AND a.t = t1 JOIN dens b ON b.c = c2 AND b.t = t2 AND a.g = b.g), s AS (SELECT o, sum(d1 * area) AS s1, sum(d2 * area) AS s2 FROM p GROUP BY o) "
    "SELECT o, round(CASE max(kind) WHEN 0 THEN sum(d1 * d2 * area / s2) WHEN 1 THEN 1 - 5e-1 * sum(abs(d1 * area / s1 - d2 * area / s2)) ELSE sum(area / (1 + exp(-(ln(d1) - threshold) * slope))) END, 6) AS overlap FROM p JOIN s USING (o) GROUP BY o"
)
def j17_overlap_table(spark, sf_dir):
    table = spark.createDataFrame(_OVERLAPS, "o int, c1 int, t1 int, c2 int, t2 int, kind int, threshold double, slope double")
    return tables.overlaps(v.density(spark, sf_dir), table).select("o", r6("overlap"))


@query("SELECT count(*) AS n, CAST(31 AS INT) AS zone, false AS south FROM orders")
def f15_legacy_projection(spark, sf_dir):
    """Places about longitudes -20 to 2 and latitudes 30 to 54, projected and back."""
    rows = v.covariates(spark, sf_dir).withColumn("lon", F.col("lon") + 14.0)
    zone, south = geo.find_zone(rows, "lon", "lat")
    back = geo.utm_inverse(F.col("e_km"), F.col("n_km"), zone, south)
    moved = written(geo.lon_lat_to_east_north(rows, "lon", "lat"))  # the two series in one expression are beyond what is compiled
    return moved.where((F.abs(back[0] - F.col("lon")) < 1e-4) & (F.abs(back[1] - F.col("lat")) < 1e-4)).agg(F.count("*").alias("n")).withColumns({"zone": F.lit(zone), "south": F.lit(south)})


@query(
    v.with_("dens") + "SELECT 'encounter_prob' AS variable, g, c, t, round(r1, 6) AS value FROM dens UNION ALL SELECT 'pos_catch', g, c, t, round(ln(r2), 6) FROM dens UNION ALL SELECT 'ln_density', g, c, t, round(ln(d), 6) FROM dens "
    "UNION ALL SELECT 'total_density', g, c, t, round(ln(sum(d) OVER (PARTITION BY g, t)), 6) FROM dens UNION ALL SELECT 'omega_1', g, c, t, round(p1 / 10, 6) FROM dens"
)
def r215_map_tables(spark, sf_dir):
    d = v.density(spark, sf_dir)
    return reports.map_table(d, [1, 2, 3, 13, 16], {"omega_1": d.select("g", "c", "t", (F.col("p1") / 10).alias("val"))}).select("variable", "g", "c", "t", r6("value"))


@query(
    v.with_("obs", "grid", "knot") + "SELECT 'sample' AS kind, t, e_km, n_km, count(*) AS n FROM obs JOIN grid USING (g) GROUP BY t, e_km, n_km UNION ALL SELECT 'knot', -1, e_km, n_km, 1 FROM knot UNION ALL SELECT 'cell', -1, e_km, n_km, 1 FROM grid"
)
def r215_data_tables(spark, sf_dir):
    grid = v.grid(spark, sf_dir)
    return reports.data_tables(v.obs(spark, sf_dir).join(grid.select("g", "e_km", "n_km"), "g"), v.knots(spark, sf_dir), grid).withColumn("t", F.coalesce("t", F.lit(-1)))
