"""Fits, simulation, forecasts and clustering: checked by invariants in tests, not by SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seamark.operators import estimate, sampling, spatial
from seamark.plans import views as v
from seamark.plans.diagnostic import fitted
from seamark.plans.registry import query


def _levels(rows):
    """Indicator columns of category and time without an intercept's twin."""
    cols = [(c, t) for c in range(v.N_C) for t in range(v.N_T) if (c, t) not in ((0, 0), (2, 3), (1, 5))]
    return rows.select("*", *(((F.col("c") == c) & (F.col("t") == t)).cast("double").alias(f"x{c}_{t}") for c, t in cols)), [f"x{c}_{t}" for c, t in cols]


@query()
def e7_glm_binomial(spark, sf_dir):
    rows, names = _levels(fitted(spark, sf_dir).withColumn("y", (F.col("b") > 0).cast("double")))
    a, b, nll = estimate.fit_binomial(rows, names)
    return spark.createDataFrame([("intercept", a), *b.items(), ("nll", nll)], "name string, value double")


@query()
def e7_glm_gamma(spark, sf_dir):
    rows, names = _levels(fitted(spark, sf_dir).where("b > 0").withColumn("y", F.col("b")).withColumn("off", F.ln("a")))
    a, b, nll = estimate.fit_gamma(rows, names, "off")
    return spark.createDataFrame([("intercept", a), *b.items(), ("half_deviance", nll)], "name string, value double")


@query("WITH p AS (SELECT ln(l_quantity) AS y, CAST(l_linenumber AS DOUBLE) AS x FROM lineitem WHERE l_quantity > 0), s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p) SELECT round(a + (SELECT avg((y - a - b * x) * (y - a - b * x)) FROM p) / 2, 6) AS intercept, round(b, 6) AS slope, round(sqrt((SELECT avg((y - a - b * x) * (y - a - b * x)) FROM p)), 6) AS sigma FROM s")
def e7_lognormal(spark, sf_dir):
    rows = v.table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(F.col("l_quantity").cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("x"))
    a, b, s = estimate.fit_lognormal(rows, ["x"])
    return spark.createDataFrame([(round(a, 6), round(b["x"], 6), round(s, 6))], "intercept double, slope double, sigma double")


@query()
def e7_random_intercepts(spark, sf_dir):
    """Vessel effects on encounters; vessels with equal counts have equal effects, so one row for each (y, n) leaves the cluster."""
    by = fitted(spark, sf_dir).groupBy("v").agg(F.count_if(F.col("b") > 0).alias("y"), F.count("*").alias("n"))
    classes = by.groupBy("y", "n").agg(F.count("*").alias("times")).orderBy("y", "n").collect()
    mu, sd, u = estimate.fit_random_intercepts([(r.y, r.n) for r in classes], times=[r.times for r in classes])
    effects = spark.createDataFrame([(r.y, r.n, float(e)) for r, e in zip(classes, u)], "y long, n long, effect double")
    return by.join(effects, ["y", "n"]).select(F.col("v").cast("long").alias("v"), "effect", F.lit(mu).alias("mean"), F.lit(float(sd)).alias("sd"))


@query()
def e12_simulate(spark, sf_dir):
    rows = v.density(spark, sf_dir).where("c = 0").select((F.col("g") * 10 + F.col("t")).alias("i"), "r1", "r2")
    return estimate.simulate(rows, 4, 0.5)


@query()
def e13_forecast(spark, sf_dir):
    last = v.density(spark, sf_dir).where(f"c = 0 AND t = {v.N_T - 1}").select(F.col("g").alias("s"), "t", F.col("p1").alias("val"))
    return estimate.forecast(last, 0.6, 0.3, 3, 5)


@query("WITH o AS (SELECT CAST(year(l_shipdate) - 1995 AS INT) AS t, 1e0 + 1e1 * l_tax AS a, CAST(l_quantity AS DOUBLE) AS b, l_linenumber % 3 AS c FROM lineitem), m AS (SELECT max(t) AS t1, avg(a) AS a, avg(b) AS b FROM o) SELECT CAST(c AS INT) AS c, CAST(t1 + k AS INT) AS t, round(a, 6) AS a, round(CASE WHEN z = 0 THEN 0e0 ELSE b END, 6) AS b FROM (SELECT DISTINCT c FROM o), m, range(1, 4) AS r(k), range(2) AS q(z)")
def u3_padding_rows(spark, sf_dir):
    o = v.table(spark, sf_dir, "lineitem").select((F.year("l_shipdate") - 1995).cast("int").alias("t"), (1.0 + 10.0 * F.col("l_tax")).alias("a"), F.col("l_quantity").cast("double").alias("b"), (F.col("l_linenumber") % 3).cast("int").alias("c"))
    return estimate.padding_rows(o, 3).select("c", "t", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query()
def v1_kmeans_knots(spark, sf_dir):
    return estimate.kmeans_knots(v.grid(spark, sf_dir).where("area > 0"), 20)


@query()
def a3_coarse_grid(spark, sf_dir):
    cells = v.grid(spark, sf_dir).join(v.cell_area(spark, sf_dir).select("g", "l"), "g")
    return estimate.coarsen(cells, 25)


def _matrix(spark, sf_dir):
    m = np.zeros((10, 6))
    for r in v.loading(spark, sf_dir).collect():  # ten by six
        m[r.c, r.f] = r.val
    return m


@query()
def v2_pca_rotation(spark, sf_dir):
    rotated, _, values = estimate.pca_rotation(_matrix(spark, sf_dir))
    return spark.createDataFrame([(c, f, float(rotated[c, f]), float(values[f])) for c in range(10) for f in range(6)], "c int, f int, val double, eigen double")


@query()
def v2_rotated_scores(spark, sf_dir):
    _, rotation, _ = estimate.pca_rotation(_matrix(spark, sf_dir))
    return estimate.rotate_scores(v.scores(spark, sf_dir), rotation, ["s"])


@query()
def v2_varimax(spark, sf_dir):
    rotated, _ = estimate.varimax(_matrix(spark, sf_dir))
    return spark.createDataFrame([(c, f, float(rotated[c, f])) for c in range(10) for f in range(6)], "c int, f int, val double")


@query()
def v3_clusters(spark, sf_dir):
    wide = v.scores(spark, sf_dir).groupBy("s").pivot("f", list(range(6))).agg(F.first("val")).select("s", *(F.col(str(k)).alias(f"f{k}") for k in range(6)))
    return estimate.bisecting_clusters(wide, [f"f{k}" for k in range(6)], 4).select("s", F.col("class"))


@query()
def a30_crossvalidation(spark, sf_dir):
    return estimate.crossvalidate(v.obs(spark, sf_dir), 5, ["l_orderkey", "l_linenumber", "g"])


@query()
def e14_predict_new(spark, sf_dir):
    """New places take the density of their nearest cell; nothing is fitted again."""
    cells = v.density(spark, sf_dir).where("c = 0 AND t = 0").select("g", "d")
    near = spatial.nearest(v.knots(spark, sf_dir), v.grid(spark, sf_dir).where("area > 0").select("g", "e_km", "n_km"), "g")
    return near.join(cells, "g").select("x", "g", "d")


@query()
def e16_validate(spark, sf_dir):
    found = sampling.validate(v.obs(spark, sf_dir))
    return spark.createDataFrame([(m,) for m in found] or [("nothing",)], "message string")
