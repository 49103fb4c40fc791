"""Densities, indices, community and range operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamark.functions import links
from seamark.operators import community, indices, predict, ranges, sampling
from seamark.plans import views as v
from seamark.plans.registry import query, r6
from seamark.plans.views import with_


def flagship(spark, sf_dir):
    """Abundance index by category, time and stratum from the closed-form fit with yearly intercepts.

    Encounter rates and positive densities are summed over the samples, predicted on
    every cell with area and expanded by stratum; small tables are broadcast by Spark, the
    samples are read once and shuffled as partial sums only.
    """
    meta = sampling.encounter_metadata(v.obs(spark, sf_dir))
    beta = sampling.exact_intercepts(meta)
    got = beta.withColumn("d", links.inv_logit(F.col("beta1")) * F.exp("beta2"))
    area = v.cell_area(spark, sf_dir).groupBy("l").agg(F.sum("area").alias("area"))
    return got.join(F.broadcast(area)).select("c", "t", "l", F.round(F.col("d") * F.col("area"), 4).alias("index"))


@query(with_("meta", "cell_area") + ", b AS (SELECT c, t, CASE WHEN prop_nonzero > 0 AND prop_nonzero < 1 THEN ln(prop_nonzero / (1 - prop_nonzero)) END AS b1, CASE WHEN mean_posdens > 0 THEN ln(mean_posdens) END AS b2 FROM meta) SELECT c, t, l, round(1 / (1 + exp(-b1)) * exp(b2) * area, 4) AS index FROM b, (SELECT l, sum(area) AS area FROM cell_area GROUP BY l) a")
def a5_index_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(with_("dens") + "SELECT g, c, t, round(r1, 6) AS r1, round(r2, 6) AS r2, round(d, 6) AS d FROM dens")
def m3_delta_density(spark, sf_dir):
    return v.density(spark, sf_dir).select("g", "c", "t", r6("r1"), r6("r2"), r6("d"))


@query(with_("preds") + "SELECT g, c, t, round(1 - exp(-exp(p1)), 6) AS r1, round(exp(p1 + p2) / (1 - exp(-exp(p1))), 6) AS r2, round(exp(p1 + p2), 6) AS d FROM preds")
def m4_poisson_link(spark, sf_dir):
    return v.density(spark, sf_dir, link=1).select("g", "c", "t", r6("r1"), r6("r2"), r6("d"))


@query(with_("preds") + "SELECT g, t, round(1 - exp(-sum(exp(p1))), 6) AS r1, round(sum(exp(p1 + p2)) / (1 - exp(-sum(exp(p1)))), 6) AS r2 FROM preds GROUP BY g, t")
def m4_combined_categories(spark, sf_dir):
    rows = v.density(spark, sf_dir).select("g", "t", F.lit(1.0).alias("a"), "p1", "p2")
    return predict.combined_poisson_link(rows, ["g", "t"]).select("g", "t", r6("r1"), r6("r2"))


@query(with_("preds") + "SELECT g, c, t, round(exp(p1), 6) AS r1, round(exp(p2), 6) AS r2, round(exp(p1) * exp(p2), 6) AS d FROM preds")
def m5_tweedie_link(spark, sf_dir):
    return v.density(spark, sf_dir, link=2).select("g", "c", "t", r6("r1"), r6("r2"), r6("d"))


@query(with_("obs") + "SELECT c, t, v, count(*) AS n, round(sum(3e-1 + 1e-1 * c - 5e-2 * t + coalesce(CASE WHEN v % 3 <> 0 THEN (v % 11 - 5) / 1e1 END, 0)), 6) AS p1 FROM obs GROUP BY c, t, v")
def m1_obs_predictor(spark, sf_dir):
    o = v.obs(spark, sf_dir)
    ct = sampling.dense_axes(o).select("c", "t", (0.3 + 0.1 * F.col("c") - 0.05 * F.col("t")).alias("val"))
    vessel = v.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("v")).where("v % 3 <> 0").select("v", ((F.col("v") % 11 - 5) / 10.0).alias("val"))
    return predict.add_effects(o, [(ct, ["c", "t"]), (vessel, ["v"])], "p1").groupBy("c", "t", "v").agg(F.count("*").alias("n"), F.round(F.sum("p1"), 6).alias("p1"))


_QIK = "q AS (SELECT p_partkey AS i, CAST(k AS INT) AS k, (p_partkey * (k + 1)) % 13 / 1e1 AS q FROM part, range(3) AS r(k))"


@query(f"WITH {_QIK} SELECT i, round(sum(((k + 1) * 25e-2 + CASE WHEN k = 2 THEN (i % 5) / 1e1 ELSE 0e0 END) * q), 6) AS zeta FROM q GROUP BY i")
def m6_catchability(spark, sf_dir):
    i, k = F.col("i"), F.col("k")
    q = v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("q", (i * (k + 1)) % 13 / 10.0)
    lam = spark.range(3).select(F.col("id").cast("int").alias("k"), ((F.col("id") + 1) * 0.25).alias("lam"))
    phi = q.where("k = 2").select("i", "k", ((i % 5) / 10.0).alias("phi"))
    return predict.catchability(q, lam, phi).select("i", r6("zeta"))


@query(with_("grid") + ", x AS (SELECT g, CAST(t AS INT) AS t, CAST(p AS INT) AS p, ((g + t) * (p + 1)) % 17 / 1e1 AS x FROM grid, range(2) AS a(t), range(5) AS b(p)), k AS (SELECT CAST(c AS INT) AS c, CAST(p AS INT) AS p, (c + 1) * (p + 1) / 4e0 AS gamma, CAST(p - 1 AS INT) AS config FROM range(2) AS a(c), range(5) AS b(p)) SELECT g, c, t, round(sum((CASE WHEN config IN (1, 3) THEN gamma ELSE 0e0 END + CASE WHEN config IN (-1, 2, 3) THEN ((g * 3 + c + p) % 7 - 3) / 1e1 ELSE 0e0 END) * x), 6) AS eta FROM x JOIN k USING (p) GROUP BY g, c, t")
def m7_covariate_effect(spark, sf_dir):
    g, c, t, p = (F.col(x) for x in "gctp")
    seq = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    x = v.grid(spark, sf_dir).select("g", seq(2, "t")).select("*", seq(5, "p")).withColumn("x", ((g + t) * (p + 1)) % 17 / 10.0)
    k = spark.range(2).select(F.col("id").cast("int").alias("c"), seq(5, "p")).withColumn("gamma", (c + 1) * (p + 1) / 4.0).withColumn("config", p - 1)
    xi = v.grid(spark, sf_dir).select("g", seq(2, "c")).select("*", seq(5, "p")).withColumn("xi", ((g * 3 + c + p) % 7 - 3) / 10.0)
    return predict.covariate_effect(x, k, xi).select("g", "c", "t", r6("eta"))


@query(with_("loading", "scores") + "SELECT s, c, round(sum(scores.val * loading.val) * 5e-1, 6) AS val FROM scores JOIN loading USING (f) GROUP BY s, c")
def m10_field_to_category(spark, sf_dir):
    return predict.field_to_category(v.scores(spark, sf_dir), v.loading(spark, sf_dir), 0.5).select("s", "c", r6("val"))


@query("SELECT CAST(c AS INT) AS c, CAST(f AS INT) AS f, (c * (c + 1) // 2 + f) / 1e1 AS val FROM range(3) AS a(c), range(3) AS b(f) WHERE f <= c UNION ALL SELECT CAST(c AS INT), CAST(f AS INT), (6 + (c - 3) * 3 + f) / 1e1 FROM range(3, 5) AS a(c), range(3) AS b(f)")
def m9_loadings(spark, sf_dir):
    return spark.createDataFrame(predict.loadings([k / 10.0 for k in range(12)], 5, 3), "c int, f int, val double")


@query(with_("scores") + ", lt AS (SELECT CAST(t AS INT) AS t, CAST(h AS INT) AS h, (t + 1) * (h + 1) / 1e1 AS val FROM range(4) AS a(t), range(3) AS b(h)) SELECT s, CAST(f // 3 AS INT) AS f, t, round(sum(scores.val * lt.val), 6) AS val FROM scores JOIN lt ON scores.f % 3 = lt.h GROUP BY 1, 2, 3")
def m11_time_factors(spark, sf_dir):
    field = v.scores(spark, sf_dir).select("s", F.floor(F.col("f") / 3).cast("int").alias("f"), (F.col("f") % 3).alias("h"), "val")
    lt = spark.range(4).select(F.col("id").cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("h")).withColumn("val", (F.col("t") + 1) * (F.col("h") + 1) / 10.0)
    return predict.time_factors(field, lt).select("s", "f", "t", r6("val"))


@query(with_("idx") + "SELECT c, t, l, round(index, 4) AS index FROM idx")
def a5_index_area(spark, sf_dir):
    return indices.index(v.cells(spark, sf_dir)).select("c", "t", "l", F.round("index", 4).alias("index"))


_WIDE = "p AS (SELECT g, t, l, max(area) AS area, sum(CASE WHEN c = 0 THEN d END) AS d0, sum(CASE WHEN c = 1 THEN d END) AS d1, sum(CASE WHEN c = 2 THEN d END) AS d2 FROM cells GROUP BY g, t, l)"
_LONG = "SELECT CAST(0 AS INT) AS c, t, l, round(sum(i0), 4) AS index FROM e GROUP BY t, l UNION ALL SELECT 1, t, l, round(sum(i1), 4) FROM e GROUP BY t, l UNION ALL SELECT 2, t, l, round(sum(i2), 4) FROM e GROUP BY t, l"


def _mode(spark, sf_dir, expansion):
    return indices.expanded_index(v.cells(spark, sf_dir), expansion).select("c", "t", "l", F.round("index", 4).alias("index"))


@query(with_("cells") + f", {_WIDE}, e AS (SELECT *, d0 * area AS i0, d1 * (d0 * area) AS i1, d2 * (d1 * (d0 * area)) AS i2 FROM p) {_LONG}")
def a5_index_mode1(spark, sf_dir):
    return _mode(spark, sf_dir, [(0, -1), (1, 0), (1, 1)])


@query(with_("cells") + f", {_WIDE}, s AS (SELECT t, l, sum(d0 * area) AS total FROM p GROUP BY t, l), e AS (SELECT p.*, d0 * area AS i0, d1 * (d0 * area) / total AS i1, d2 * (d0 * area) / total AS i2 FROM p JOIN s ON p.t = s.t AND p.l = s.l) {_LONG}")
def a5_index_mode2(spark, sf_dir):
    return _mode(spark, sf_dir, [(0, -1), (2, 0), (2, 0)])


@query(with_("cells") + f", {_WIDE}, e AS (SELECT *, d0 * area AS i0, d1 * area + d0 * area AS i1, d2 * area + (d1 * area + d0 * area) AS i2 FROM p) {_LONG}")
def a5_index_mode3(spark, sf_dir):
    return _mode(spark, sf_dir, [(0, -1), (3, 0), (3, 1)])


@query(with_("cells") + f", {_WIDE}, e AS (SELECT *, d0 * area AS i0, d1 / (d1 + d2) * (d0 * area) AS i1, d2 / (d1 + d2) * (d0 * area) AS i2 FROM p) {_LONG}")
def a5_index_mode4(spark, sf_dir):
    return _mode(spark, sf_dir, [(0, -1), (4, 0), (4, 0)])


@query(with_("cells") + "SELECT c, t, CAST(0 AS INT) AS m, round(sum(e_km * index_g) / sum(index_g), 6) AS z FROM cells WHERE l = 'middle' GROUP BY c, t UNION ALL SELECT c, t, 1, round(sum(n_km * index_g) / sum(index_g), 6) FROM cells WHERE l = 'middle' GROUP BY c, t")
def a6_center_of_gravity(spark, sf_dir):
    return indices.centre_of_gravity(v.cells(spark, sf_dir), stratum="middle").select("c", "t", "m", r6("z"))


@query(with_("cells") + "SELECT c, t, l, round(sum(d * index_g) / sum(index_g), 6) AS mean_d, round(sum(index_g) * sum(index_g) / sum(d * index_g), 4) AS effective_area FROM cells GROUP BY c, t, l")
def a7_effective_area(spark, sf_dir):
    return indices.effective_area(v.cells(spark, sf_dir)).select("c", "t", "l", r6("mean_d"), F.round("effective_area", 4).alias("effective_area"))


@query(with_("idx") + "SELECT c, t, l, round(index / first_value(index) OVER (PARTITION BY c, l ORDER BY t), 6) AS ratio FROM idx")
def a8_biomass_ratio(spark, sf_dir):
    return indices.biomass_ratio(indices.index(v.cells(spark, sf_dir))).select("c", "t", "l", r6("ratio"))


@query(with_("idx") + "SELECT c, t, l, round(index / sum(index) OVER (PARTITION BY t, l), 6) AS share FROM idx")
def a9_category_share(spark, sf_dir):
    return indices.category_share(indices.index(v.cells(spark, sf_dir))).select("c", "t", "l", r6("share"))


@query(with_("idx") + ", s AS (SELECT *, index * (c + 1) / 1e1 AS se FROM idx), w AS (SELECT *, sum(index) OVER (PARTITION BY t, l) AS i, sum(se * se) OVER (PARTITION BY t, l) AS vv FROM s), p AS (SELECT c, t, l, index / i AS prop, CASE WHEN index = 0 THEN 0e0 ELSE index / i * (index / i) * (se * se / (index * index) - 2 * (se * se) / (index * i) + vv / (i * i)) END AS var_prop FROM w), n AS (SELECT *, CASE WHEN var_prop <> 0 THEN prop * (1 - prop) / var_prop END AS neff FROM p) SELECT c, t, l, round(prop, 6) AS prop, round(var_prop, 6) AS var_prop, round(neff, 4) AS neff, round(median(neff) OVER (PARTITION BY t, l), 4) AS neff_median FROM n")
def a10_composition_neff(spark, sf_dir):
    idx = indices.index(v.cells(spark, sf_dir)).withColumn("se", F.col("index") * (F.col("c") + 1) / 10.0)
    return indices.composition(idx).select("c", "t", "l", r6("prop"), r6("var_prop"), F.round("neff", 4).alias("neff"), F.round("neff_median", 4).alias("neff_median"))


@query(with_("idx") + "SELECT t, l, round(sum(c * index) / sum(index), 6) AS mean_c, round(sqrt(greatest(sum(c * c * index) / sum(index) - (sum(c * index) / sum(index)) * (sum(c * index) / sum(index)), 0)), 6) AS sd_c FROM idx GROUP BY t, l")
def a10_mean_category(spark, sf_dir):
    return indices.mean_category(indices.index(v.cells(spark, sf_dir))).select("t", "l", r6("mean_c"), r6("sd_c"))


_Z = "zz AS (SELECT * FROM (VALUES (0, 0, 3), (1, 2, 6)) AS v(z, t0, t1)), r AS (SELECT z, g, c, t, d, area FROM cells JOIN zz ON t BETWEEN t0 AND t1), gc AS (SELECT z, g, c, var_samp(d) AS var_d, max(area) AS area FROM r GROUP BY z, g, c), bct AS (SELECT z, c, t, sum(d * area) AS b FROM r GROUP BY z, c, t), sdc AS (SELECT z, c, sum(area * sqrt(var_d)) AS sd FROM gc GROUP BY z, c), cz AS (SELECT b.z, b.c, var_samp(b) AS var_b, avg(b) AS mean_b, var_samp(b) / (max(sd) * max(sd)) AS phi FROM bct b JOIN sdc ON b.z = sdc.z AND b.c = sdc.c GROUP BY b.z, b.c)"


def _synchrony(spark, sf_dir, which):
    return community.synchrony(v.cells(spark, sf_dir), [(0, 3), (2, 6)])[which]


@query(with_("cells") + f", {_Z}, tg AS (SELECT z, g, var_samp(d) AS var_sum FROM (SELECT z, g, t, sum(d) AS d FROM r GROUP BY z, g, t) GROUP BY z, g) SELECT CAST(tg.g AS BIGINT) AS g, CAST(tg.z AS INT) AS z, round(max(var_sum), 6) AS var_sum, round(max(var_sum) / (sum(sqrt(var_d)) * sum(sqrt(var_d))), 6) AS phi FROM tg JOIN gc ON tg.z = gc.z AND tg.g = gc.g GROUP BY tg.g, tg.z")
def a11_synchrony_gz(spark, sf_dir):
    return _synchrony(spark, sf_dir, "gz").select("g", "z", r6("var_sum"), r6("phi"))


@query(with_("cells") + f", {_Z} SELECT c, CAST(z AS INT) AS z, round(var_b, 3) AS var_b, round(mean_b, 4) AS mean_b, round(phi, 6) AS phi FROM cz")
def a11_synchrony_cz(spark, sf_dir):
    return _synchrony(spark, sf_dir, "cz").select("c", "z", F.round("var_b", 3).alias("var_b"), F.round("mean_b", 4).alias("mean_b"), r6("phi"))


@query(with_("cells") + f", {_Z}, tz AS (SELECT z, var_samp(b) AS var_b FROM (SELECT z, t, sum(b) AS b FROM bct GROUP BY z, t) GROUP BY z) SELECT CAST(tz.z AS INT) AS z, round(var_b, 3) AS var_b, round(var_b / (s.sd * s.sd), 6) AS phi, round(phi_c_bar, 6) AS phi_c_bar FROM tz JOIN (SELECT z, sum(sd) AS sd FROM sdc GROUP BY z) s ON tz.z = s.z JOIN (SELECT z, sum(mean_b * phi) / sum(mean_b) AS phi_c_bar FROM cz GROUP BY z) w ON tz.z = w.z")
def a11_synchrony_z(spark, sf_dir):
    return _synchrony(spark, sf_dir, "z").select("z", F.round("var_b", 3).alias("var_b"), r6("phi"), r6("phi_c_bar"))


@query()
def a12_coherence(spark, sf_dir):
    """The loadings are a few rows by a few columns."""
    import numpy as np

    rows = v.loading(spark, sf_dir).collect()
    m = np.zeros((10, 6))
    for r in rows:
        m[r.c, r.f] = r.val
    psi, total = community.coherence([m], 10)
    return spark.createDataFrame([(psi, total)], "psi double, total double")


_COV = "cv AS (SELECT a.c AS c1, b.c AS c2, sum(a.val * b.val) AS cov FROM loading a JOIN loading b ON a.f = b.f GROUP BY a.c, b.c), vv AS (SELECT c, sum(val * val) AS v FROM loading GROUP BY c)"


@query(with_("loading") + f", {_COV} SELECT c1, c2, round(CASE WHEN c1 < c2 THEN cov / sqrt(x.v * y.v) ELSE cov END, 6) AS val FROM cv JOIN vv x ON x.c = c1 JOIN vv y ON y.c = c2")
def a13_cov_upper_cor(spark, sf_dir):
    return community.loading_covariance(v.loading(spark, sf_dir)).select("c1", "c2", r6("val"))


_PAIR = "o AS (SELECT a.g, a.d AS d1, b.d AS d2, a.area FROM dens a JOIN dens b ON a.g = b.g WHERE a.c = 0 AND a.t = 1 AND b.c = 1 AND b.t = 4)"


@query(with_("dens") + f", {_PAIR} SELECT round(sum(d1 * (d2 * area)) / sum(d2 * area), 6) AS overlap FROM o")
def a14_overlap_weighted(spark, sf_dir):
    return community.overlap(v.density(spark, sf_dir), (0, 1), (1, 4), 0).select(r6("overlap"))


@query(with_("dens") + f", {_PAIR} SELECT round(1 - 5e-1 * sum(abs(d1 * area / (SELECT sum(d1 * area) FROM o) - d2 * area / (SELECT sum(d2 * area) FROM o))), 6) AS overlap FROM o")
def a14_schoener_d(spark, sf_dir):
    return community.overlap(v.density(spark, sf_dir), (0, 1), (1, 4), 1).select(r6("overlap"))


@query(with_("dens") + f", {_PAIR} SELECT round(sum(area / (1 + exp(-(ln(d1) - 1e0) * 2e0))), 4) AS overlap FROM o")
def a14_threshold_area(spark, sf_dir):
    return community.overlap(v.density(spark, sf_dir), (0, 1), (1, 4), 2, threshold=1.0, slope=2.0).select(F.round("overlap", 4).alias("overlap"))


_EDGE = "s AS (SELECT c, t, g, n_km AS z, d, sum(d) OVER (PARTITION BY c, t ORDER BY n_km, g ROWS UNBOUNDED PRECEDING) / sum(d) OVER (PARTITION BY c, t) AS share, row_number() OVER (PARTITION BY c, t ORDER BY n_km, g) AS rn FROM dens)"


def _axis(spark, sf_dir):
    return v.density(spark, sf_dir).select("c", "t", "g", F.col("n_km").alias("z"), "d")


@query(with_("dens") + f", {_EDGE} SELECT c, t, g, round(share, 6) AS share FROM s")
def w1_cum_share(spark, sf_dir):
    return ranges.cumulative_share(_axis(spark, sf_dir)).select("c", "t", "g", r6("share"))


@query(with_("dens") + f", {_EDGE} SELECT c, t, q, round(arg_min(z, struct_pack(a := (share - q) * (share - q), b := rn)), 6) AS edge FROM s, (VALUES (5e-2), (5e-1), (95e-2)) AS v(q) GROUP BY c, t, q")
def w2_range_edge(spark, sf_dir):
    return ranges.range_edge(_axis(spark, sf_dir), [0.05, 0.5, 0.95]).select("c", "t", "q", r6("edge"))


@query(with_("dens") + f", {_EDGE}, k AS (SELECT c, t, z, share, lag(share) OVER (PARTITION BY c, t ORDER BY rn) AS s0, lag(z) OVER (PARTITION BY c, t ORDER BY rn) AS z0, rn FROM s), f AS (SELECT c, t, arg_min(struct_pack(z := z, share := share, s0 := s0, z0 := z0), rn) AS b FROM k WHERE share > 25e-2 GROUP BY c, t) SELECT c, t, round(CASE WHEN b.s0 IS NULL THEN b.z ELSE b.z0 + (25e-2 - b.s0) / (b.share - b.s0) * (b.z - b.z0) END, 6) AS z FROM f")
def w3_interp_quantile(spark, sf_dir):
    return ranges.interpolated_quantile(_axis(spark, sf_dir), 0.25).select("c", "t", r6("z"))


@query(with_("dens") + "SELECT g AS s, c AS f, t, round(coalesce(7e-1 * lag(p1) OVER (PARTITION BY g, c ORDER BY t), 0), 6) AS mean FROM dens")
def w4_ar1_mean(spark, sf_dir):
    return ranges.autoregressive_mean(v.density(spark, sf_dir).select(F.col("g").alias("s"), F.col("c").alias("f"), "t", F.col("p1").alias("val")), 0.7).select("s", "f", "t", r6("mean"))


@query("WITH RECURSIVE f AS (SELECT l_linenumber AS c, CAST(year(l_shipdate) - 1995 AS INT) AS t, count(*) / 1e4 AS f FROM lineitem GROUP BY 1, 2), w AS (SELECT c, t, -f AS impact FROM f WHERE t = 0 UNION ALL SELECT f.c, f.t, 8e-1 * w.impact - f.f FROM w JOIN f ON f.c = w.c AND f.t = w.t + 1) SELECT CAST(c AS INT) AS c, t, round(impact, 6) AS impact FROM w")
def w5_fishing_impact(spark, sf_dir):
    catch = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("c"), (F.year("l_shipdate") - 1995).cast("int").alias("t")).agg((F.count("*") / 10000.0).alias("f"))
    return ranges.fishing_impact(catch, 0.8).select("c", "t", r6("impact"))


@query(with_("meta") + "SELECT c, t, round(mean_posdens - avg(mean_posdens) OVER (PARTITION BY c), 6) AS centred FROM meta")
def w6_centered(spark, sf_dir):
    return ranges.centred(sampling.encounter_metadata(v.obs(spark, sf_dir)), ("c",), "mean_posdens").select("c", "t", r6("centred"))


@query(with_("idx") + "SELECT c, t, l, round(sum(index) OVER (PARTITION BY t, l ORDER BY c ROWS UNBOUNDED PRECEDING), 4) AS running FROM idx")
def w7_running_category(spark, sf_dir):
    return ranges.running_categories(indices.index(v.cells(spark, sf_dir))).select("c", "t", "l", F.round("running", 4).alias("running"))


@query("WITH r AS (SELECT CAST(year(o_orderdate) AS INT) AS t, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1) SELECT CAST(t + age AS INT) AS t, CAST(age AS INT) AS age, round(n * exp(-2e-1 * age), 6) AS n FROM r, range(6) AS a(age)")
def w13_cohort(spark, sf_dir):
    r = v.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("t")).agg(F.count("*").cast("double").alias("n"))
    return ranges.cohorts(r, 0.2, 5).select("t", "age", r6("n"))


@query(with_("idx") + "SELECT CASE c WHEN 0 THEN 'cod' WHEN 1 THEN 'hake' ELSE 'sole' END AS Category, t AS Time, l AS Stratum, 'kg' AS Units, round(index, 4) AS Estimate, round(index * 1e-1, 4) AS SE, round(1e-1, 6) AS SE_ln FROM idx")
def k1_index_table(spark, sf_dir):
    idx = indices.index(v.cells(spark, sf_dir)).withColumn("se", F.col("index") * 0.1)
    return indices.index_table(idx, ["cod", "hake", "sole"]).select("Category", "Time", "Stratum", "Units", F.round("Estimate", 4).alias("Estimate"), F.round("SE", 4).alias("SE"), F.round("SE_ln", 6).alias("SE_ln"))


@query(with_("reps") + ", e AS (SELECT t AS idx, r, sum(val) / 1e3 AS val FROM reps GROUP BY t, r) SELECT a.idx AS idx1, b.idx AS idx2, round(covar_samp(a.val, b.val), 6) AS cov FROM e a JOIN e b ON a.r = b.r AND a.idx >= b.idx GROUP BY 1, 2")
def k2_index_pairs(spark, sf_dir):
    e = v.replicates(spark, sf_dir).groupBy(F.col("t").alias("idx"), "r").agg((F.sum("val") / 1000.0).alias("val"))
    return indices.index_pairs(e).select("idx1", "idx2", r6("cov"))
