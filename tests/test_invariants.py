"""Properties that hold whatever the data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.functions import geo, links
from seamark.operators import community, covariates, diagnostics, estimate, indices, predict, ranges, sampling, spatial
from seamark.plans import views as v


def test_knot_areas_add_up(spark, sf_dir):
    g = v.grid(spark, sf_dir)
    areas = spatial.knot_areas(g, v.knots(spark, sf_dir), [])
    assert areas.agg(F.sum("area")).first()[0] == pytest.approx(g.agg(F.sum("area")).first()[0])


def test_nearest_forms_agree_far_outside(spark, sf_dir):
    q = spark.createDataFrame([(1, 9000.0, -4000.0), (2, 0.0, 0.0), (3, 151.0, 49.0)], "g int, e_km double, n_km double")
    a = {r.g: r.x for r in spatial.nearest(q, v.knots(spark, sf_dir), "x").collect()}
    b = {r.g: r.x for r in spatial.nearest_bucketed(q, v.knots(spark, sf_dir), "x").collect()}
    assert a == b


def test_nearest_without_sites(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0)], "g int, e_km double, n_km double")
    none = spark.createDataFrame([], "x bigint, e_km double, n_km double")
    assert spatial.nearest(q, none, "x").first().x is None
    assert spatial.nearest_bucketed(q, none, "x").first().x is None


def test_shares_and_overlap(spark, sf_dir):
    idx = indices.index(v.cells(spark, sf_dir))
    sums = indices.category_share(idx).groupBy("t", "l").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in sums)
    d = community.overlap(v.density(spark, sf_dir), (0, 1), (0, 1), 1).first()[0]
    assert d == pytest.approx(1.0)
    assert 0 <= community.overlap(v.density(spark, sf_dir), (0, 1), (2, 5), 1).first()[0] <= 1


def test_expansion_chain_is_the_sum_of_parts(spark, sf_dir):
    got = {(r.c, r.t, r.l): r["index"] for r in indices.expanded_index(v.cells(spark, sf_dir), [(0, -1), (3, 0), (3, 1)]).collect()}
    parts = {(r.c, r.t, r.l): r["index"] for r in indices.index(v.cells(spark, sf_dir)).collect()}
    for (c, t, l), x in got.items():
        assert x == pytest.approx(sum(parts[k, t, l] for k in range(c + 1)))


def test_expansion_must_look_back(spark, sf_dir):
    with pytest.raises(ValueError):
        indices.expanded_index(v.cells(spark, sf_dir), [(1, 1), (0, -1)])


def test_coherence_bounds():
    assert community.coherence([np.eye(4)], 4)[0] == pytest.approx(0.25, abs=1e-6)
    one = np.zeros((4, 1))
    one[:, 0] = 1
    assert community.coherence([one], 4)[0] == pytest.approx(1.0, abs=1e-6)


@pytest.mark.parametrize("x", [0.3, 1.0, 2.5, 10.0, 170.5])
def test_lgamma_and_quantile(spark, x):
    got = spark.range(1).select(links.lgamma(F.lit(x)), links.normal_quantile(F.lit(1 / (1 + x)))).first()
    assert got[0] == pytest.approx(math.lgamma(x), rel=1e-11, abs=1e-11)
    from statistics import NormalDist

    assert got[1] == pytest.approx(NormalDist().inv_cdf(1 / (1 + x)), rel=1e-7, abs=1e-8)


def test_densities_integrate_to_one(spark):
    x = spark.range(1, 40_001).select((F.col("id") / 1000.0).alias("x"))
    m, s = F.lit(2.0), F.lit(0.5)
    sums = x.agg(*(F.sum(F.exp(f(F.col("x"), m, s)) / 1000.0).alias(f.__name__) for f in (links.lognormal_density, links.lognormal_cv_density, links.gamma_density, links.inverse_gaussian_density)), F.sum(F.exp(links.generalised_gamma_density(F.col("x"), m, s, F.lit(0.8))) / 1000.0)).first()
    assert all(abs(t - 1) < 2e-3 for t in sums)
    counts = spark.range(0, 400).select(F.col("id").cast("double").alias("x"))
    got = counts.agg(F.sum(F.exp(links.poisson_density(F.col("x"), F.lit(3.0)))), F.sum(F.exp(links.negative_binomial_density(F.col("x"), F.lit(3.0), F.lit(6.0))))).first()
    assert all(t == pytest.approx(1.0) for t in got)


def test_links_agree_with_small_rates(spark):
    row = spark.range(1).select(*links.poisson_link(F.lit(-30.0), F.lit(1.0), F.lit(2.0))).first()
    assert row[0] == pytest.approx(2 * math.exp(-30), rel=1e-12)
    assert row[0] * row[1] == pytest.approx(2 * math.exp(-29), rel=1e-9)


def test_utm_known_point(spark):
    """Zone and a round trip on both sides of the equator and across the date line."""
    assert geo.utm_zone(-123.0) == 10 and geo.utm_zone(179.9) == 60 and geo.utm_zone(-180.0) == 1
    df = spark.createDataFrame([(-121.5, 47.25), (-124.9, -33.0)], "lon double, lat double")
    e, n = geo.utm_forward(F.col("lon"), F.col("lat"), 10)
    lon, lat = geo.utm_inverse(F.col("e"), F.col("n"), 10)
    for r in df.select("lon", "lat", e.alias("e"), n.alias("n")).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r.a == pytest.approx(r.lon, abs=1e-8) and r.b == pytest.approx(r.lat, abs=1e-8)


def test_strata_bounds_are_half_open(spark):
    df = spark.createDataFrame([(150.0,), (150.0001,), (-1.0,)], "n_km double")
    assert [r[0] for r in df.select(spatial.match_strata(v.STRATA)).collect()] == ["south", "middle", None]


def test_metadata_counts_nulls_once(spark):
    obs = spark.createDataFrame([(0, 0, 1.0, None), (0, 0, 1.0, 2.0), (0, 2, 2.0, 0.0)], "c int, t int, a double, b double")
    got = {(r.c, r.t): r for r in sampling.encounter_metadata(obs).collect()}
    assert len(got) == 3 and got[0, 1].num_total == 0 and got[0, 1].prop_nonzero is None
    assert got[0, 0].num_total == 2 and got[0, 0].num_notna == 1 and got[0, 0].mean_posdens == 2.0
    assert sampling.null_all_zero(obs).where("b IS NULL").count() == 2


def test_several_categories_in_one_row(spark):
    obs = spark.createDataFrame([([0, 1], 1.0), ([1, None], 2.0)], "c_iz array<int>, b double")
    assert sorted(r.c for r in sampling.explode_categories(obs).collect()) == [0, 1, 1]


def test_fit_matches_closed_form(spark, sf_dir):
    from seamark.plans.diagnostic import fitted

    rows = fitted(spark, sf_dir).where("c = 0 AND t = 1")
    a, _, _ = estimate.fit_binomial(rows.withColumn("y", (F.col("b") > 0).cast("double")), [])
    p = rows.agg(F.avg((F.col("b") > 0).cast("double"))).first()[0]
    assert 1 / (1 + math.exp(-a)) == pytest.approx(p, rel=1e-6)


def test_random_intercepts_shrink():
    rng = np.random.default_rng(3)
    u = rng.normal(0, 1.0, 60)
    counts = [(int(rng.binomial(80, 1 / (1 + math.exp(-(0.4 + x))))), 80) for x in u]
    mu, sd, got = estimate.fit_random_intercepts(counts)
    assert 0.1 < mu < 0.8 and 0.7 < sd < 1.4
    assert np.corrcoef(u, got)[0, 1] > 0.9


def test_random_intercepts_of_all_vessels(spark, monkeypatch):
    from seamark.plans import fitted

    rows = spark.range(200_800).select((F.col("id") % 100_400).alias("v"), (F.xxhash64("id") % 3).cast("double").alias("b"))
    monkeypatch.setattr(fitted, "fitted", lambda spark, sf_dir: rows)
    got = fitted.e7_random_intercepts(spark, "")
    assert got.count() == got.select("v").distinct().count() == 100_400
    counts = [(1, 4), (3, 4), (2, 5)]
    times = [3, 2, 4]
    mu, sd, u = estimate.fit_random_intercepts(counts, times=times)
    mu2, sd2, u2 = estimate.fit_random_intercepts([c for c, k in zip(counts, times) for _ in range(k)])
    assert (mu, sd) == pytest.approx((mu2, sd2)) and np.repeat(u, times) == pytest.approx(u2)


def test_rotation_keeps_covariance():
    x = np.random.default_rng(1).normal(size=(6, 3))
    for rotated in (estimate.pca_rotation(x)[0], estimate.varimax(x)[0]):
        assert np.allclose(rotated @ rotated.T, x @ x.T)
    assert (estimate.pca_rotation(x)[0].sum(axis=0) >= -1e-12).all()


def test_ward_finds_blobs():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    got = estimate.ward_clusters(x, 3)
    assert [len(set(got[k : k + 20])) for k in (0, 20, 40)] == [1, 1, 1] and len(set(got)) == 3


def test_simulation_repeats_and_has_the_mean(spark):
    rows = spark.range(2000).select(F.col("id").alias("i"), F.lit(0.6).alias("r1"), F.lit(5.0).alias("r2"))
    a, b = estimate.simulate(rows, 10, 0.4), estimate.simulate(rows.repartition(3), 10, 0.4)
    assert a.exceptAll(b).count() == 0
    assert a.agg(F.avg("sim")).first()[0] == pytest.approx(3.0, rel=0.03)


def test_forecast_falls_back(spark):
    last = spark.createDataFrame([(1, 6, 10.0)], "s int, t int, val double")
    got = estimate.forecast(last, 0.5, 0.0, 3, 1).orderBy("t").collect()
    assert [r.t for r in got] == [7, 8, 9] and [r.val for r in got] == pytest.approx([5.0, 2.5, 1.25])


def test_settings():
    s = estimate.make_settings(100, "index2", options={"Calculate_Range": True}).with_overrides(options={"CALCULATE_RANGE": False})
    assert s.options == {"calculate_range": False} and s.max_cells == 2000
    with pytest.raises(ValueError):
        estimate.make_settings(10, "none such")
    assert [estimate.field_rank(x, 3) for x in ("AR1", "IID", "Identity", 0, "full", 2)] == [0, -2, -3, -1, 3, 2]


def test_kmeans_returns_few_points(spark):
    sites = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (3.0, 4.0)], "e_km double, n_km double")
    assert estimate.kmeans_knots(sites, 5).count() == 2


def test_gmrf_and_lattice():
    m0, m1, m2 = np.eye(3), np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0.0]]), np.zeros((3, 3))
    q = estimate.precision_lattice(m0, m1, m2, 0.3)
    assert np.allclose(q, q.T) and estimate.field_variance(q).shape == (3,)
    x = np.zeros(3)
    assert estimate.gmrf_nll(x, np.eye(3)) == pytest.approx(1.5 * math.log(2 * math.pi))


def test_range_edge_takes_the_first_on_ties(spark):
    rows = spark.createDataFrame([(0, 0, g, float(g), 1.0) for g in range(4)], "c int, t int, g int, z double, d double")
    assert ranges.range_edge(rows, [0.375]).first().edge == 0.0


def test_replaced_covariates(spark):
    old = spark.createDataFrame([(1.0, 1.0, 2000, 5.0), (2.0, 2.0, 2000, 6.0)], "lat double, lon double, year int, val double")
    new = spark.createDataFrame([(1.0, 1.0, 2000, 9.0)], "lat double, lon double, year int, val double")
    assert sorted(r.val for r in covariates.replace_rows(old, new).collect()) == [6.0, 9.0]


def test_pit_draw_lies_between(spark):
    b = spark.createDataFrame([(i, 0.2, 0.4) for i in range(50)], "i int, lo double, hi double")
    assert b.count() == diagnostics.pit_residual(b).where("u BETWEEN 0.2 AND 0.4").count()


def test_loadings_are_packed_by_rows():
    assert predict.loadings([1.0, 2.0, 3.0, 4.0, 5.0], 3, 2) == [(0, 0, 1.0), (1, 0, 2.0), (1, 1, 3.0), (2, 0, 4.0), (2, 1, 5.0)]


def test_grid_reader(spark):
    from seamark.sources.grids import load_grid, load_regions

    t = spark.createDataFrame([(56.0, -160.0, 4.0), (58.0, -161.0, 0.0), (60.0, -162.0, 4.0)], "Lat double, Lon double, Area_km2 double")
    grid, area = load_grid(t, "Eastern_Bering_Sea", [("all", (-90.0, 90.0)), ("north", (58.0, 90.0))])
    assert grid.count() == 3 and sorted(r.l for r in area.collect()) == ["all", "all", "north"]
    with pytest.raises(ValueError):
        load_grid(t.drop("Lat"), "user", [])
    _, both = load_regions({"a": t, "b": t}, [("all", (-90.0, 90.0))], total=True)
    assert both.where("l = 'Total'").count() == 4


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from seamark.streaming.metadata import start, windowed_counts

    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    start(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = src.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), F.col("event_type").alias("c")).count().withColumnRenamed("count", "num_total")
    assert got.select("window", "c", "num_total").exceptAll(want.select("window", "c", "num_total")).count() == 0


def test_settings_rules():
    from seamark.operators import config

    assert len(config.options()) == 22 and config.options({"calculate_RANGE": True, "nothing": 1})["Calculate_Range"] is True
    assert config.broken_settings(config.Model(n_c=2, n_t=3)) == []
    broken = config.broken_settings(config.Model(obs_model=((10, 1), (3, 9)), rho=(9, 0, 3, 0), n_c=1, n_t=3, field=((1, 1), (0, 1), ("IID", 1)), columns_of_c=2, method="Sphere", options={"calculate_coherence": True}))
    assert {"unknown distribution", "unknown link", "more than one link", "Tweedie needs its link", "unknown temporal structure", "several categories need the Poisson link", "unknown method", "structure of a field that is off (1)", "ranks of fixed intercepts (2)"} <= set(broken)
    for bad in ([1, 2, 3], [["x", 1]] * 4, [[5, 1]] * 4):
        with pytest.raises((ValueError, KeyError)):
            config.field_config(bad, 4, 6)
    with pytest.raises(ValueError):
        config.rho_terms((6, 0, 0, 0))


def test_zero_sum_and_trace_penalties():
    from seamark.operators import effects

    table, penalty = effects.loading_table([1.0, -1.0, 2.0, 0.5, -2.0], 3, 2, zero_sum=True)
    assert penalty == pytest.approx(0.25) and len(table) == 5
    table, penalty = effects.loading_table([1.0, 2.0, 2.0], 3, 1, unit_trace=True)
    assert sum(v * v for _, _, v in table) == pytest.approx(1.0) and penalty == pytest.approx(math.log(9.0) ** 2)


def test_tweedie_array_sums_to_one():
    from seamark.functions import links

    y = np.linspace(1e-4, 60, 200_001)
    mean, phi = np.full(len(y), 3.0), np.full(len(y), 1.3)
    density = np.exp(links.tweedie_array(y, mean, phi, 1.6))
    zero = math.exp(links.tweedie_array(np.zeros(1), mean[:1], phi[:1], 1.6)[0])
    assert zero + np.trapezoid(density, y) == pytest.approx(1.0, abs=2e-3)
    assert np.trapezoid(density * y, y) == pytest.approx(3.0, rel=1e-3)
    big = links.tweedie_array(np.array([1e4]), np.array([1e4]), np.array([0.01]), 1.5)
    assert np.isfinite(big).all()
    x = np.array([0.2, 0.5, 1.0, 7.3, 150.0])
    assert np.allclose(links.lgamma_array(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_zone_by_the_smaller_range_and_hemisphere(spark):
    pacific = spark.createDataFrame([(179.0, 50.0), (-179.0, 52.0)], "lon double, lat double")
    south = spark.createDataFrame([(18.0, -34.0), (20.0, -35.0)], "lon double, lat double")
    assert geo.find_zone(pacific, "lon", "lat") == (geo.utm_zone(180.0), False)
    assert geo.find_zone(south, "lon", "lat") == (34, True)


def test_covariates_of_a_missing_year(spark):
    from seamark.operators.covariates import nearest_in_year

    query = spark.createDataFrame([(1, 2000, 1.0, 2.0), (2, 2001, 1.0, 2.0)], "q int, year int, lat double, lon double")
    cov = spark.createDataFrame([(9, 2000, 1.0, 2.0, 5.0)], "id int, year int, lat double, lon double, val double")
    with pytest.raises(ValueError, match="2001"):
        nearest_in_year(query, cov, ["val"])


def test_map_numbers_that_are_gone(spark):
    from seamark.operators import reports

    with pytest.raises(ValueError):
        reports.map_table(spark.createDataFrame([(1, 0, 0, 0.5, 1.0, 0.5)], "g int, c int, t int, r1 double, r2 double, d double"), [4])


def test_observations_by_a_covariates_sentinel(spark, tmp_path):
    from seamark.sources.grids import read_observations

    spark.createDataFrame([(1.0, 5.0), (2.0, -9999.0)], "catch double, temp double").write.parquet(str(tmp_path / "t"))
    got = read_observations(spark, str(tmp_path / "t"), {"Catch_KG": "catch", "Year": "2000"}, sentinel=-999.0, covariate="temp").collect()
    assert [r.Catch_KG for r in got] == [1.0]


def test_ordered_by_ranges_equals_windows(spark):
    """One key with most rows, ties, nulls and few distinct values, against plain windows."""
    from pyspark.sql import Window

    from seamark.operators import ordered

    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 < 9, 2).alias("k"), F.col("id").alias("g"), (F.col("id") * 37 % 50).alias("v"), (F.col("id") % 7).cast("double").alias("w")).repartition(4)
    w = Window.partitionBy("k")
    run = w.orderBy("v", "g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = {r.g: r for r in rows.select("g", F.row_number().over(w.orderBy("v", "g")).alias("rn"), F.sum("w").over(run).alias("run"), F.sum("w").over(w).alias("total"), F.rank().over(w.orderBy("v")).alias("rank"), F.cume_dist().over(w.orderBy("v")).alias("cd")).collect()}
    for r in ordered.running(rows, ("k",), ("v", "g"), "w").collect():
        assert (r.rn, r.run, r.total) == (want[r.g].rn, want[r.g].run, want[r.g].total)
    for r in ordered.ranks(rows, ("k",), "v").collect():
        assert r["rank"] == want[r.g]["rank"] and r.upto / r.n == pytest.approx(want[r.g].cd)
    assert ordered.running(rows, (), ("v", "g")).agg(F.max("rn")).first()[0] == 3000


def test_mean_of_nearest_both_ways(spark):
    """Broadcast and joined give the same, with ties, few measurements and a year without any."""
    query = spark.createDataFrame([(g, t, float(g % 5), float(g // 5)) for g in range(20) for t in range(4)], "g int, t int, e_km double, n_km double")
    meas = spark.createDataFrame([(i, t, float(i % 4), float(i // 4), float(i * 3 + t)) for i in range(12) for t in range(2)] + [(99, 2, 0.0, 0.0, 5.0)], "id int, t int, e_km double, n_km double, val double")
    one, two = ({(r.g, r.t): r.val for r in covariates.nearest_mean(query, meas, 3, limit=n).collect()} for n in (100, 5))
    assert one == pytest.approx(two) and len(one) == 60
