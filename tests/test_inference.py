"""Errors and draws from a precision, interactions, density dependence, shapefiles, examples."""

import math
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamark.operators import posterior
from seamark.sources import examples, grids, shapes


def _spd(n, seed=3):
    a = np.random.default_rng(seed).normal(size=(n, n))
    return a @ a.T + n * np.eye(n)


def test_draws_have_the_precision(spark):
    q, mean = _spd(3), np.array([1.0, -2.0, 0.5])
    rows = posterior.draw_effects(spark, mean, q, n_samples=4000).toPandas().pivot(index="r", columns="k", values="val").to_numpy()
    assert np.allclose(rows.mean(axis=0), mean, atol=0.03)
    assert np.allclose(np.cov(rows.T), np.linalg.inv(q), atol=0.02)
    some = posterior.draw_effects(spark, mean, q, n_samples=50, random=[1]).toPandas()
    assert some[some.k == 0].val.nunique() == 1 and some[some.k == 1].val.nunique() == 50


def test_precision_from_rows(spark):
    q = _spd(4)
    rows = spark.createDataFrame([(i, j, float(q[i, j])) for i in range(4) for j in range(4)], "row int, col int, val double")
    assert np.allclose(posterior.dense(rows, 4), q)
    cov = {(r.a, r.b): r.cov for r in posterior.covariance_table(spark, q).collect()}
    assert np.allclose([[cov[i, j] for j in range(4)] for i in range(4)], np.linalg.inv(q))
    with pytest.raises(ValueError):
        posterior.dense(rows, posterior.MOST_EFFECTS + 1)
    with pytest.raises(ValueError):
        posterior.factor(-q)


def test_unbiased_index_is_the_mean_of_draws(spark):
    cov = np.linalg.inv(_spd(3) * 4)
    design = spark.createDataFrame([(g, k, w) for g in range(8) for k, w in ((g % 3, 0.6), ((g + 1) % 3, 0.4))], "g int, k int, w double")
    cells = spark.createDataFrame([(0, 0, "a", g, 1.0 + g) for g in range(8)], "c int, t int, l string, g int, index_g double")
    table = spark.createDataFrame([(a, b, float(cov[a, b])) for a in range(3) for b in range(3)], "a int, b int, cov double")
    got = posterior.delta_method(cells, design, table).first()
    u = np.random.default_rng(1).multivariate_normal(np.zeros(3), cov, 200_000)
    w = np.zeros((8, 3))
    for g in range(8):
        w[g, g % 3] += 0.6
        w[g, (g + 1) % 3] += 0.4
    index = np.exp(u @ w.T) @ (1.0 + np.arange(8))
    assert got.unbiased == pytest.approx(index.mean(), rel=2e-3) and got.se == pytest.approx(index.std(), rel=0.03)
    lone = posterior.delta_method(cells, design.where("false"), table).first()
    assert (lone["index"], lone.se, lone.unbiased) == (36.0, 0.0, 36.0)


def test_interactions():
    rng = np.random.default_rng(5)
    chi, psi = rng.normal(size=(4, 2)), rng.normal(size=(4, 2))
    assert not posterior.interaction(0, chi, psi)[0].any()
    assert np.allclose(posterior.interaction(1, chi, psi)[0], np.einsum("ar,br->ab", chi, psi))
    b, penalty = posterior.interaction(2, chi, psi)
    assert np.allclose(sorted(np.linalg.eigvals(b).real), sorted([psi[0, 0], psi[1, 1], 0, 0])) and penalty > 0
    with pytest.raises(ValueError):
        posterior.interaction(3, chi, psi)


def test_stationary_variance():
    b, cov = np.array([[0.5, 0.1], [-0.2, 0.4]]), np.array([[1.0, 0.3], [0.3, 2.0]])
    total, step = np.zeros((2, 2)), cov
    for _ in range(200):
        total, step = total + step, b @ step @ b.T
    assert np.allclose(posterior.stationary_variance(b, cov), total)
    load = np.array([[1.0, 0.0], [0.5, 2.0]])
    assert np.allclose(posterior.category_interaction(b, np.array([0.1, 0.2]), load) @ load, load @ (b + np.diag([0.1, 0.2])))


def test_impact_starts(spark):
    b, f = np.array([[0.5, 0.1], [0.0, 0.4]]), spark.createDataFrame([(c, t, 0.1 * (c + 1)) for c in range(2) for t in range(3)], "c int, t int, f double")
    run = {(r.c, r.t): r.impact for r in posterior.category_impact(f, b, start=2).collect()}
    long = np.linalg.solve(np.eye(2) - b, [-0.1, -0.2])
    assert all(run[c, t] == pytest.approx(long[c]) for c in range(2) for t in range(3))
    assert posterior.category_impact(f, b, start=0).agg(F.sum("impact")).first()[0] == 0
    assert posterior.category_impact(f.where("false"), b).count() == 0


def test_counterfactual_names(spark):
    rows = spark.range(1).select(F.lit(0).alias("g"))
    with pytest.raises(ValueError, match="nothing"):
        posterior.counterfactual(rows, {}, {}, {"nothing"})


def _shapefile(rings, kind=5):
    points = [p for r in rings for p in r]
    starts = np.cumsum([0, *map(len, rings[:-1])])
    body = struct.pack("<i4d2i", kind, 0, 0, 1, 1, len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *map(int, starts)) + b"".join(struct.pack("<2d", *p) for p in points)
    return struct.pack(">i", 9994) + bytes(96) + struct.pack(">2i", 1, len(body) // 2) + body


def test_shapefile(spark, tmp_path):
    shell, hole = [(0, 0), (0, 30), (30, 30), (30, 0), (0, 0)], [(10, 10), (20, 10), (20, 20), (10, 20), (10, 10)]
    (tmp_path / "a.shp").write_bytes(_shapefile([shell, hole]))
    sides = shapes.edges(shapes.read_shapefile(spark, str(tmp_path / "a.shp")))
    assert shapes.polygon_area(sides) == 800
    grid = shapes.polygon_grid(sides, (1.0, 1.0))
    assert grid.count() == 800 and grid.where("e_km >= 10 AND e_km < 20 AND n_km >= 10 AND n_km < 20").isEmpty()
    with pytest.raises(ValueError, match="area"):
        shapes.polygon_grid(sides, (21.0, 21.0))
    (tmp_path / "b.shp").write_bytes(_shapefile([shell], kind=3))
    assert shapes.read_shapefile(spark, str(tmp_path / "b.shp")).count() == 0
    (tmp_path / "c.shp").write_bytes(b"no shapes")
    with pytest.raises(Exception, match="not a shapefile"):
        shapes.read_shapefile(spark, str(tmp_path / "c.shp")).count()


def test_shapefile_in_degrees(spark, tmp_path):
    (tmp_path / "d.shp").write_bytes(_shapefile([[(-124.0, -45.0), (-124.0, -44.0), (-123.0, -44.0), (-123.0, -45.0), (-124.0, -45.0)]]))
    grid, zone = shapes.shapefile_grid(spark, str(tmp_path / "d.shp"), (0.5, 0.5))
    one = grid.agg(F.min("Lat").alias("s"), F.max("Lat").alias("n"), F.min("Lon").alias("w"), F.max("Lon").alias("e"), F.sum("Area_km2").alias("a")).first()
    assert zone == 10 and -45.01 < one.s < one.n < -43.99 and -124.03 < one.w < one.e < -122.97
    flat, e = 0.0066943799901413165, 0.08181919084262149
    q = lambda p: math.sin(p) / (2 * (1 - flat * math.sin(p) ** 2)) + math.log((1 + e * math.sin(p)) / (1 - e * math.sin(p))) / (4 * e)
    square = 6378.137**2 * (1 - flat) * math.radians(1) * (q(math.radians(45)) - q(math.radians(44)))  # on the ellipsoid
    assert one.a == pytest.approx(square, rel=0.005)
    with pytest.raises(ValueError, match="no polygons"):
        (tmp_path / "e.shp").write_bytes(_shapefile([[(0, 0), (1, 1)]], kind=3))
        shapes.shapefile_grid(spark, str(tmp_path / "e.shp"))


def test_example_catalogue(spark, tmp_path):
    assert all(e.region in grids.REGIONS or e.region == "other" for e in examples.EXAMPLES.values())
    rows = spark.createDataFrame([("Cycle 2007", "Ann", 3.0, 150.0, 45.0, -124.0, 1)], "PROJECT_CYCLE string, VESSEL string, HAUL_WT_KG double, AREA_SWEPT_HA double, BEST_LAT_DD double, BEST_LON_DD double, PASS int")
    rows.write.parquet(str(tmp_path / "canary"))
    got, region, strata = examples.load_example(spark, "WCGBTS_Canary", str(tmp_path / "canary"))
    one = got.first()
    assert (one.Catch_KG, one.Year, one.Vessel, one.AreaSwept_km2, one.Lat, one.Lon, one.Pass) == (3.0, 2007.0, "Ann_2007", 1.5, 45.0, -124.0, -0.5)
    assert region == "california_current" and strata[0][0] == "All_areas"
    spark.createDataFrame([(2.0, 1999, 40.0, -70.0)], "CATCH_WT_CAL double, YEAR int, LATITUDE double, LONGITUDE double").write.parquet(str(tmp_path / "haddock"))
    got, region, strata = examples.load_example(spark, "GB_fall_haddock", str(tmp_path / "haddock"))
    assert got.first().AreaSwept_km2 == pytest.approx(0.0112 * 1.852**2) and got.first().Vessel == "missing" and strata[0][1] == examples.GEORGES_BANK
    spark.range(3).write.parquet(str(tmp_path / "own"))
    got, region, _ = examples.load_example(spark, "nobody's", str(tmp_path / "own"))
    assert got.count() == 3 and region == "other"


def test_every_example_reads_its_columns(spark, tmp_path):
    for name, known in examples.EXAMPLES.items():
        text = re.sub("'[^']*'", "", " ".join(known.columns.values()))
        columns = {c.strip("`") for c in re.findall(r"`[^`]+`|(?<![\w.])[A-Za-z_]\w*", text)} - set("pow CAST AS get split concat_ws DOUBLE INT STRING".split())
        if columns:
            spark.range(1).select(*(F.lit("1 2").alias(c) if c == "PROJECT_CYCLE" else F.lit(1.0).alias(c) for c in sorted(columns))).write.parquet(str(tmp_path / name))
            got = examples.load_example(spark, name, str(tmp_path / name))[0]
            assert got.count() == 1 and set(got.columns) == {"Catch_KG", "Year", "Vessel", "AreaSwept_km2", "Lat", "Lon", "Pass"}, name
