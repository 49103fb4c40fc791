"""What grows with the data is not sent to the driver, and dense or large groups give the same as plain pairs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seamark.functions import links
from seamark.operators import covariates, diagnostics, posterior, spatial
from seamark.plans import QUERIES
from seamark.plans.spatial import _by_knot


def broadcasts(rows):
    return rows._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_pit_bounds_of_arrays_and_rows(spark, sf_dir):
    obs = spark.createDataFrame([(i, float(i % 4), [float(j) for j in range(i % 5 + 1)]) for i in range(20)], "i int, b double, sims array<double>")
    one, two = ({r.i: (r.lo, r.hi) for r in diagnostics.pit_bounds(obs, x).collect()} for x in (F.col("sims"), obs.select("i", F.explode("sims").alias("sim"))))
    assert one == two and one[4] == (0.0, 0.2)
    twice = spark.createDataFrame([(1, 0.0, [0.0, 1.0]), (1, 2.0, [0.0, 1.0])], "i int, b double, sims array<double>")
    assert tuple(diagnostics.pit_bounds(twice, F.col("sims")).first()) == (1, 0.5, 0.75)
    assert broadcasts(QUERIES["a24_pit_bounds"](spark, sf_dir)) == 0


#: Queries over cells, and what they broadcast: totals by time and stratum, first years, intercepts and indices of some rows.
OVER_CELLS = {"a10_composition_neff": 0, "a10_mean_category": 0, "a5_index_area": 0, "a5_index_mode1": 0, "a5_index_mode2": 1, "a5_index_mode3": 0, "a5_index_mode4": 0, "a7_effective_area": 0, "a9_category_share": 0, "a8_biomass_ratio": 1, "k1_index_table": 0, "m8_lagrange_penalty": 1, "w7_running_category": 0}


@pytest.mark.parametrize("name", OVER_CELLS)
def test_areas_of_cells_are_not_broadcast(spark, sf_dir, name):
    assert broadcasts(QUERIES[name](spark, sf_dir)) <= OVER_CELLS[name]


@pytest.mark.parametrize(("n", "h"), [(1, 0.5), (5, 0.0), (3, 8.0), (400, 380.0), (3000, 2990.0), (3000, 2700.0), (3000, 3300.0), (20000, 20100.0), (100, 1000.0)])
def test_chi_square_survival_of_many_values(spark, n, h):
    want = math.fsum(math.exp(-h + (j * math.log(h) if j else 0.0) - math.lgamma(j + 1)) for j in range(n)) if h else 1.0
    got = spark.range(1).select(links.even_chi2_survival(F.lit(2 * h), F.lit(n)).alias("p")).first().p
    assert got == pytest.approx(want, rel=1e-7)


def test_covariates_that_vary_are_not_broadcast(spark, sf_dir):
    assert broadcasts(QUERIES["m7_covariate_effect"](spark, sf_dir)) == 1  # the coefficients


def test_total_density_is_not_broadcast(spark, sf_dir):
    rows = QUERIES["r215_map_tables"](spark, sf_dir)
    assert broadcasts(rows) == 0
    got = rows.where("variable = 'total_density'").groupBy("g", "t").agg(F.count("*").alias("n"), F.countDistinct("value").alias("k")).select("n", "k").distinct().collect()
    assert [tuple(r) for r in got] == [(3, 1)]


def test_nearest_counts_places(spark, monkeypatch):
    """Many sites of few places are as cheap as those places, and the smallest id of a place stands for it."""
    sites = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(60)] + [(60, None, 0.0)], "x long, e_km double, n_km double")
    query = spark.createDataFrame([(g, float(g) / 2, 1.0) for g in range(6)], "g long, e_km double, n_km double")
    by_cells = {r.g: (r.x, r.d2) for r in spatial.nearest_bucketed(query, sites, "x").collect()}
    monkeypatch.setattr(spatial, "nearest_bucketed", lambda *a, **b: pytest.fail("sites were counted instead of places"))
    assert {r.g: (r.x, r.d2) for r in spatial.nearest(query, sites, "x", limit=3).collect()} == by_cells
    assert by_cells == {0: (0, 1.0), 1: (0, 1.25), 2: (1, 1.0), 3: (1, 1.25), 4: (2, 1.0), 5: (2, 1.25)}


def test_mean_of_nearest_by_cells_equals_all_pairs(spark):
    """Crowded places, ties, places that are null, years with few or no measurements; the cells and the broadcast form against plain ranks."""
    rng = np.random.default_rng(4)
    meas = [(i, i % 2, float(rng.integers(0, 9)) * (30 if i % 50 == 0 else 1), float(rng.integers(0, 4)), float(i * i % 37)) for i in range(400)]
    meas += [(400 + i, 0, 1.0, 1.0, float(i)) for i in range(80)] + [(900, 2, 3.0, 1.0, 5.0), (901, 2, None, 1.0, 8.0), (902, 0, None, None, 4.0), (899, 2, None, 2.0, None)]
    asked = [(g, t, float(g % 7) * (100 if g == 5 else 1), float(g % 4)) for g in range(25) for t in range(4)] + [(99, t, None, 1.0) for t in range(4)]
    want = {}
    for g, t, e, n in asked:
        order = sorted((m for m in meas if m[1] == t), key=lambda m: (math.inf if e is None or m[2] is None or m[3] is None else (e - m[2]) ** 2 + (n - m[3]) ** 2, m[0]))[:3]
        if any(m[4] is not None for m in order):
            want[g, t] = np.mean([m[4] for m in order if m[4] is not None])
    q = spark.createDataFrame(asked, "g int, t int, e_km double, n_km double")
    m = spark.createDataFrame(meas, "id int, t int, e_km double, n_km double, val double")
    for limit in (1000, 20):
        assert {(r.g, r.t): r.val for r in covariates.nearest_mean(q, m, 3, limit=limit).collect()} == pytest.approx(want), limit
    assert "ArrowEvalPython" in covariates.nearest_mean(q, m.where("id >= 400 AND id < 900"), 3, limit=20)._jdf.queryExecution().executedPlan().toString()


def test_observations_by_knot_read_once_and_nothing_broadcast(spark, sf_dir):
    assert broadcasts(_by_knot(spark, sf_dir)) == 0
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(x, t, float(x * 7 % 5 + t * t + k)) for x in range(6) for t in range(3) if (x + t) % 4 for k in range(3)] + [(0, 1, None)]
    data = spark.createDataFrame(rows, "x int, t int, val double").mapInArrow(count, "x int, t int, val double")
    frame = pd.DataFrame(rows, columns=["x", "t", "val"])
    by, over = frame.groupby(["x", "t"]).val.mean(), frame.groupby("x").val.mean()
    got = {(r.x, r.t): r.val for r in covariates.knot_covariates(data).collect()}
    assert got == pytest.approx({(x, t): by.get((x, t), over[x]) for x in range(6) for t in range(3)}) and seen.value == len(rows)
    lost = covariates.variance_lost(data).first().lost
    assert lost == pytest.approx(1 - frame.join(by.rename("m"), on=["x", "t"]).m.var() / frame.val.var()) and seen.value == 2 * len(rows)


def test_semivariogram_of_crowded_places_equals_all_pairs(spark):
    """Sites that share places, a site with several rows of a time step, null sites, values and places; places meet, not rows."""
    rng = np.random.default_rng(2)
    rows = [(i, t, float(rng.integers(0, 4) * 15), float(rng.integers(-1, 2) * 20), 1e6 + float(rng.integers(0, 9))) for i in range(40) for t in range(4)]
    rows += [(3, 0, 15.0, 0.0, 1e6), (3, 0, 15.0, 0.0, 1e6 + 2), (3, 1, 0.0, 20.0, None), (None, 0, 0.0, 0.0, 1e6), (None, 1, 0.0, 0.0, 1e6), (50, 2, None, 0.0, 1e6), (51, 2, 500.0, 500.0, 1e6)]
    pairs = {}
    for a in rows:
        for b in rows:
            lag = b[1] - a[1]
            if None in (a[2], b[2]) or not 0 <= lag <= 2 or lag == 0 and (None in (a[0], b[0]) or a[0] >= b[0]):
                continue
            d2 = (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
            if d2 < 40.0**2:
                pairs.setdefault((lag, int(math.sqrt(d2) / 10)), []).append(None if None in (a[4], b[4]) else (a[4] - b[4]) ** 2)
    got = diagnostics.semivariogram(spark.createDataFrame(rows, "site int, t int, e_km double, n_km double, val double"), 10.0, 40.0, 2)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") >= 4
    assert {(r.lag, r.bin): r.n for r in got.collect()} == {k: len(x) for k, x in pairs.items()}
    assert {(r.lag, r.bin): r.semivar for r in got.collect()} == pytest.approx({k: np.mean([y for y in x if y is not None]) / 2 for k, x in pairs.items()}, rel=1e-7)


def test_index_errors_read_cells_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "c int, t int, l string, g int, index_g double"
    cells = spark.createDataFrame([(0, g % 2, "a", g, 1.0 + g) for g in range(10)], schema).mapInArrow(count, schema)
    design = spark.createDataFrame([(g, k, 0.5 + k) for g in range(8) for k in (0, 1)], "g int, k int, w double")
    cov = [[0.3, 0.1], [0.1, 0.2]]
    table = spark.createDataFrame([(a, b, cov[a][b]) for a in (0, 1) for b in (0, 1)], "a int, b int, cov double")
    got = {r.t: (r["index"], r.se, r.unbiased) for r in posterior.delta_method(cells, design, table).collect()}
    w = np.array([0.5, 1.5])
    var = w @ np.array(cov) @ w
    for t in (0, 1):
        whole, bare = sum(1.0 + g for g in range(t, 8, 2)), 9.0 + t  # the last two cells have no design
        assert got[t] == pytest.approx((whole + bare, whole * math.sqrt(var), whole * (1 + var / 2) + bare))
    assert seen.value == 10


def test_index_draws_are_sums_over_cells(spark, sf_dir):
    rng = np.random.default_rng(6)
    cells = [(int(g) % 3, "a" if g % 2 else None, g, float(rng.random())) for g in range(30) for _ in range(2)]
    design = [(g, k, float(rng.normal())) for g in range(28) for k in ((g % 3, g % 3, 7) if g % 4 else (1,))]  # twice the same effect; 7 has no draw
    draws = [(k, r, float(rng.normal())) for k in range(3) for r in (1, 2, 5)]
    val, want = {(k, r): x for k, r, x in draws}, {}
    for t, l, g, x in cells:
        for r in (1, 2, 5) if g < 28 else ():
            want[t, l, r] = want.get((t, l, r), 0.0) + x * math.exp(sum(w * val.get((k, r), 0.0) for h, k, w in design if h == g))
    made = posterior.index_draws(spark.createDataFrame(cells, "t int, l string, g int, index_g double"), spark.createDataFrame(design, "g int, k int, w double"), spark.createDataFrame(draws, "k int, r int, val double"), ("t", "l"))
    assert {(r.t, r.l, r.r): r["index"] for r in made.collect()} == pytest.approx(want)
    assert broadcasts(QUERIES["e11_index_draws"](spark, sf_dir)) == 0
