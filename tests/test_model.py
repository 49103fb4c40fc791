"""The one-call model against its parts."""

import pytest
from pyspark.sql import functions as F

from seamark.operators import model
from seamark.plans import views as v
from seamark.plans.derived import flagship


@pytest.fixture(scope="module")
def fit(spark, sf_dir):
    obs = v.obs(spark, sf_dir).withColumn("i", F.monotonically_increasing_id())
    return model.IndexModel(obs, v.grid(spark, sf_dir), v.cell_area(spark, sf_dir)).fit()


def test_index_is_the_flagship(spark, sf_dir, fit):
    a = {(r.c, r.t, r.l): r["index"] for r in fit.index().collect()}
    for r in flagship(spark, sf_dir).collect():
        if r["index"] is not None:
            assert a[r.c, r.t, r.l] == pytest.approx(r["index"], abs=1e-3)
    by_cell = {(r.c, r.t, r.l): r["index"] for r in fit.density().join(fit.cell_area, "g").groupBy("c", "t", "l").agg(F.sum(F.col("d") * F.col("area")).alias("index")).collect()}
    assert all(x == pytest.approx(by_cell[k], rel=1e-9) for k, x in a.items() if x is not None)


def test_predictions_have_the_observed_means(fit):
    got = fit.predict(fit.obs.where("b IS NOT NULL AND c = 0 AND t = 1"))
    row = got.agg(F.avg((F.col("b") > 0).cast("double")).alias("p"), F.avg("r1").alias("r1")).first()
    total = fit.metadata.where("c = 0 AND t = 1").first()
    assert row.r1 == pytest.approx(total.prop_nonzero) and total.num_notna < total.num_total


def test_residuals_are_shares(fit):
    r = fit.residuals(20).agg(F.min("u"), F.max("u"), F.count("*")).first()
    assert 0 <= r[0] <= r[1] <= 1 and r[2] > 0


def test_maps(fit):
    held = {(r.c, r.t): r.beta1_id for r in model.intercept_map(fit.metadata).collect()}
    assert held[1, 5] is None and held[2, 3] is None and held[0, 1] == "0_1"
    assert {r.map_id for r in model.pool_rare(fit.metadata, 10**9).collect()} == {0}
    assert model.units()["density"] == "kg / km^2"


def test_summaries(fit):
    assert fit.summary("index", ["x", "y", "z"]).columns[0] == "Category"
    assert {"e_km", "d"} <= set(fit.summary("density").columns) and fit.summary("estimates").count() == 42
    with pytest.raises(ValueError):
        fit.summary("nothing")
