"""Covariance, synchrony, coherence and overlap of categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def loading_covariance(loading: DataFrame) -> DataFrame:
    """c1, c2, val: covariance L L' on and below the diagonal, correlation above it."""
    a, b = loading.alias("a"), loading.alias("b")
    cov = a.join(b, F.col("a.f") == F.col("b.f")).groupBy(F.col("a.c").alias("c1"), F.col("b.c").alias("c2")).agg(F.sum(F.col("a.val") * F.col("b.val")).alias("cov"))
    var = loading.groupBy("c").agg(F.sum(F.col("val") * F.col("val")).alias("v"))
    both = cov.join(F.broadcast(var.select(F.col("c").alias("c1"), F.col("v").alias("v1"))), "c1").join(F.broadcast(var.select(F.col("c").alias("c2"), F.col("v").alias("v2"))), "c2")
    return both.select("c1", "c2", F.when(F.col("c1") < F.col("c2"), F.col("cov") / F.sqrt(F.col("v1") * F.col("v2"))).otherwise(F.col("cov")).alias("val"))


def loading_distance(loading: DataFrame) -> DataFrame:
    """c1 < c2 and the Euclidean distance of their loading rows."""
    a, b = loading.alias("a"), loading.alias("b")
    rows = a.join(b, (F.col("a.f") == F.col("b.f")) & (F.col("a.c") < F.col("b.c")))
    d = F.col("a.val") - F.col("b.val")
    return rows.groupBy(F.col("a.c").alias("c1"), F.col("b.c").alias("c2")).agg(F.sqrt(F.sum(d * d)).alias("dist"))


def variance_share(loading: DataFrame) -> DataFrame:
    """f, share of the summed squared loadings."""
    got = loading.groupBy("f").agg(F.sum(F.col("val") * F.col("val")).alias("v"))
    total = got.agg(F.sum("v").alias("all"))
    return got.join(F.broadcast(total)).select("f", (F.col("v") / F.col("all")).alias("share"))


def synchrony(cells: DataFrame, periods: list[tuple[int, int]]) -> dict[str, DataFrame]:
    """Variances and synchrony of each period (first and last time step).

    cells: g, c, t, d, area.  phi_g: variance of the summed density over the squared sum of its
    categories' standard deviations, by cell; phi_c: the same of a category's abundance over cells; phi: of both.
    Returns tables gz (g, z), cz (c, z) and z.
    """
    table = F.explode(F.array(*(F.struct(F.lit(z).alias("z"), F.lit(a).alias("t0"), F.lit(b).alias("t1")) for z, (a, b) in enumerate(periods)))).alias("_p")
    rows = cells.select("*", table).where("t BETWEEN _p.t0 AND _p.t1").select("_p.z", "g", "c", "t", "d", "area")
    gc = rows.groupBy("z", "g", "c").agg(F.var_samp("d").alias("var_d"), F.max("area").alias("area"))
    total_g = rows.groupBy("z", "g", "t").agg(F.sum("d").alias("d")).groupBy("z", "g").agg(F.var_samp("d").alias("var_sum"))
    sd_g = gc.groupBy("z", "g").agg(F.sum(F.sqrt("var_d")).alias("sd"))
    gz = total_g.join(sd_g, ["z", "g"]).select("g", "z", "var_sum", F.try_divide(F.col("var_sum"), F.col("sd") * F.col("sd")).alias("phi"))
    b_ct = rows.groupBy("z", "c", "t").agg(F.sum(F.col("d") * F.col("area")).alias("b"))
    var_c = b_ct.groupBy("z", "c").agg(F.var_samp("b").alias("var_b"), F.avg("b").alias("mean_b"))
    sd_c = gc.groupBy("z", "c").agg(F.sum(F.col("area") * F.sqrt("var_d")).alias("sd"))
    cz = var_c.join(sd_c, ["z", "c"]).select("c", "z", "var_b", "mean_b", F.try_divide(F.col("var_b"), F.col("sd") * F.col("sd")).alias("phi"))
    total = b_ct.groupBy("z", "t").agg(F.sum("b").alias("b")).groupBy("z").agg(F.var_samp("b").alias("var_b"))
    sd = sd_c.groupBy("z").agg(F.sum("sd").alias("sd"))
    weighted = cz.groupBy("z").agg((F.sum(F.col("mean_b") * F.col("phi")) / F.sum("mean_b")).alias("phi_c_bar"))
    z = total.join(sd, "z").join(weighted, "z").select("z", "var_b", F.try_divide(F.col("var_b"), F.col("sd") * F.col("sd")).alias("phi"), "phi_c_bar")
    return {"gz": gz, "cz": cz, "z": z}


def coherence(loadings: list, n_c: int) -> tuple[float, float]:
    """(psi, total variance) from covariances L L' of a few categories: 0 for even eigenvalues, 1 for one alone."""
    import numpy as np

    cov = 1e-8 * np.eye(n_c) + sum((np.asarray(x) @ np.asarray(x).T for x in loadings), np.zeros((n_c, n_c)))
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    j = np.arange(1, n_c + 1)
    return float(2 * (np.sum(values * (n_c - j + 1)) / (n_c * values.sum()) - 0.5)), float(values.sum())


def overlap(density: DataFrame, one: tuple[int, int], two: tuple[int, int], kind: int, area: str = "area", threshold: float = 0.0, slope: float = 1.0, log: bool = False) -> DataFrame:
    """Overlap of two (category, time) fields over cells.

    0: mean (log) density of the first weighted by the second's abundance; 1: Schoener's D;
    2: area where the first is above a threshold, by a logistic curve.
    """
    pick = lambda ct, name: density.where((F.col("c") == ct[0]) & (F.col("t") == ct[1])).select("g", F.col("d").alias(name), F.col(area).alias(f"a_{name}"))
    both = pick(one, "d1").join(pick(two, "d2"), "g")
    if kind == 0:
        value = F.ln("d1") if log else F.col("d1")
        w = F.col("d2") * F.col("a_d2")
        return both.agg((F.sum(value * w) / F.sum(w)).alias("overlap"))
    if kind == 1:
        sums = both.agg(F.sum(F.col("d1") * F.col("a_d1")).alias("s1"), F.sum(F.col("d2") * F.col("a_d2")).alias("s2"))
        gap = F.abs(F.col("d1") * F.col("a_d1") / F.col("s1") - F.col("d2") * F.col("a_d2") / F.col("s2"))
        return both.join(F.broadcast(sums)).agg((1 - 0.5 * F.sum(gap)).alias("overlap"))
    if kind == 2:
        return both.agg(F.sum(F.col("a_d1") / (1 + F.exp(-(F.ln("d1") - threshold) * slope))).alias("overlap"))
    raise ValueError(f"kind {kind}")


def vessel_covariance(effects: DataFrame) -> DataFrame:
    """f1 >= f2: sample covariance of vessel effects (v, f, val)."""
    a, b = effects.alias("a"), effects.alias("b")
    rows = a.join(b, (F.col("a.v") == F.col("b.v")) & (F.col("a.f") >= F.col("b.f")))
    return rows.groupBy(F.col("a.f").alias("f1"), F.col("b.f").alias("f2")).agg(F.covar_samp("a.val", "b.val").alias("cov"))
