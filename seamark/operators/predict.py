"""Linear predictors and densities from effect tables (long, one row for each index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions import links


def add_effects(rows: DataFrame, effects: list[tuple[DataFrame, list[str]]], into: str) -> DataFrame:
    """rows with into = the sum of effects (column val) looked up by their keys; a missing effect is 0.

    Effects of category and time are some rows and are broadcast by Spark while they are small.
    """
    total = F.lit(0.0)
    for k, (table, keys) in enumerate(effects):
        rows = rows.join(table.select(*keys, F.col("val").alias(f"_e{k}")), keys, "left")
        total = total + F.coalesce(f"_e{k}", F.lit(0.0))
    return rows.withColumn(into, total).drop(*(f"_e{k}" for k in range(len(effects))))


def densities(rows: DataFrame, link: int = 0, effort: Column | None = None) -> DataFrame:
    """rows (p1, p2) with r1, r2 and density d.

    link 0 and 3: conventional delta; 1 and 4: Poisson-link delta, d = exp(p1 + p2); 2: Tweedie, d = r1 * r2.
    """
    a = F.lit(1.0) if effort is None else effort
    p1, p2 = F.col("p1"), F.col("p2")
    if link in (0, 3):
        r1, r2 = links.delta_link(p1, p2, a)
        d = r1 * r2
    elif link in (1, 4):
        r1, r2 = links.poisson_link(p1, p2, a)
        d = F.exp(p1 + p2)
    elif link == 2:
        r1, r2 = links.tweedie_link(p1, p2, a)
        d = r1 * r2
    else:
        raise ValueError(f"link {link}")
    return rows.withColumns({"r1": r1, "r2": r2, "d": d})


def combined_poisson_link(members: DataFrame, keys: list[str]) -> DataFrame:
    """Observations that hold several categories: n and w are sums over them (rows: keys, a, p1, p2)."""
    got = members.groupBy(*keys, "a").agg(F.sum(F.exp("p1")).alias("n"), F.sum(F.exp(F.col("p1") + F.col("p2"))).alias("w"))
    r1 = -F.expm1(-F.col("a") * F.col("n"))
    return got.withColumn("r1", r1).withColumn("r2", F.col("a") * F.col("w") / r1)


def catchability(design: DataFrame, coefficients: DataFrame, varying: DataFrame | None = None) -> DataFrame:
    """i, zeta: the sum over k of (lambda_k + phi_ik) * Q_ik; design: i, k, q."""
    rows = design.join(F.broadcast(coefficients.select("k", "lam")), "k")
    if varying is not None:
        rows = rows.join(varying.select("i", "k", "phi").hint("merge"), ["i", "k"], "left")  # as long as design
    phi = F.coalesce("phi", F.lit(0.0)) if varying is not None else F.lit(0.0)
    return rows.groupBy("i").agg(F.sum((F.col("lam") + phi) * F.col("q")).alias("zeta"))


def covariate_effect(design: DataFrame, coefficients: DataFrame, varying: DataFrame | None = None, response: DataFrame | None = None) -> DataFrame:
    """g, c, t, eta: the sum over p of (gamma_cp + xi_gcp) * X_gtp.

    coefficients: c, p, gamma, config (0 none, 1 fixed, 2 varying around zero, 3 fixed and varying, 4 varying with
    response (c, t, x) in place of the covariate, -1 as 2 without a penalty in the fit).  Without
    response, covariates of config 4 have no effect.
    """
    rows = design.join(F.broadcast(coefficients.select("c", "p", "gamma", "config")), "p")
    if varying is not None:
        rows = rows.join(varying.select("g", "c", "p", "xi").hint("merge"), ["g", "c", "p"], "left")  # as long as design
    xi = F.coalesce("xi", F.lit(0.0)) if varying is not None else F.lit(0.0)
    if response is not None:
        rows = rows.join(F.broadcast(response.select("c", "t", F.col("x").alias("_x"))), ["c", "t"], "left")
    x = F.when(F.col("config") == 4, F.coalesce("_x", F.lit(0.0)) if response is not None else F.lit(0.0)).otherwise(F.col("x"))
    fixed = F.when(F.col("config").isin(1, 3), F.col("gamma")).otherwise(0.0)
    vary = F.when(F.col("config").isin(-1, 2, 3, 4), xi).otherwise(0.0)
    return rows.groupBy("g", "c", "t").agg(F.sum((fixed + vary) * x).alias("eta"))


def loadings(packed: list[float], n_rows: int, n_factors: int) -> list[tuple[int, int, float]]:
    """(c, f, val) of a lower-trapezoidal matrix that is packed by rows; zeros above the diagonal are left out."""
    out, at = [], 0
    for c in range(n_rows):
        for f in range(min(c + 1, n_factors)):
            out.append((c, f, packed[at]))
            at += 1
    return out


def field_to_category(field: DataFrame, loading: DataFrame, scale: float = 1.0, keys: tuple[str, ...] = ("s",)) -> DataFrame:
    """keys, c, val: the sum over factors of field times loading, over tau (scale = 1 / tau)."""
    return field.join(F.broadcast(loading.select("c", "f", F.col("val").alias("_l"))), "f").groupBy(*keys, "c").agg((F.sum(F.col("val") * F.col("_l")) * F.lit(scale)).alias("val"))


def time_factors(field: DataFrame, loading: DataFrame) -> DataFrame:
    """s, f, t, val: the sum over factors h of field (s, f, h) times time loading (t, h)."""
    return field.join(F.broadcast(loading.select("t", "h", F.col("val").alias("_l"))), "h").groupBy("s", "f", "t").agg(F.sum(F.col("val") * F.col("_l")).alias("val"))
