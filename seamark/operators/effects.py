"""Loadings, intercept and vessel processes, penalties, and the finite elements of a mesh."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.functions.links import log_normal_density
from seamark.operators.predict import loadings as packed_loadings

AR1, OFF, IID, IDENTITY = 0, -1, -2, -3


def loading_table(values: list[float], n: int, config: int, zero_sum: bool = False, unit_trace: bool = False) -> tuple[list[tuple[int, int, float]], float]:
    """(c, f, val) of the loadings that a field's code asks for, and the penalty that comes with them.

    AR1: values are the transformed correlation and the log of the marginal standard deviation; IID: a
    diagonal; IDENTITY; OFF: nothing; a rank: packed by rows below the diagonal.  zero_sum
    penalises factors whose loadings do not add up to 0; unit_trace scales the
    implied covariance to a trace of 1 and penalises its logarithm.
    """
    if config == OFF:
        return [], 0.0
    if config == IDENTITY:
        return [(c, c, 1.0) for c in range(n)], 0.0
    if config == IID:
        return [(c, c, float(values[c])) for c in range(n)], 0.0
    if config == AR1:
        rho, sd = 2 / (1 + math.exp(-values[0])) - 1, math.exp(values[1])
        return [(r, c, sd * rho ** (r - c) * (math.sqrt(1 - rho * rho) if c else 1.0)) for c in range(n) for r in range(c, n)], 0.0
    table, penalty = packed_loadings(values, n, config), 0.0
    if zero_sum:
        for f in range(config):
            penalty += sum(val for _, at, val in table if at == f) ** 2
    if unit_trace:
        trace = sum(val * val for _, _, val in table)
        table = [(c, f, val / math.sqrt(trace)) for c, f, val in table]
        penalty += config * math.log(trace) ** 2
    return table, penalty


def intercepts(factors: DataFrame, loading: DataFrame, mean_c: DataFrame, mean_t: DataFrame) -> DataFrame:
    """c, t, beta: factors (t, f, val) times loadings (c, f, val), plus a mean of the category and one of the step.

    mean_c (c, val) and mean_t (t, val) name every category and step; all tables are as small as the model's axes.
    """
    part = factors.join(F.broadcast(loading.select("c", "f", F.col("val").alias("_l"))), "f").groupBy("c", "t").agg(F.sum(F.col("val") * F.col("_l")).alias("_b"))
    dense = mean_c.select("c", F.col("val").alias("_c")).join(F.broadcast(mean_t.select("t", F.col("val").alias("_t"))))
    return dense.join(part, ["c", "t"], "left").select("c", "t", (F.coalesce("_b", F.lit(0.0)) + F.col("_c") + F.col("_t")).alias("beta"))


def autoregressive_penalty(factors: DataFrame, rho: float) -> DataFrame:
    """f, nll: of factors (t, f, val) that follow rho times the step before, with unit variance."""
    before = factors.select("f", (F.col("t") + 1).alias("t"), F.col("val").alias("_b"))
    both = factors.join(before, ["f", "t"], "left")
    return both.groupBy("f").agg((-F.sum(log_normal_density(F.col("val"), F.lit(rho) * F.coalesce("_b", F.lit(0.0)), F.lit(1.0)))).alias("nll"))


def vessel_effects(effects: DataFrame, loading: DataFrame) -> DataFrame:
    """v, c, eta: vessel factors (v, f, val) times loadings (c, f, val)."""
    return effects.join(F.broadcast(loading.select("c", "f", F.col("val").alias("_l"))), "f").groupBy("v", "c").agg(F.sum(F.col("val") * F.col("_l")).alias("eta"))


def normal_penalty(value: Column) -> Column:
    """Negative log density of standard normal effects, summed."""
    return -F.sum(log_normal_density(value, F.lit(0.0), F.lit(1.0)))


# finite elements
def anisotropy(h0: float, h1: float) -> tuple[tuple[float, float], tuple[float, float]]:
    """The symmetric matrix of determinant 1 that two parameters make."""
    return (math.exp(h0), h1), (h1, math.exp(-h0) * (1 + h1 * h1))


def ellipse(h0: float, h1: float, reach: float) -> tuple[float, float, float]:
    """Long and short axis of the anisotropy ellipse (eigenvalues times reach), and the long one's angle."""
    (a, b), (_, d) = anisotropy(h0, h1)
    middle, gap = (a + d) / 2, math.hypot((a - d) / 2, b)
    return (middle + gap) * reach, (middle - gap) * reach, 0.5 * math.atan2(2 * b, a - d)


def mesh_matrices(triangles: DataFrame, h: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (0.0, 1.0)), member: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lumped mass, stiffness, second-order) matrices as (row, col, val) of linear elements.

    triangles: s0 to s2 and their places x0, y0 to x2, y2.  h: anisotropy; member: only
    these triangles (a barrier's water or land).  Stiffness is the sum over triangles of
    e_i' adj(h) e_j / (4 area), with e_k the edge opposite vertex k; the second-order matrix is stiffness times
    inverse mass times stiffness.  Equi-joins on vertices, so no task holds a whole mesh.
    """
    rows = triangles if member is None else triangles.where(member)
    x, y = [F.col(f"x{k}").cast("double") for k in range(3)], [F.col(f"y{k}").cast("double") for k in range(3)]
    edge = [(x[(k + 2) % 3] - x[(k + 1) % 3], y[(k + 2) % 3] - y[(k + 1) % 3]) for k in range(3)]
    area = F.abs((x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])) / 2
    (a, b), (_, d) = h
    product = lambda i, j: (F.lit(d) * edge[i][0] * edge[j][0] - F.lit(b) * (edge[i][0] * edge[j][1] + edge[i][1] * edge[j][0]) + F.lit(a) * edge[i][1] * edge[j][1]) / (4 * area)
    cell = lambda i, j, v: F.struct(F.col(f"s{i}").cast("bigint").alias("row"), F.col(f"s{j}").cast("bigint").alias("col"), v.alias("val"))
    total = lambda entries: rows.select(F.explode(F.array(*entries)).alias("e")).select("e.*").groupBy("row", "col").agg(F.sum("val").alias("val"))
    mass = total([cell(k, k, area / 3) for k in range(3)])
    stiff = total([cell(i, j, product(i, j)) for i in range(3) for j in range(3)])
    inner = stiff.join(mass.select(F.col("row").alias("col"), F.col("val").alias("_m")), "col").select("row", F.col("col").alias("k"), (F.col("val") / F.col("_m")).alias("_v"))
    second = inner.join(stiff.select(F.col("row").alias("k"), "col", "val"), "k").groupBy("row", "col").agg(F.sum(F.col("_v") * F.col("val")).alias("val"))
    return mass, stiff, second


def mesh_precision(mass: DataFrame, stiff: DataFrame, second: DataFrame, kappa: float) -> DataFrame:
    """(row, col, val) of kappa^4 mass + 2 kappa^2 stiffness + second-order matrix."""
    scaled = [m.select("row", "col", (F.col("val") * F.lit(w)).alias("val")) for m, w in ((mass, kappa**4), (stiff, 2 * kappa**2), (second, 1.0))]
    return scaled[0].unionByName(scaled[1]).unionByName(scaled[2]).groupBy("row", "col").agg(F.sum("val").alias("val"))
