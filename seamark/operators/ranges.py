"""Ordered operators: range edges, quantiles, autoregressive means, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seamark.operators.ordered import running


def cumulative_share(cells: DataFrame, axis: str = "z", weight: str = "d", keys: tuple[str, ...] = ("c", "t")) -> DataFrame:
    """cells with the share of weight up to each cell along an axis (ties by g)."""
    return running(cells, keys, (axis, "g"), weight).withColumn("share", F.col("run") / F.col("total")).drop("n", "run", "total")


def range_edge(cells: DataFrame, quantiles: list[float], axis: str = "z", weight: str = "d", keys: tuple[str, ...] = ("c", "t")) -> DataFrame:
    """keys, q, edge: the coordinate of the cell whose share is nearest to q, the first on ties. No interpolation."""
    shares = cumulative_share(cells, axis, weight, keys)
    picks = [F.min_by(axis, F.struct((F.col("share") - q) * (F.col("share") - q), "rn")).alias(f"e{k}") for k, q in enumerate(quantiles)]
    wide = shares.groupBy(*keys).agg(*picks)
    return wide.select(*keys, F.explode(F.array(*(F.struct(F.lit(float(q)).alias("q"), F.col(f"e{k}").alias("edge")) for k, q in enumerate(quantiles)))).alias("x")).select(*keys, "x.q", "x.edge")


def interpolated_quantile(cells: DataFrame, q: float, axis: str = "z", weight: str = "d", keys: tuple[str, ...] = ("c", "t")) -> DataFrame:
    """keys, z: linear between the last cell with a share of q at most and the next one."""
    shares = cumulative_share(cells, axis, weight, keys)
    over, at = F.col("share") > q, F.struct("share", axis)
    got = shares.groupBy(*keys).agg(F.min_by(F.when(over, at), F.when(over, F.col("rn"))).alias("b"), F.max_by(F.when(~over, at), F.when(~over, F.col("rn"))).alias("a")).where("b IS NOT NULL")
    s1, z1, s0, z0 = F.col("b.share"), F.col(f"b.{axis}"), F.col("a.share"), F.col(f"a.{axis}")
    return got.select(*keys, F.when(s0.isNull(), z1).otherwise(z0 + (q - s0) / (s1 - s0) * (z1 - z0)).alias("z"))


def autoregressive_mean(field: DataFrame, rho: float | Column, keys: tuple[str, ...] = ("s", "f"), value: str = "val") -> DataFrame:
    """field with mean = rho times the value one step before, 0 at the first."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy("t"))
    return field.withColumn("mean", F.coalesce((F.lit(rho) if isinstance(rho, float) else rho) * before, F.lit(0.0)))


def centred(rows: DataFrame, keys: tuple[str, ...], value: str = "val") -> DataFrame:
    return rows.withColumn("centred", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def running_categories(idx: DataFrame) -> DataFrame:
    """Sum of the index over this and smaller categories."""
    w = Window.partitionBy("t", "l").orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return idx.withColumn("running", F.sum("index").over(w))


def fishing_impact(catch: DataFrame, b: float, stationary: bool = False) -> DataFrame:
    """Impact i_t = b * i_(t-1) - f_t by category, from -f_0 or -f_0 / (1 - b), as a fold over the ordered years."""
    ordered = catch.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("t", "f"))).alias("a"))
    start = F.lit(1.0 / (1.0 - b) if stationary else 1.0)

    first = F.element_at("a", 1)
    init = F.array(F.struct(first["t"].alias("t"), (-first["f"] * start).alias("i")))
    rest = F.slice("a", 2, F.size("a"))
    walk = F.aggregate(rest, init, lambda acc, x: F.concat(acc, F.array(F.struct(x["t"].alias("t"), (F.lit(b) * F.element_at(acc, -1)["i"] - x["f"]).alias("i")))))
    return ordered.select("c", F.explode(walk).alias("x")).select("c", "x.t", F.col("x.i").alias("impact"))


def cohorts(recruits: DataFrame, mortality: float, max_age: int) -> DataFrame:
    """t, age, n: a cohort's numbers after age years of constant mortality (recruits: t, n)."""
    return recruits.select("t", "n", F.explode(F.sequence(F.lit(0), F.lit(max_age))).alias("age")).select((F.col("t") + F.col("age")).alias("t"), "age", (F.col("n") * F.exp(-mortality * F.col("age"))).alias("n"))


def path_segments(rows: DataFrame, keys: tuple[str, ...], x: str = "x", order: str = "o") -> DataFrame:
    """rows with a segment number that grows where x stops increasing."""
    w = Window.partitionBy(*keys).orderBy(order)
    broken = F.when(F.col(x) <= F.lag(x).over(w), 1).otherwise(0)
    return rows.withColumn("_b", broken).withColumn("segment", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_b")


def cumulative_eigen(values: DataFrame) -> DataFrame:
    """Share of the sum up to each value, largest first (ties by k)."""
    w = Window.orderBy(F.desc("val"), "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return values.withColumn("cum_share", F.sum("val").over(w) / F.sum("val").over(Window.partitionBy()))
