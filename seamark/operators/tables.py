"""Row and column helpers: complete cases, set operations, previews, replicate summaries, legacy names."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    """Within low and high; null stays null, which least and greatest alone would drop."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def complete_cases(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or NaN in columns."""
    return rows.dropna(subset=columns)


def restore(result: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """result with the keys of rows that were left out, as nulls."""
    return rows.select(*keys).join(result, keys, "left")


def with_predictions(obs: DataFrame, new: DataFrame, dummy: float = 1.0) -> DataFrame:
    """Samples, and rows to predict with pred_tf 1 and a dummy response; columns that new lacks are null."""
    return obs.withColumn("pred_tf", F.lit(0)).unionByName(new.withColumn("b", F.lit(dummy)).withColumn("pred_tf", F.lit(1)), allowMissingColumns=True)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows of a that b lacks."""
    return a.subtract(b.select(*a.columns))


def bind_columns(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of both tables side by side, by key; those that both have come from a."""
    return a.join(b.select(*keys, *(c for c in b.columns if c not in a.columns)), keys, "left")


def preview(rows: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first and the last n rows in an order, marked by part; tables of under 2 n rows repeat some."""
    first = rows.orderBy(*order).limit(n).withColumn("part", F.lit("head"))
    last = rows.orderBy(*(F.desc(c) for c in order)).limit(n).withColumn("part", F.lit("tail"))
    return first.unionByName(last)


def replicate_summary(rows: DataFrame, keys: list[str], fun: Callable, value: str = "val", schema: str | None = None) -> DataFrame:
    """A function of the replicates of each key.

    fun takes a Column and gives an aggregate; or, with schema (the result's type), an array of numbers and
    gives one, in a pandas aggregate over the replicates of one key, which are as many as were drawn.
    """
    if schema is None:
        return rows.groupBy(*keys).agg(fun(F.col(value)).alias("fun"))

    @F.pandas_udf(schema)
    def over(values: pd.Series) -> float:
        return float(fun(values.to_numpy()))

    return rows.groupBy(*keys).agg(over(F.col(value)).alias("fun"))


def binned(rows: DataFrame, width: float, value: str, fun: Callable[[Column], Column] = F.avg) -> DataFrame:
    """i, j, value: a function of the rows in each square cell of a raster."""
    return rows.groupBy(F.floor(F.col("e_km") / width).cast("int").alias("i"), F.floor(F.col("n_km") / width).cast("int").alias("j")).agg(fun(F.col(value)).alias(value))


def cluster_features(rows: DataFrame, site: str, feature: str, value: str, transform: Callable[[Column], Column], features: list) -> DataFrame:
    """A row for each site with its transformed values side by side; sites with a null or NaN among them are left out (see restore)."""
    wide = rows.withColumn(value, transform(F.col(value))).groupBy(site).pivot(feature, features).agg(F.first(value))
    return complete_cases(wide, [str(f) for f in features])


def stratum_truth(biomass: DataFrame, areas: DataFrame) -> DataFrame:
    """l, t, b: simulated biomass (x, t, b) dealt to strata by the share of a site's area (x, l, area) in each."""
    whole = areas.groupBy("x").agg(F.sum("area").alias("_a"))
    share = areas.join(whole, "x").select("x", "l", F.try_divide("area", "_a").alias("_s"))
    return biomass.join(share, "x").groupBy("l", "t").agg(F.sum(F.col("b") * F.col("_s")).alias("b"))


def overlaps(density: DataFrame, table: DataFrame, area: str = "area") -> DataFrame:
    """o, overlap: of every row of a table (o, c1, t1, c2, t2, kind, threshold, slope), in one pass over the cells.

    Kinds as in community.overlap; the table is as long as somebody has typed it, and broadcast.
    """
    at = F.broadcast(table)
    one = density.join(at, (F.col("c") == F.col("c1")) & (F.col("t") == F.col("t1"))).select("o", "g", "kind", "threshold", "slope", F.col("d").alias("d1"), F.col(area).alias("a1"))
    two = density.join(at, (F.col("c") == F.col("c2")) & (F.col("t") == F.col("t2"))).select("o", "g", F.col("d").alias("d2"), F.col(area).alias("a2"))
    both = one.join(two, ["o", "g"])
    sums = both.groupBy("o").agg(F.sum(F.col("d1") * F.col("a1")).alias("s1"), F.sum(F.col("d2") * F.col("a2")).alias("s2"))
    kind = F.col("kind")
    term = (
        F.when(kind == 0, F.col("d1") * F.col("d2") * F.col("a2") / F.col("s2"))
        .when(kind == 1, -0.5 * F.abs(F.col("d1") * F.col("a1") / F.col("s1") - F.col("d2") * F.col("a2") / F.col("s2")))
        .otherwise(F.col("a1") / (1 + F.exp(-(F.ln("d1") - F.col("threshold")) * F.col("slope"))))
    )
    return both.join(F.broadcast(sums), "o").groupBy("o", "kind").agg((F.sum(term) + F.when(F.first("kind") == 1, 1.0).otherwise(0.0)).alias("overlap")).select("o", "overlap")


def strip_units(columns: dict[str, tuple[str, str]]) -> dict[str, str]:
    """name: column, of columns that are held as (column, unit)."""
    return {name: column for name, (column, _) in columns.items()}


def trace_table(spark, steps: list[tuple[int, float, dict[str, float]]]) -> DataFrame:
    """step, objective, name, value: an optimiser's path, a row for each parameter and step."""
    return spark.createDataFrame([(k, float(f), n, float(x)) for k, f, values in steps for n, x in values.items()], "step int, objective double, name string, value double")
