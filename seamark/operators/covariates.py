"""Covariates: nearest in space within a year, static rows, replacement."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from seamark.functions.geo import squared_distance


def spread_static(covariates: DataFrame, years: list[int]) -> DataFrame:
    """Rows without a year stand for every year; years is the model's time axis."""
    every = covariates.where("year IS NULL").drop("year").withColumn("year", F.explode(F.array(*map(F.lit, years))))
    return covariates.where("year IS NOT NULL").unionByName(every.select(*covariates.columns))


def nearest_in_year(query: DataFrame, covariates: DataFrame, values: list[str], key: str = "q") -> DataFrame:
    """query (key, year, lat, lon) with values of the nearest covariate row of its year (ties: smallest id); distance in degrees.

    Joined by year and cell, so a query meets the sites around it and not its whole year.  A year
    without sites is an error.
    """
    bare = query.select("year").distinct().join(covariates.select("year").distinct(), "year", "left_anti").first()
    if bare is not None:
        raise ValueError(f"no covariates for the year {bare.year}")

    from seamark.operators.spatial import nearest_bucketed

    place = [F.col("lat").alias("e_km"), F.col("lon").alias("n_km")]
    found = nearest_bucketed(query.select(key, "year", *place), covariates.select("year", *place, "id"), "id", by=("year",)).where("id IS NOT NULL")
    return found.select(key, "year", F.col("id").alias("cov_id")).join(covariates.select(F.col("id").alias("cov_id"), "year", *values), ["cov_id", "year"]).select(key, "year", "cov_id", *values)


def replace_rows(old: DataFrame, new: DataFrame, on: tuple[str, ...] = ("lat", "lon", "year")) -> DataFrame:
    """old without the rows that new gives afresh, and new."""
    return old.join(new, list(on), "left_anti").unionByName(new)


def nearest_mean(query: DataFrame, measurements: DataFrame, k: int, key: str = "g", value: str = "val", limit: int = 10_000) -> DataFrame:
    """Mean of the k nearest measurements of a year (ties: smallest id); rows of a year without any drop out.

    A place and year counts with its k smallest ids, as no other of it can be among the nearest.  Up to limit of those,
    counted first, are broadcast and ranked in Arrow batches; more are joined by year and cell.  Measurements without
    a place come after all others.
    """
    lost = "e_km IS NULL OR n_km IS NULL OR isnan(e_km) OR isnan(n_km)"
    place = [F.when(~F.expr(lost), F.col(c)).alias(c) for c in ("e_km", "n_km")]
    first = F.row_number().over(Window.partitionBy("t", "e_km", "n_km").orderBy("id"))
    kept = measurements.select("t", "id", *place, F.col(value).cast("double").alias("_v")).withColumn("_r", first).where(F.col("_r") <= k).drop("_r")
    rows = kept.limit(limit + 1).collect()  # bounded by limit
    if len(rows) > limit:
        return _nearest_mean_by_cells(query, kept, k, key, value)
    by: dict = {}
    for r in sorted(rows, key=lambda r: r[1]):  # the first of equal distances is then the smallest id
        by.setdefault(r[0], []).append(tuple(r)[2:])
    shared = query.sparkSession.sparkContext.broadcast({t: np.array(x, float).T for t, x in by.items()})

    @F.pandas_udf("double")
    def mean(t: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(t), np.nan)
        for year, (e, n, val) in shared.value.items():
            mine = np.flatnonzero((t == year).to_numpy())
            step = max(1, 500_000 // len(e))
            for at in (mine[j : j + step] for j in range(0, len(mine), step)):
                dx, dy = x.to_numpy(float)[at, None] - e, y.to_numpy(float)[at, None] - n
                near = val[np.argsort(dx * dx + dy * dy, axis=1, kind="stable")[:, :k]]
                known = ~np.isnan(near)
                with np.errstate(invalid="ignore"):
                    out[at] = np.where(known, near, 0.0).sum(axis=1) / known.sum(axis=1)
        return pd.Series(out).astype("Float64").mask(np.isnan(out))

    return query.select(key, "t", mean("t", "e_km", "n_km").alias(value)).where(F.col(value).isNotNull())


def _nearest_mean_by_cells(query: DataFrame, kept: DataFrame, k: int, key: str, value: str) -> DataFrame:
    """Each row looks into the 3 by 3 cells around it, whose width doubles until its k-th measurement is no farther than a cell is wide.

    kept: t, id, e_km, n_km, _v, no place with more than k of a year.  Years with fewer than k places' worth of
    measurements, and rows without a place, are few to rank or alike; they are joined with at most 2 k of their year.
    """
    from seamark.operators.lineage import written

    asked = written(query.select(key, "t", "e_km", "n_km").withColumn("_q", F.monotonically_increasing_id()))
    kept = written(kept)
    d2 = squared_distance(F.col("e_km"), F.col("n_km"), F.col("_e"), F.col("_n")).alias("d2")
    best = lambda rows: rows.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy(F.col("d2").asc_nulls_last(), "id"))).where(F.col("_r") <= k)
    placed = kept.where("e_km IS NOT NULL").select("t", "id", F.col("e_km").alias("_e"), F.col("n_km").alias("_n"), "_v")
    full = F.broadcast(placed.groupBy("t").agg(F.count("*").alias("_k")).where(F.col("_k") >= k).select("t"))  # a row for each year
    nowhere = "e_km IS NULL OR n_km IS NULL OR isnan(e_km) OR isnan(n_km)"
    plain = lambda rows: rows.select("t", "id", F.col("e_km").alias("_e"), F.col("n_km").alias("_n"), "_v")
    lowest = F.row_number().over(Window.partitionBy("t").orderBy("id"))
    parts = [
        best(asked.where(f"NOT ({nowhere})").join(full, "t", "left_anti").join(F.broadcast(plain(kept.join(full, "t", "left_anti"))), "t").select("_q", d2, "id", "_v")),
        best(asked.where(nowhere).join(F.broadcast(plain(kept.withColumn("_r", lowest).where(F.col("_r") <= k))), "t").select("_q", F.lit(None).cast("double").alias("d2"), "id", "_v")),
    ]
    todo = written(asked.where(f"NOT ({nowhere})").join(full, "t", "left_semi").select("_q", "t", "e_km", "n_km"))
    ends = [f(c) for c in ("e_km", "n_km") for f in (F.min, F.max)]
    box = placed.agg(F.min("_e"), F.max("_e"), F.min("_n"), F.max("_n"), F.count("*"), F.countDistinct("t")).first()
    span = max(float(box[1] - box[0]), float(box[3] - box[2]), 1e-9) if box[4] else 1.0
    width = 2 * span * min(1.0, (k * max(1, box[5]) / max(1, box[4])) ** 0.5)
    reach = max(span, *(abs(float(x)) for x in [*todo.agg(*ends).first(), *box[:4]] if x is not None)) if box[4] else span
    while not todo.isEmpty():
        cell = lambda c, w=width: F.floor(c / w)
        around = F.explode(F.array(*(F.struct((cell(F.col("e_km")) + i).alias("i"), (cell(F.col("n_km")) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("_c")
        near = todo.select("*", around).select("_q", "t", "e_km", "n_km", "_c.i", "_c.j").join(placed.withColumn("i", cell(F.col("_e"))).withColumn("j", cell(F.col("_n"))), ["t", "i", "j"])
        found, last = best(near.select("_q", d2, "id", "_v")), width >= 4 * reach
        if not last:
            mine = Window.partitionBy("_q")
            found = found.withColumns({"_k": F.count("*").over(mine), "_far": F.max("d2").over(mine)}).where((F.col("_k") == k) & (F.col("_far") <= width * width))
        parts.append(written(found.select("_q", "d2", "id", "_v")))
        if last:
            break
        todo = written(todo.join(parts[-1].select("_q").distinct(), "_q", "left_anti"))
        width *= 2
    means = None
    for p in parts:
        one = p.groupBy("_q").agg(F.avg("_v").alias(value))
        means = one if means is None else means.unionByName(one)
    return asked.select("_q", key, "t").join(means.hint("merge"), "_q").select(key, "t", value).where(F.col(value).isNotNull())


def knot_covariates(data: DataFrame, value: str = "val", fun: Callable[[Column], Column] = F.avg) -> DataFrame:
    """x, t, mean (or another aggregate) over rows; where a knot has none in a step, that over all steps.  Rows are read once."""
    from seamark.operators.lineage import written

    each = written(data.groupingSets([["x", "t"], ["x"]], "x", "t").agg(fun(value).alias("m"), F.grouping("t").alias("_all")))
    by, over = each.where("_all = 0").select("x", "t", "m"), each.where("_all = 1").select("x", F.col("m").alias("all"))
    dense = by.select("x").distinct().join(F.broadcast(by.select("t").distinct()))
    return dense.join(by, ["x", "t"], "left").join(over, "x").select("x", "t", F.coalesce("m", "all").alias(value))


def variance_lost(data: DataFrame, value: str = "val") -> DataFrame:
    """1 - variance of the knot means laid on the rows / variance of the rows.

    Rows are folded once into the counts, means and variances of knots and steps, from which both follow.
    """
    from seamark.operators.lineage import written

    each = written(data.where("x IS NOT NULL AND t IS NOT NULL").groupBy("x", "t").agg(F.count("*").alias("n"), F.count(value).alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("k > 0"))
    whole = each.agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_over_n"), (F.sum(F.col("k") * F.col("m")) / F.sum("k")).alias("_over_k"))
    gap = lambda c: (F.col("m") - F.col(c)) * (F.col("m") - F.col(c))
    means = F.try_divide(F.sum(F.col("n") * gap("_over_n")), F.max("_n") - 1)
    values = F.try_divide(F.sum(F.col("k") * (F.col("v") + gap("_over_k"))), F.max("_k") - 1)
    return each.join(F.broadcast(whole)).agg((1 - F.try_divide(means, values)).alias("lost"))


def design(df: DataFrame, formula: str) -> tuple[DataFrame, list[str]]:
    """Model columns of a formula ~ a + b + a:b + I(a^2) + factor(c); treatment contrasts, the intercept dropped."""
    import re

    terms = [t.strip() for t in formula.lstrip("~ ").split("+") if t.strip() not in ("", "0", "1")]
    made: dict[str, list[tuple[str, Column]]] = {}

    def columns(term: str) -> list[tuple[str, Column]]:
        if term in made:
            return made[term]
        if ":" in term:
            out = [("1", F.lit(1.0))]
            for part in term.split(":"):
                out = [(f"{n}:{m}" if n != "1" else m, a * b) for n, a in out for m, b in columns(part.strip())]
        elif m := re.fullmatch(r"I\((\w+)\^(\d+)\)", term):
            out = [(term, F.pow(F.col(m[1]).cast("double"), F.lit(float(m[2]))))]
        elif (m := re.fullmatch(r"factor\((\w+)\)", term)) or df.schema[term].dataType.simpleString() == "string":
            name = m[1] if m else term
            levels = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).limit(1001).collect()]
            if len(levels) > 1000:
                raise ValueError(f"{name} has over 1000 levels")
            out = [(f"{term}{v}", (F.col(name) == v).cast("double")) for v in levels[1:]]
        else:
            out = [(term, F.col(term).cast("double"))]
        made[term] = out
        return out

    cols = [c for t in terms for c in columns(t)]
    return df.select(*(F.col(c) for c in df.columns if c not in {n for n, _ in cols}), *(c.alias(n) for n, c in cols)), [n for n, _ in cols]
