"""Sampling summaries: encounter metadata, masking, start values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense_axes(obs: DataFrame, n_c: int | None = None) -> DataFrame:
    """Every category and every time step between the first and the last, observed or not (c, t)."""
    ends = obs.agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.max("c").alias("c1"))
    top = F.col("c1") if n_c is None else F.lit(n_c - 1)
    return ends.select(F.explode(F.sequence(F.lit(0), top)).alias("c"), "t0", "t1").select("c", F.explode(F.sequence("t0", "t1")).alias("t"))


def explode_categories(obs: DataFrame, column: str = "c_iz") -> DataFrame:
    """One row for each category of an observation; arrays may hold several."""
    return obs.withColumn("c", F.explode(column)).where("c IS NOT NULL").drop(column)


def encounter_metadata(obs: DataFrame, dense: bool = True) -> DataFrame:
    """c, t, num_nonzero, num_notna, num_total, sum_posdens, prop_nonzero, mean_posdens.

    One partial aggregate over obs (c, t, a, b); null responses count in num_total alone.
    """
    got = obs.groupBy("c", "t").agg(
        F.count_if(F.col("b") > 0).alias("num_nonzero"), F.count("b").alias("num_notna"), F.count("*").alias("num_total"),
        F.sum(F.when(F.col("b") > 0, F.col("b") / F.col("a"))).alias("sum_posdens"),
    )
    if dense:
        got = F.broadcast(dense_axes(obs)).join(got, ["c", "t"], "left")  # categories times time steps
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind)).alias(c)
    got = got.select("c", "t", zero("num_nonzero", "bigint"), zero("num_notna", "bigint"), zero("num_total", "bigint"), zero("sum_posdens", "double"))
    return got.withColumn("prop_nonzero", F.try_divide("num_nonzero", "num_total")).withColumn("mean_posdens", F.try_divide("sum_posdens", "num_nonzero"))


def null_all_zero(obs: DataFrame) -> DataFrame:
    """Responses of a category and time step without any positive one become null."""
    seen = F.broadcast(encounter_metadata(obs, dense=False).select("c", "t", "num_nonzero"))
    return obs.join(seen, ["c", "t"]).withColumn("b", F.when(F.col("num_nonzero") > 0, F.col("b"))).drop("num_nonzero")


def start_values(metadata: DataFrame) -> DataFrame:
    """c, t, beta1, beta2: shrunk logit of the encounter rate and log mean positive density, +-20 where all or none are positive."""
    p = F.col("prop_nonzero")
    beta1 = F.when(p == 0, -20.0).when(p == 1, 20.0).otherwise(F.ln((0.01 + 0.98 * p) / (1 - (0.01 + 0.98 * p))))
    return metadata.select("c", "t", F.when(p.isNotNull(), beta1).alias("beta1"), F.when(F.col("mean_posdens") > 0, F.ln("mean_posdens")).alias("beta2"))


def exact_intercepts(metadata: DataFrame) -> DataFrame:
    """c, t, beta1, beta2 of the fit with yearly intercepts alone, in closed form; null where nothing is observed."""
    p = F.col("prop_nonzero")
    return metadata.select("c", "t", F.when((p > 0) & (p < 1), F.ln(p / (1 - p))).alias("beta1"), F.when(F.col("mean_posdens") > 0, F.ln("mean_posdens")).alias("beta2"))


def mask_unsampled(values: DataFrame, metadata: DataFrame, column: str, as_zero: bool) -> DataFrame:
    """Set values of (c, t) without responses to 0 or null."""
    seen = F.broadcast(metadata.select("c", "t", "num_notna"))
    other = F.lit(0.0) if as_zero else F.lit(None).cast("double")
    return values.join(seen, ["c", "t"], "left").withColumn(column, F.when(F.coalesce("num_notna", F.lit(0)) > 0, F.col(column)).otherwise(other)).drop("num_notna")


def vessel_codes(obs: DataFrame, vessel: str = "v") -> DataFrame:
    """Dense codes from 0 by a table of the different vessels; nulls stay null."""
    from pyspark.sql import Window

    codes = obs.where(F.col(vessel).isNotNull()).select(vessel).distinct().withColumn("v_code", F.row_number().over(Window.orderBy(vessel)) - 1)
    return obs.join(codes, vessel, "left")


def holdout_scores(obs: DataFrame, nll: Column, flag: str = "pred_tf") -> DataFrame:
    """Sums of the negative log likelihood inside and outside the fit, and counts."""
    inside = F.coalesce(F.col(flag), F.lit(0)) == 0
    return obs.agg(F.sum(F.when(inside, nll)).alias("jnll"), F.sum(F.when(~inside, nll)).alias("pred_jnll"), F.count_if(inside).alias("n_fit"), F.count_if(~inside).alias("n_holdout"))


def validate(obs: DataFrame, link: int = 0) -> list[str]:
    """What is wrong with the observations for a model with yearly intercepts; empty if nothing is. One pass."""
    found = []
    one = obs.agg(F.count_if(~F.coalesce(F.col("a") > 0, F.lit(False))).alias("bad_area"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.countDistinct("c").alias("nc")).first()
    if one.bad_area:
        found.append(f"{one.bad_area} rows without positive area")
    if one.nc and (one.c0 != 0 or one.nc != one.c1 + 1):
        found.append("categories must run from 0 without gaps")
    meta = encounter_metadata(obs, dense=False)
    if link in (0, 1) and not meta.where("prop_nonzero = 1").isEmpty():
        found.append("a category and time step has positive responses alone")
    if link in (0, 1, 3, 4) and not meta.where("prop_nonzero = 0").isEmpty():
        found.append("a category and time step has no positive response")
    return found
