"""The tables behind figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Variables that a map can show: number to name and the SQL of their value over densities (g, c, t, r1, r2, d) and their total over categories.
MAPS = {1: ("encounter_prob", "r1"), 2: ("pos_catch", "ln(r2)"), 3: ("ln_density", "ln(d)"), 13: ("total_density", "ln(total)")}
#: Numbers that stand for effect tables of the same name (g, c, t, val).
EFFECTS = {6: "epsilon_1", 7: "epsilon_2", 11: "covariates_1", 12: "covariates_2", 14: "covariate_effects_1", 15: "covariate_effects_2", 16: "omega_1", 17: "omega_2", 18: "xi_1", 19: "xi_2", 20: "phi_1", 21: "phi_2"}
GONE = (4, 5, 8, 9, 10)


def map_table(density: DataFrame, numbers: list[int], effects: dict[str, DataFrame] | None = None) -> DataFrame:
    """variable, g, c, t, value of the numbered variables; numbers that stand for nothing any more are an error."""
    gone = [n for n in numbers if n in GONE or n not in MAPS and n not in EFFECTS]
    if gone:
        raise ValueError(f"no variable has the numbers {gone}")
    wanted = [MAPS[n] for n in numbers if n in MAPS]
    if 13 in numbers:
        density = density.withColumn("total", F.sum("d").over(Window.partitionBy("g", "t")))  # a row for each category
    out = density.select("g", "c", "t", F.explode(F.array(*(F.struct(F.lit(name).alias("variable"), F.expr(sql).cast("double").alias("value")) for name, sql in wanted))).alias("x")).select("x.variable", "g", "c", "t", "x.value") if wanted else None
    for name in (EFFECTS[n] for n in numbers if n in EFFECTS):
        if name not in (effects or {}):
            raise ValueError(f"the fit has no {name}")
        part = effects[name].select(F.lit(name).alias("variable"), "g", "c", "t", F.col("val").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def data_tables(obs: DataFrame, knots: DataFrame, cells: DataFrame) -> DataFrame:
    """kind, t, e_km, n_km, n: samples by place and year, knots and grid cells, as they are drawn."""
    place = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("t"), "e_km", "n_km", F.lit(1).cast("bigint").alias("n"))
    samples = obs.groupBy(F.col("t").cast("int").alias("t"), "e_km", "n_km").agg(F.count("*").alias("n")).select(F.lit("sample").alias("kind"), "t", "e_km", "n_km", "n")
    return samples.unionByName(place(knots, "knot")).unionByName(place(cells, "cell"))


def results(tables: dict[str, DataFrame], base: str) -> list[str]:
    """Write each table under base by its name, as a run of all reports does; gives the paths."""
    paths = []
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{base.rstrip('/')}/{name}")
        paths.append(f"{base.rstrip('/')}/{name}")
    return paths
