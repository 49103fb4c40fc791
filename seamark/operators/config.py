"""What a model's settings mean: field structures, temporal structures, distributions, options; and what is wrong with them."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.operators.estimate import field_rank

FIELDS = ("Omega", "Epsilon", "Beta", "Epsilon_time")
#: Options by name, in the order in which they are numbered (fixed values).
OPTIONS = {
    "SD_site_density": False, "SD_site_logdensity": False, "Calculate_Range": False, "SD_observation_density": False, "Calculate_effective_area": False, "Calculate_Cov_SE": False,
    "Calculate_Synchrony": False, "Calculate_Coherence": False, "Calculate_proportion": False, "normalize_GMRF_in_CPP": True, "Calculate_Fratio": False, "Estimate_B0": False,
    "Project_factors": False, "treat_nonencounter_as_zero": False, "simulate_random_effects": True, "observation_error_as_CV": True, "report_additional_variables": False,
    "zerosum_penalty": 0, "EOF_unity_trace": 0, "basin_method": 2, "lagrange_multiplier": 50, "range_fraction": 0.2,
}
#: Codes of the distribution and the link that exist (fixed values).
DISTRIBUTIONS, LINKS, BIOMASS = (0, 1, 2, 4, 5, 7, 9, 10, 11, 12, 13, 14), (0, 1, 2, 3, 4), (0, 1, 2, 3, 4, 9)
#: Temporal structures that each part may have (fixed values).
RHO = {"Beta1": (0, 1, 2, 3, 4, 5), "Beta2": (0, 1, 2, 3, 4, 5, 6), "Epsilon1": (0, 1, 2, 4, 5), "Epsilon2": (0, 1, 2, 4, 5, 6)}
METHODS = ("Mesh", "Grid", "Stream_network", "Barrier")


def options(given: dict | None = None) -> dict:
    """All options in order; given ones are matched without regard to case, unknown ones are ignored."""
    lower = {k.lower(): v for k, v in (given or {}).items()}
    return {k: lower.get(k.lower(), v) for k, v in OPTIONS.items()}


def field_config(given, n_c: int, n_t: int) -> list[tuple[str, int, int]]:
    """(field, component, code) of a 4 by 2 configuration.

    Four values in a row are Omega and Epsilon by component with independent intercepts; three rows lack
    Epsilon_time, which is then the identity.  Ranks go up to n_c, in the last row to n_t.
    """
    rows = [list(r) if isinstance(r, (list, tuple)) else r for r in given]
    if len(rows) == 4 and not any(isinstance(r, list) for r in rows):
        rows = [[rows[0], rows[2]], [rows[1], rows[3]], ["IID", "IID"]]
    if len(rows) == 3:
        rows.append(["Identity", "Identity"])
    if len(rows) != 4 or any(not isinstance(r, list) or len(r) != 2 for r in rows):
        raise ValueError("a field configuration has four rows of two")
    full = lambda v: n_c if isinstance(v, str) and v.lower() == "full" else v
    return [(name, k + 1, field_rank(full(value), n_t if name == "Epsilon_time" else n_c)) for name, row in zip(FIELDS, rows) for k, value in enumerate(row)]


def rho_terms(config: tuple[int, int, int, int]) -> list[tuple[str, int, str, bool, bool, bool]]:
    """(part, code, effects, variance, correlation, by_category): what each part's temporal structure estimates.

    effects: fixed (one a step), constant (one for all steps) or random; code 6 takes what the first component has.
    """
    names = list(RHO)
    out = []
    for k, (name, code) in enumerate(zip(names, config)):
        if code not in RHO[name]:
            raise ValueError(f"{name} cannot be {code}")
        own = config[k - 1] if code == 6 else code
        effects = {0: "fixed", 3: "constant"}.get(own, "random")
        if name.startswith("Epsilon"):
            effects = "random"  # fields are random in every structure; 0 only makes them independent
        out.append((name, code, effects, code != 6 and effects == "random", code != 6 and own in (4, 5), code != 6 and own == 5))
    return out


@dataclass(frozen=True)
class Model:
    """What the rules look at; obs_model: (distribution, link) for each group of errors."""

    obs_model: tuple[tuple[int, int], ...] = ((2, 1),)
    field: tuple = ((1, 1), (1, 1), ("IID", "IID"))
    rho: tuple[int, int, int, int] = (0, 0, 0, 0)
    overdispersion: tuple[int, int] = (0, 0)
    n_c: int = 1
    n_t: int = 1
    yearbounds: tuple[tuple[int, int], ...] = ()
    overlaps: tuple[tuple, ...] = ()
    method: str = "Mesh"
    columns_of_c: int = 1
    options: dict = dataclasses.field(default_factory=dict)


def broken_settings(m: Model) -> list[str]:
    """Names of the rules that settings alone break."""
    out, links, kinds = [], [b for _, b in m.obs_model], [a for a, _ in m.obs_model]
    opt = options(m.options)
    rule = lambda bad, name: out.append(name) if bad else None
    rule(any(k not in DISTRIBUTIONS for k in kinds), "unknown distribution")
    rule(any(k not in LINKS for k in links), "unknown link")
    rule(len(set(links)) > 1, "more than one link")
    rule(any(k in (12, 13, 14) for k in kinds) and any(k != 1 for k in links), "counts need the Poisson link")
    rule(any(k in (12, 13, 14) for k in kinds) and not any(k in BIOMASS for k in kinds), "counts need biomass beside them")
    rule(10 in kinds and any(k != 2 for k in links), "Tweedie needs its link")
    rule(any(code not in RHO[name] for name, code in zip(RHO, m.rho)), "unknown temporal structure")
    rule(len(m.overdispersion) != 2, "overdispersion has two parts")
    rule(any(lo < 0 or hi < 0 or lo >= m.n_t or hi >= m.n_t for lo, hi in m.yearbounds), "period outside the time steps")
    rule(any(len(o) != 7 for o in m.overlaps), "overlaps have seven columns")
    rule(any(len(o) == 7 and (max(o[0], o[2]) >= m.n_c or max(o[1], o[3]) >= m.n_t) for o in m.overlaps), "overlap outside the axes")
    rule(bool(opt["Calculate_Coherence"]) and 0 in links, "coherence needs the Poisson link")
    rule(m.columns_of_c > 1 and any(k != 1 for k in links), "several categories need the Poisson link")
    rule(m.method not in METHODS, "unknown method")
    try:
        codes = field_config(m.field, m.n_c, m.n_t)
    except (ValueError, KeyError):
        return [*out, "field configuration"]
    rule(m.n_c == 1 and any(code not in (-3, -2, -1, 1) for name, _, code in codes if name != "Epsilon_time"), "one category has no ranks")
    for k, at in ((1, 0), (2, 1)):
        eps = next(code for name, comp, code in codes if name == "Epsilon" and comp == k)
        beta = next(code for name, comp, code in codes if name == "Beta" and comp == k)
        rule(eps == -1 and m.rho[2 + at] not in (0,), f"structure of a field that is off ({k})")
        rule(beta > 0 and m.rho[at] in (0, 3), f"ranks of fixed intercepts ({k})")
    return out


def violations(obs: DataFrame, m: Model = Model()) -> DataFrame:
    """(rule, n): every broken rule and how many rows or cells break it; from two aggregates over obs (c, t, a, b, v)."""
    spark = obs.sparkSession
    links = {b for _, b in m.obs_model}
    opt = options(m.options)
    one = obs.agg(
        F.count_if(~F.coalesce(F.col("a") > 0, F.lit(False))).alias("area"), F.count_if(F.col("b").isNull()).alias("nulls"), F.count_if(F.isnan("b") | (F.abs("b") == float("inf"))).alias("odd"), F.count_if(F.col("b") < 0).alias("negative"),
        F.count_if((F.col("c") < 0) | (F.col("c") >= m.n_c)).alias("outside_c"), F.count_if((F.col("t") < 0) | (F.col("t") >= m.n_t)).alias("outside_t"), F.count_if(F.col("c").isNull()).alias("no_c"),
        F.countDistinct("c").alias("seen"), F.countDistinct("v").alias("vessels"), F.count_if(~F.coalesce(F.col("b") > 0, F.lit(False))).alias("not_positive"), F.count("*").alias("n"),
    )
    cells = obs.where("b IS NOT NULL").groupBy("c", "t").agg(F.avg((F.col("b") > 0).cast("double")).alias("p")).agg(F.count_if(F.col("p") == 1).alias("all_positive"), F.count_if(F.col("p") == 0).alias("none_positive"))
    both = one.join(F.broadcast(cells))  # one row each
    yearly = F.lit(m.rho[0] == 0)
    try:
        spatial = any(code != -1 for name, comp, code in field_config(m.field, m.n_c, m.n_t) if comp == 1 and name in ("Omega", "Epsilon"))
    except (ValueError, KeyError):
        spatial = False
    found = {
        "area must be positive": F.col("area"), "response is not finite": F.col("odd"), "response is negative": F.col("negative"), "category outside 0 to n_c - 1": F.col("outside_c"), "time step outside 0 to n_t - 1": F.col("outside_t"),
        "row without a category": F.col("no_c"), "category without rows": F.greatest(F.lit(0), F.lit(m.n_c) - F.col("seen")),
        "all encounters with yearly intercepts": F.when(yearly & F.lit(bool(links & {0, 1})), F.col("all_positive")).otherwise(0),
        "no encounters with yearly intercepts": F.when(yearly & F.lit(bool(links & {0, 1, 3, 4}) and not opt["treat_nonencounter_as_zero"]), F.col("none_positive")).otherwise(0),
        "overdispersion with one vessel": F.when(F.lit(any(x > 0 for x in m.overdispersion)) & (F.col("vessels") < 2), 1).otherwise(0),
        "all responses positive with a delta-normal field": F.when(F.lit(spatial and all(k == 0 for k, _ in m.obs_model)) & (F.col("not_positive") == 0) & (F.col("n") > 0), 1).otherwise(0),
    }
    table = both.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), c.cast("bigint").alias("n")) for k, c in found.items()))).alias("x")).select("x.*").where("n > 0")
    settings = broken_settings(m)
    return table.unionByName(spark.createDataFrame([(r, 1) for r in settings], "rule string, n bigint")) if settings else table
