"""Area-expanded indices and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def cell_areas(rows: DataFrame, cell_area: DataFrame) -> DataFrame:
    """rows (g) for every stratum that holds their cell, with l and area.  Areas are as many as cells, so they are merged, not broadcast."""
    return rows.join(cell_area.select("g", "l", "area").hint("merge"), "g")


def cell_index(density: DataFrame, cell_area: DataFrame) -> DataFrame:
    """g, c, t, l, d, area, index_g."""
    return cell_areas(density, cell_area).withColumn("index_g", F.col("d") * F.col("area"))


def index(cells: DataFrame) -> DataFrame:
    """c, t, l, index: the sum of density times area over cells."""
    return cells.groupBy("c", "t", "l").agg(F.sum("index_g").alias("index"))


def expanded_index(cells: DataFrame, expansion: list[tuple[int, int]]) -> DataFrame:
    """c, t, l, index with each category's own mode; expansion: (mode, reference category) by category.

    0 area; 1 abundance of the reference category; 2 its share, a weighted mean; 3 area plus the
    reference's; 4 the share among categories of mode 4 times the reference's.  References are smaller than
    their category, so categories are made in order: all of a cell's stand in one row, no join for each is needed.
    """
    n = len(expansion)
    for c, (mode, ref) in enumerate(expansion):
        if mode and not 0 <= ref < c:
            raise ValueError(f"category {c} must refer to a smaller one")
    wide = cells.groupBy("g", "t", "l").agg(F.max("area").alias("area"), *(F.sum(F.when(F.col("c") == c, F.col("d"))).alias(f"d{c}") for c in range(n)))
    shared = sum((F.col(f"d{c}") for c, (m, _) in enumerate(expansion) if m == 4), F.lit(0.0))
    for c, (mode, ref) in enumerate(expansion):
        d, r = F.col(f"d{c}"), F.col(f"i{ref}") if mode else None
        if mode == 0:
            value = d * F.col("area")
        elif mode == 1:
            value = d * r
        elif mode == 2:
            value = d * r  # over the reference's total, below
        elif mode == 3:
            value = d * F.col("area") + r
        elif mode == 4:
            value = d / shared * r
        else:
            raise ValueError(f"mode {mode}")
        wide = wide.withColumn(f"i{c}", value)
        if mode == 2:
            if f"_total{ref}" not in wide.columns:
                total = wide.groupBy("t", "l").agg(F.sum(f"i{ref}").alias(f"_total{ref}"))  # a row for each time and stratum
                wide = wide.join(F.broadcast(total), ["t", "l"])
            wide = wide.withColumn(f"i{c}", F.col(f"i{c}") / F.col(f"_total{ref}"))
    sums = wide.groupBy("t", "l").agg(*(F.sum(f"i{c}").alias(f"i{c}") for c in range(n)))
    return sums.select("t", "l", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"i{c}").alias("index")) for c in range(n)))).alias("x")).select("x.c", "t", "l", "x.index")


def centre_of_gravity(cells: DataFrame, axes: tuple[str, ...] = ("e_km", "n_km"), stratum: str | None = None) -> DataFrame:
    """c, t, m, z: abundance-weighted mean coordinate; cells with the axes, of one stratum."""
    rows = cells if stratum is None else cells.where(F.col("l") == stratum)
    sums = rows.groupBy("c", "t").agg(F.sum("index_g").alias("w"), *(F.sum(F.col(a) * F.col("index_g")).alias(a) for a in axes))
    return sums.select("c", "t", F.explode(F.array(*(F.struct(F.lit(m).alias("m"), (F.col(a) / F.col("w")).alias("z")) for m, a in enumerate(axes)))).alias("x")).select("c", "t", "x.m", "x.z")


def effective_area(cells: DataFrame) -> DataFrame:
    """c, t, l, mean_d, effective_area: abundance-weighted density, and abundance over it."""
    got = cells.groupBy("c", "t", "l").agg(F.sum("index_g").alias("i"), F.sum(F.col("d") * F.col("index_g")).alias("s"))
    return got.select("c", "t", "l", (F.col("s") / F.col("i")).alias("mean_d"), (F.col("i") * F.col("i") / F.col("s")).alias("effective_area"))


def biomass_ratio(idx: DataFrame) -> DataFrame:
    """Each index over that of the first time step."""
    first = idx.groupBy("c", "l").agg(F.min_by("index", "t").alias("_first"))
    return idx.join(F.broadcast(first), ["c", "l"]).select("c", "t", "l", (F.col("index") / F.col("_first")).alias("ratio"))


def category_share(idx: DataFrame) -> DataFrame:
    w = Window.partitionBy("t", "l")
    return idx.select("c", "t", "l", (F.col("index") / F.sum("index").over(w)).alias("share"))


def composition(idx: DataFrame) -> DataFrame:
    """t, l, c, prop, var_prop, neff from index and its standard error (columns index, se; independent categories).

    The variance is the delta method's, 0 for an absent category; neff is P (1 - P) / var; with the median over categories.
    """
    w = Window.partitionBy("t", "l")
    got = idx.withColumns({"_i": F.sum("index").over(w), "_v": F.sum(F.col("se") * F.col("se")).over(w)})
    p = F.col("index") / F.col("_i")
    v = F.col("se") * F.col("se")
    var = F.when(F.col("index") == 0, 0.0).otherwise(p * p * (v / (F.col("index") * F.col("index")) - 2 * v / (F.col("index") * F.col("_i")) + F.col("_v") / (F.col("_i") * F.col("_i"))))
    out = got.withColumns({"prop": p, "var_prop": var}).withColumn("neff", F.try_divide(F.col("prop") * (1 - F.col("prop")), F.col("var_prop")))
    return out.withColumn("neff_median", F.median("neff").over(w)).select("c", "t", "l", "prop", "var_prop", "neff", "neff_median")


def mean_category(idx: DataFrame, weight: str = "c") -> DataFrame:
    """t, l: the mean category and its standard deviation, weighted by proportion."""
    s = F.sum("index")
    got = idx.groupBy("t", "l").agg((F.sum(F.col(weight) * F.col("index")) / s).alias("mean_c"), (F.sum(F.col(weight) * F.col(weight) * F.col("index")) / s).alias("m2"))
    return got.select("t", "l", "mean_c", F.sqrt(F.greatest(F.col("m2") - F.col("mean_c") * F.col("mean_c"), F.lit(0.0))).alias("sd_c"))


def index_table(idx: DataFrame, names: list[str], units: str = "kg") -> DataFrame:
    """Category, Time, Stratum, Units, Estimate, and standard errors where idx has se."""
    label = F.element_at(F.array(*map(F.lit, names)), F.col("c") + 1)
    se = F.col("se") if "se" in idx.columns else F.lit(None).cast("double")
    return idx.select(label.alias("Category"), F.col("t").alias("Time"), F.col("l").alias("Stratum"), F.lit(units).alias("Units"), F.col("index").alias("Estimate"), se.alias("SE"), (se / F.col("index")).alias("SE_ln"))


def index_pairs(estimates: DataFrame, replicate: str = "r") -> DataFrame:
    """idx1 >= idx2 and their covariance over replicates (columns idx, r, val): the lower triangle."""
    a, b = estimates.alias("a"), estimates.alias("b")
    pairs = a.join(b, (F.col(f"a.{replicate}") == F.col(f"b.{replicate}")) & (F.col("a.idx") >= F.col("b.idx")))
    return pairs.groupBy(F.col("a.idx").alias("idx1"), F.col("b.idx").alias("idx2")).agg(F.covar_samp("a.val", "b.val").alias("cov"))


def interval(y: str, se: str, k: float = 1.0, log: bool = False) -> tuple:
    """Lower and upper bound."""
    if log:
        return F.col(y) * F.exp(-k * F.col(se)), F.col(y) * F.exp(k * F.col(se))
    return F.col(y) - k * F.col(se), F.col(y) + k * F.col(se)
