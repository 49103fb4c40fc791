"""Standard errors, bias correction and draws from a fit's joint precision, and runs with effects turned off."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamark.operators.predict import add_effects, densities

#: Matrices are dense on the driver up to this many effects.
MOST_EFFECTS = 4_000
#: Entries of a covariance that are broadcast: 24 bytes each; with more, effects are many enough to be dealt by them.
BROADCAST_ENTRIES = 100_000


def dense(precision: DataFrame, n: int) -> np.ndarray:
    """The matrix of (row, col, val), rows from 0 to n - 1; entries that are not there are 0."""
    if n > MOST_EFFECTS:
        raise ValueError(f"{n} effects; at most {MOST_EFFECTS} have a dense precision")
    q = np.zeros((n, n))
    for r in precision.groupBy("row", "col").agg(F.sum("val").alias("val")).toLocalIterator():
        q[r.row, r.col] = r.val
    return q


def factor(q: np.ndarray) -> np.ndarray:
    """Lower Cholesky factor."""
    try:
        return np.linalg.cholesky(q)
    except np.linalg.LinAlgError:
        raise ValueError("the precision is not positive definite") from None


def draw_effects(spark: SparkSession, mean: np.ndarray, q: np.ndarray, n_samples: int = 100, seed: int = 123456, random: list[int] | None = None) -> DataFrame:
    """k, r, val: draws of all effects around their mean with precision q, r from 1.

    random: only these vary, given the others at their mean (their block of q is their conditional precision).
    """
    rng, some = np.random.default_rng(seed), np.arange(len(mean)) if random is None else np.array(sorted(random))
    low = factor(q[np.ix_(some, some)])
    draws = np.repeat(np.asarray(mean, float)[:, None], n_samples, axis=1)
    draws[some] += np.linalg.solve(low.T, rng.standard_normal((len(some), n_samples)))
    rows = [(k, r + 1, float(draws[k, r])) for k in range(len(mean)) for r in range(n_samples)]
    return spark.createDataFrame(rows, "k int, r int, val double")


def covariance_table(spark: SparkSession, q: np.ndarray) -> DataFrame:
    """a, b, cov: the inverse of a precision."""
    low = np.linalg.inv(factor(q))
    cov = low.T @ low
    return spark.createDataFrame([(a, b, float(cov[a, b])) for a in range(len(q)) for b in range(len(q))], "a int, b int, cov double")


def linear(design: DataFrame, effects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, eta: the sum of w times an effect's draw, for all draws at once; design: keys, k, w."""
    return design.join(effects, "k").groupBy(*keys, "r").agg(F.sum(F.col("w") * F.col("val")).alias("eta"))


def spread(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, mean, se over draws."""
    return draws.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"))


def _weights(design: DataFrame) -> DataFrame:
    """g and the array _e of (k, w), a weight for each effect.  A row has the weights of some effects, three for a mesh."""
    return design.groupBy("g", "k").agg(F.sum("w").alias("w")).groupBy("g").agg(F.collect_list(F.struct("k", "w")).alias("_e"))


def _cell_variance(held: DataFrame, covariance: DataFrame) -> DataFrame:
    """g, var: the variance of each row's sum of w times effect k; only effects of one row meet."""
    pairs = held.select("g", F.explode("_e").alias("x"), "_e").select("g", "x", F.explode("_e").alias("y"))
    met = pairs.select("g", F.col("x.k").alias("a"), F.col("y.k").alias("b"), (F.col("x.w") * F.col("y.w")).alias("_w")).join(covariance, ["a", "b"])
    return met.groupBy("g").agg(F.sum(F.col("_w") * F.col("cov")).alias("var"))


def delta_method(cells: DataFrame, design: DataFrame, covariance: DataFrame, of: tuple[str, ...] = ("c", "t", "l")) -> DataFrame:
    """of, index, se, unbiased: first-order standard errors of indices, and indices without the bias of the exponential.

    cells: of, g, index_g, log-linear in effects; design: g, k, w, the weight of effect k in the cell's log
    density; covariance: a, b, cov.  Cells are read once and merged with their weights and variance, neither of which
    is broadcast; the index, its unbiased form and the gradient are folded together, to a row for each index and
    effect, before effects meet.
    unbiased adds half the trace of covariance times curvature, the derivative by a multiplier of
    the index of a Laplace likelihood whose log density is quadratic.  Cells without design have no variance.
    """
    from seamark.operators.lineage import written

    keys = list(of)
    covariance = F.broadcast(covariance) if covariance.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES else covariance.hint("merge")
    held = written(_weights(design))
    of_cell = held.join(_cell_variance(held, covariance).hint("merge"), "g", "left")
    effect = held.schema["_e"].dataType.elementType["k"].dataType
    part = lambda kind, k, w: F.struct(F.lit(kind).alias("kind"), k.cast(effect).alias("k"), w.alias("w"))
    parts = F.concat(
        F.array(part(0, F.lit(None), F.lit(1.0)), part(1, F.lit(None), 1 + F.coalesce("var", F.lit(0.0)) / 2)),
        F.transform(F.coalesce("_e", F.array().cast(held.schema["_e"].dataType)), lambda e: part(2, e["k"], e["w"].cast("double"))),
    )
    whole = cells.select(*keys, "g", "index_g").join(of_cell.hint("merge"), "g", "left").select(*keys, "index_g", F.explode(parts).alias("x"))
    sums = written(whole.groupBy(*keys, "x.kind", "x.k").agg(F.sum(F.col("index_g") * F.col("x.w")).alias("_s")))
    total = sums.where("kind < 2").groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("_s"))).alias("index"), F.max(F.when(F.col("kind") == 1, F.col("_s"))).alias("unbiased"))
    slope = sums.where("kind = 2").select(*keys, "k", "_s")
    half = slope.withColumnRenamed("k", "a").join(covariance, "a").groupBy(*keys, "b").agg(F.sum(F.col("_s") * F.col("cov")).alias("_h"))
    square = half.join(slope.withColumnRenamed("k", "b"), [*keys, "b"]).groupBy(*keys).agg(F.sum(F.col("_h") * F.col("_s")).alias("_v"))
    return total.join(square, keys, "left").select(*keys, "index", F.sqrt(F.greatest(F.coalesce("_v", F.lit(0.0)), F.lit(0.0))).alias("se"), "unbiased")


def index_draws(cells: DataFrame, design: DataFrame, draws: DataFrame, of: tuple[str, ...] = ("c", "t", "l")) -> DataFrame:
    """of, r, index: the sum over cells (of, g, index_g) of index_g * exp(eta), with eta the sum of w times an effect's draw.

    draws: k, r, val, a driver's matrix (draw_effects), is sent to the tasks; cells are merged with their weights, and all
    draws of a batch of cells are made and summed there, so no row is multiplied by the draws.  Cells without design are left out,
    and effects without a draw count as 0.
    """
    given = draws.select("k", "r", "val").collect()  # bounded by MOST_EFFECTS and the draws
    ks, rs = sorted({x.k for x in given}), sorted({x.r for x in given})
    row, column = {k: i for i, k in enumerate(ks)}, {r: i for i, r in enumerate(rs)}
    matrix = np.zeros((len(ks) + 1, len(rs)))  # the last is for effects without a draw
    for x in given:
        matrix[row[x.k], column[x.r]] = x.val
    shared, keys = cells.sparkSession.sparkContext.broadcast((row, matrix)), list(of)
    met = cells.select(*keys, "g", F.col("index_g").cast("double")).join(_weights(design).hint("merge"), "g").where("index_g IS NOT NULL")
    met = met.select(*keys, "index_g", F.col("_e.k").alias("_k"), F.transform("_e.w", lambda w: w.cast("double")).alias("_w"))
    schema = T.StructType([*(met.schema[c] for c in keys), T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def summed(batches):
        row, matrix = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            lists, x = batch.column("_k"), batch.column("index_g").to_numpy()
            at = np.array([row.get(k, len(row)) for k in lists.flatten().to_pylist()], np.int64)
            ends = np.cumsum(np.asarray(pa.compute.list_value_length(lists)))
            starts = np.concatenate([[0], ends[:-1]])
            w = batch.column("_w").flatten().to_numpy(zero_copy_only=False)
            groups = table.select(keys).append_column("_i", pa.array(np.arange(len(x)))).group_by(keys).aggregate([("_i", "list")])
            out = []
            step = max(1, 2_000_000 // max(1, matrix.shape[1]))
            eta = np.concatenate([np.add.reduceat(w[starts[i] : ends[min(i + step, len(x)) - 1], None] * matrix[at[starts[i] : ends[min(i + step, len(x)) - 1]]], starts[i : i + step] - starts[i]) for i in range(0, len(x), step)]) if len(x) else np.zeros((0, matrix.shape[1]))
            np.exp(eta, out=eta)
            for i in groups.column("_i_list").to_pylist():
                out.append(x[i] @ eta[i])
            yield pa.RecordBatch.from_arrays([*(groups.column(k).combine_chunks() for k in keys), pa.array(out, pa.list_(pa.float64()))], names=[*keys, "_sums"])

    sums = met.mapInArrow(summed, schema)
    spread_out = sums.select(*keys, F.posexplode("_sums").alias("_j", "_v")).groupBy(*keys, "_j").agg(F.sum("_v").alias("index"))
    return spread_out.select(*keys, F.element_at(F.array(*map(F.lit, rs)), F.col("_j") + 1).alias("r"), "index")


def counterfactual(rows: DataFrame, first: dict[str, tuple[DataFrame, list[str]]], second: dict[str, tuple[DataFrame, list[str]]], off: set[str] = frozenset(), link: int = 0) -> DataFrame:
    """rows with r1, r2 and d as they would be without the effects named in off.

    first, second: the predictors' effects by name, each a table (its keys and val) and its keys.
    """
    if unknown := set(off) - set(first) - set(second):
        raise ValueError(f"no effect is named {', '.join(sorted(unknown))}")
    kept = lambda effects: [e for name, e in effects.items() if name not in off]
    return densities(add_effects(add_effects(rows, kept(first), "p1"), kept(second), "p2"), link)


# interactions of categories
def interaction(method: int, chi: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, float]:
    """(interactions among factors, penalty) of chi and psi, factors by rank.

    0: none; 1: their product; 2: a product whose eigenvalues are the diagonal of psi, and so real, with
    the lengths of chi's columns penalised away from 1.
    """
    n, rank = chi.shape
    if method == 0:
        return np.zeros((n, n)), 0.0
    if method == 1:
        return chi @ psi.T, 0.0
    if method != 2:
        raise ValueError(f"interactions of kind {method}")
    squared = (chi**2).sum(axis=0)
    left, right, values = np.eye(n), np.eye(n), np.zeros(n)
    left[:, :rank] = chi / np.sqrt(squared)
    right[rank:, :rank] = psi[rank:]
    values[:rank] = np.diag(psi[:rank])
    basis = left @ right.T
    return np.linalg.solve(basis.T, (basis * values).T).T, float((np.log(squared) ** 2).sum())


def category_interaction(b: np.ndarray, rho: np.ndarray, loading: np.ndarray | None = None) -> np.ndarray:
    """Interactions with each factor's own autocorrelation; among categories where factors' loadings are given."""
    own = b + np.diag(rho)
    return own if loading is None else np.linalg.solve(loading.T, (loading @ own).T).T


def stationary_variance(b: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """V with V = B V B' + cov."""
    n = len(b)
    return np.linalg.solve(np.eye(n * n) - np.kron(b, b), cov.ravel()).reshape(n, n)


def target_mortality(mortality: DataFrame, b: np.ndarray, share: float = 0.4) -> DataFrame:
    """c, t, f, target, ratio: mortality (c, t, f) over that which leaves this share of the unfished state."""
    target = -(np.eye(len(b)) - b) @ np.full(len(b), np.log(share))
    table = mortality.sparkSession.createDataFrame([(c, float(x)) for c, x in enumerate(target)], "c int, target double")
    return mortality.join(F.broadcast(table), "c").select("c", "t", "f", "target", (F.col("f") / F.col("target")).alias("ratio"))


def category_impact(mortality: DataFrame, b: np.ndarray, start: int = 1) -> DataFrame:
    """c, t, impact: what mortality (c, t, f) of this and earlier steps takes from each category, through interactions b.

    start: 1 begins with the first step's mortality, 2 with the state that it would lead to in the
    long run, 0 leaves it out.  One row for each step goes into one fold, so bounded by the model's axes.
    """
    n = len(b)
    if start == 0:
        return mortality.select("c", "t", F.lit(0.0).alias("impact"))
    first = np.eye(n) if start == 1 else np.linalg.inv(np.eye(n) - b)
    steps = mortality.groupBy("t").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("c") == c, F.col("f"))), F.lit(0.0)) for c in range(n))).alias("f"))
    line = steps.agg(F.array_sort(F.collect_list(F.struct("t", "f"))).alias("x"))
    apply = lambda m, v: [sum((F.lit(float(m[c, j])) * F.get(v, F.lit(j)) for j in range(n)), F.lit(0.0)) for c in range(n)]
    begin = F.array(F.struct(F.get("x", F.lit(0))["t"].alias("t"), F.array(*(-e for e in apply(first, F.get("x", F.lit(0))["f"]))).alias("v")))

    def on(acc: Column, x: Column) -> Column:
        moved = apply(b, F.element_at(acc, -1)["v"])
        return F.concat(acc, F.array(F.struct(x["t"].alias("t"), F.array(*(m - F.get(x["f"], F.lit(c)) for c, m in enumerate(moved))).alias("v"))))

    path = line.where("size(x) > 0").select(F.explode(F.aggregate(F.slice("x", F.lit(2), F.size("x")), begin, on)).alias("s"))
    return path.select(F.col("s.t").alias("t"), F.posexplode("s.v").alias("c", "impact")).select("c", "t", "impact")


# density dependence
def centred_response(intercepts: DataFrame, field: DataFrame | None = None, weight: DataFrame | None = None) -> DataFrame:
    """c, t, x: what stands for density in a category and step.

    intercepts: c, t, val (the sum of both predictors', or a multiplier), less their mean over steps.  field: s, c,
    t, val, whose mean over places is added; weight: s, c, val, logs of weights for this mean.
    """
    mean = intercepts.groupBy("c").agg(F.avg("val").alias("_m"))
    x = intercepts.join(F.broadcast(mean), "c").select("c", "t", (F.col("val") - F.col("_m")).alias("x"))
    if field is None:
        return x
    rows = field.withColumn("_w", F.lit(1.0)) if weight is None else field.join(weight.select("s", "c", F.exp("val").alias("_w")), ["s", "c"])
    added = rows.groupBy("c", "t").agg((F.sum(F.col("val") * F.col("_w")) / F.sum("_w")).alias("_a"))
    return x.join(F.broadcast(added), ["c", "t"], "left").select("c", "t", (F.col("x") + F.coalesce("_a", F.lit(0.0))).alias("x"))


def lagrange_penalty(multiplier: DataFrame, index: DataFrame, scale: float, categories: Column | None = None) -> DataFrame:
    """c, nll: scale times the squares of multiplier (c, t, val) less the log of index (c, t, index), over the steps."""
    rows = multiplier if categories is None else multiplier.where(categories)
    return rows.join(index.select("c", "t", "index"), ["c", "t"]).groupBy("c").agg((F.lit(scale) * F.sum(F.pow(F.col("val") - F.ln("index"), 2))).alias("nll"))
