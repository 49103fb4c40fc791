"""Settings, fits, prediction, simulation, forecasts, clustering and rotation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """What a model is made of; see make_settings for presets."""

    n_x: int = 100
    purpose: str = "index"
    field_config: tuple = (("IID", "IID"), ("IID", "IID"), ("IID", "IID"))
    rho_config: tuple[int, int, int, int] = (0, 0, 0, 0)
    overdispersion: tuple[int, int] = (0, 0)
    obs_model: tuple[int, int] = (2, 1)
    bias_correct: bool = True
    knot_method: str = "grid"
    max_cells: float = math.inf
    zero_non_encounters: bool = True
    options: dict = field(default_factory=dict)

    def with_overrides(self, **given) -> Settings:
        """Call over settings over defaults; options merge by name without regard to case."""
        options = {k.lower(): v for k, v in self.options.items()} | {k.lower(): v for k, v in given.pop("options", {}).items()}
        return replace(self, options=options, **given)


def make_settings(n_x: int, purpose: str = "index2", n_categories: int | None = None, **given) -> Settings:
    """Presets by purpose; an unknown purpose is an error, as is a missing number of categories where one is needed."""
    purpose = purpose.lower()
    coarse = max(2000, 10 * n_x)
    base = Settings(n_x=n_x, purpose=purpose)
    if purpose == "index":
        out = replace(base, knot_method="samples", max_cells=math.inf)
    elif purpose in ("index2", "index3"):
        out = replace(base, max_cells=coarse)
    elif purpose == "condition_and_density":
        out = replace(base, field_config=((2, 0), (2, 0), ("IID", "IID")), obs_model=(1, 4), knot_method="samples", zero_non_encounters=False)
    elif purpose in ("mice", "interactions", "ordination", "eof", "eof2", "eof3"):
        if n_categories is None:
            raise ValueError(f"{purpose} needs n_categories")
        if purpose in ("mice", "interactions"):
            out = replace(base, field_config=((n_categories,) * 2, (n_categories,) * 2, ("IID", "IID")), rho_config=(3, 3, 4, 6), obs_model=(1, 1), knot_method="samples")
        elif purpose == "ordination":
            out = replace(base, field_config=((n_categories,) * 2, (n_categories,) * 2, ("IID", "IID")), rho_config=(0, 0, 0, 0), obs_model=(1, 1), bias_correct=False, knot_method="samples")
        else:
            out = replace(base, field_config=((0, 0), (n_categories, 0), ("IID", "IID")), obs_model=(1, 1), bias_correct=False, max_cells=math.inf if purpose == "eof" else coarse, knot_method="samples" if purpose == "eof" else "grid")
    else:
        raise ValueError(f"unknown purpose {purpose!r}")
    return out.with_overrides(**given) if given else out


def field_rank(value, n: int) -> int:
    """The number behind a field's name: AR1 0, IID -2, Identity -3, none (0) -1, full n, else its rank."""
    names = {"AR1": 0, "IID": -2, "IDENTITY": -3, "FULL": n}
    if isinstance(value, str):
        return names[value.upper()]
    if value == 0:
        return -1
    if not 1 <= value <= n:
        raise ValueError(f"rank {value} is not between 1 and {n}")
    return int(value)


# fits of fixed effects
def fit_binomial(rows: DataFrame, features: list[str]) -> tuple[float, dict[str, float], float]:
    """Logit fit of encounter (column y): (intercept, coefficients, negative log likelihood)."""
    return _glm(rows, features, "binomial", "logit")


def fit_gamma(rows: DataFrame, features: list[str], offset: str | None = None) -> tuple[float, dict[str, float], float]:
    return _glm(rows, features, "gamma", "log", offset)


def _glm(rows, features, family, link, offset=None):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    data = VectorAssembler(inputCols=features, outputCol="_x").transform(rows) if features else rows.withColumn("_x", _no_features())
    glm = GeneralizedLinearRegression(family=family, link=link, labelCol="y", featuresCol="_x", maxIter=50, tol=1e-10, **({"offsetCol": offset} if offset else {}))
    model = glm.fit(data)
    return model.intercept, dict(zip(features, map(float, model.coefficients))), model.summary.deviance / 2


def _no_features():
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.array(F.lit(0.0)))


def fit_lognormal(rows: DataFrame, features: list[str]) -> tuple[float, dict[str, float], float]:
    """Least squares of ln y on the features by sums in one pass: (intercept for the mean, coefficients, sigma).

    The mean's intercept exceeds the log scale's by sigma^2 / 2.
    """
    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    y = F.ln("y")
    k = len(x)
    sums = rows.agg(*(F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(x[i] * y).alias(f"y{i}") for i in range(k)), F.sum(y * y).alias("yy"), F.count(y).alias("n")).first()
    xx = np.array([[sums[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    xy = np.array([sums[f"y{i}"] for i in range(k)])
    beta = np.linalg.solve(xx, xy)
    sigma2 = max(0.0, (sums.yy - beta @ xy) / sums.n)
    return float(beta[0] + sigma2 / 2), dict(zip(features, map(float, beta[1:]))), math.sqrt(sigma2)


def precision_lattice(m0: np.ndarray, m1: np.ndarray, m2: np.ndarray, rho: float) -> np.ndarray:
    return m0 * (1 + rho**2) ** 2 - m1 * (1 + rho**2) * rho + m2 * rho**2


def gmrf_nll(x: np.ndarray, q: np.ndarray) -> float:
    """Negative log density of a Gaussian Markov random field; dense, for some thousand vertices."""
    sign, logdet = np.linalg.slogdet(q)
    if sign <= 0:
        raise ValueError("the precision is not positive definite")
    return float(0.5 * x @ q @ x - 0.5 * logdet + 0.5 * len(x) * math.log(2 * math.pi))


def field_variance(q: np.ndarray) -> np.ndarray:
    """Marginal variance of each vertex."""
    return np.diag(np.linalg.inv(q))


def effective_range(kappa: float, kind: str) -> float:
    """Distance at which correlation falls to a tenth; kappa for a mesh, its correlation (exp of log kappa) otherwise."""
    if kind == "mesh":
        return math.sqrt(8) / kappa
    if kind in ("lattice", "network"):
        return math.log(0.1) / math.log(kappa)
    return math.nan


# random effects by Laplace's approximation, for intercepts of bounded number
def fit_random_intercepts(counts: list[tuple[int, int]], steps: int = 60, times: list[int] | None = None) -> tuple[float, float, np.ndarray]:
    """Encounters (positive, total) by group with normal intercepts on the logit scale: (mean, sd, effects).

    Sufficient sums come from one aggregate; the outer search over the log of the sd is golden section.
    times: how many groups have these counts, one each if not given; they share an effect.
    """
    y, n = (np.array(x, float) for x in zip(*counts))
    m = np.ones(len(y)) if times is None else np.array(times, float)
    expit = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def inner(sd: float):
        mu, u = math.log((m @ y + 0.5) / (m @ n - m @ y + 0.5)), np.zeros(len(y))
        for _ in range(steps):
            p = expit(mu + u)
            h = n * p * (1 - p)
            u = u + (y - n * p - u / sd**2) / (h + 1 / sd**2)
            p = expit(mu + u)
            h = n * p * (1 - p)
            w = h / (1 + h * sd**2)  # the mean's information once the effects are integrated out
            mu += float(m @ (y - n * p) / max(1e-9, m @ w)) * 0.5
        eta = mu + u
        h = n * expit(eta) * expit(-eta)
        nll = -(m @ (y * eta - n * np.logaddexp(0, eta))) + 0.5 * (m @ u**2) / sd**2 + m.sum() * math.log(sd) + 0.5 * (m @ np.log(h + 1 / sd**2))
        return nll, mu, u

    a, b, g = math.log(1e-3), math.log(10.0), (math.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - g * (b - a), a + g * (b - a)
        if inner(math.exp(c))[0] < inner(math.exp(d))[0]:
            b = d
        else:
            a = c
    sd = math.exp((a + b) / 2)
    _, mu, u = inner(sd)
    return float(mu), sd, u


# simulation and forecast
def draw_uniform(*keys, seed: int):
    """In (0, 1), fixed by the keys and seed, so retried tasks repeat it."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)).cast("double") + 0.5) / F.lit(float(1 << 40))


def simulate(rows: DataFrame, n_replicates: int, sigma: float, seed: int = 123456, key: str = "i") -> DataFrame:
    """key, r, sim: delta-lognormal responses at r1, r2 (conditional on the fitted effects)."""
    from seamark.functions.links import normal_quantile

    reps = rows.select(key, "r1", "r2", F.explode(F.sequence(F.lit(1), F.lit(n_replicates))).alias("r"))
    u = draw_uniform(F.lit("encounter"), F.col(key), F.col("r"), seed=seed)
    z = normal_quantile(draw_uniform(F.lit("size"), F.col(key), F.col("r"), seed=seed))
    return reps.select(key, "r", F.when(u < F.col("r1"), F.exp(F.ln("r2") - sigma * sigma / 2 + sigma * z)).otherwise(0.0).alias("sim"))


def forecast(last: DataFrame, rho: float, sd: float, steps: int, n_replicates: int, seed: int = 123456) -> DataFrame:
    """s, r, t, val: autoregressive paths from the last state (s, t, val), one innovation a step."""
    from seamark.functions.links import normal_quantile

    reps = last.select("s", F.col("t").alias("_t"), F.col("val").alias("_v"), F.explode(F.sequence(F.lit(1), F.lit(n_replicates))).alias("r"))
    z = lambda k: normal_quantile(draw_uniform(F.lit("path"), F.col("s"), F.col("r"), k, seed=seed))
    init = F.array(F.struct(F.col("_t").alias("t"), F.col("_v").alias("val")))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, lambda acc, k: F.concat(acc, F.array(F.struct((F.col("_t") + k).cast("int").alias("t"), (F.lit(rho) * F.element_at(acc, -1)["val"] + F.lit(sd) * z(k)).alias("val")))))
    return reps.select("s", "r", F.explode(F.slice(walk, 2, steps)).alias("x")).select("s", "r", "x.t", "x.val")


def padding_rows(obs: DataFrame, steps: int) -> DataFrame:
    """Two rows for each category and step beyond the data: nothing, and the mean response, at mean place and effort."""
    mean = obs.agg(F.max("t").alias("_t"), F.avg("a").alias("a"), F.avg("b").alias("_b"))
    cats = obs.select("c").distinct()
    return cats.join(F.broadcast(mean)).select("c", F.explode(F.sequence(F.col("_t") + 1, F.col("_t") + steps)).alias("t"), "a", F.explode(F.array(F.lit(0.0), F.col("_b"))).alias("b"))


def folds(rows: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    return rows.withColumn("fold", (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(k)) + 1).cast("int"))


def crossvalidate(obs: DataFrame, k: int, keys: list[str], seed: int = 1) -> DataFrame:
    """fold, nll, n (keys name a row): yearly encounter rates fitted without each fold and scored on it, from one aggregate over all rows."""
    seen = obs.where("b IS NOT NULL")
    cells = folds(seen, k, seed, *keys).groupBy("c", "t", "fold").agg(F.count("*").alias("n"), F.count_if(F.col("b") > 0).alias("y"))
    from pyspark.sql import Window

    w = Window.partitionBy("c", "t")
    p = (F.sum("y").over(w) - F.col("y") + 0.5) / (F.sum("n").over(w) - F.col("n") + 1.0)
    return cells.withColumn("p", p).groupBy("fold").agg((-F.sum(F.col("y") * F.ln("p") + (F.col("n") - F.col("y")) * F.log1p(-F.col("p")))).alias("nll"), F.sum("n").alias("n"))


# multivariate
def kmeans_knots(sites: DataFrame, k: int, starts: int = 3, seed: int = 1) -> DataFrame:
    """x, e_km, n_km: all different sites where there are k or fewer, else the centres of the best of some starts."""
    distinct = sites.select("e_km", "n_km").distinct()
    some = distinct.limit(k + 1).collect()
    spark = sites.sparkSession
    if len(some) <= k:
        rows = [(i, float(r.e_km), float(r.n_km)) for i, r in enumerate(sorted(some))]
        return spark.createDataFrame(rows, "x int, e_km double, n_km double")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["e_km", "n_km"], outputCol="_x").transform(distinct).select("_x").cache()
    best = min((KMeans(k=k, seed=seed + s, featuresCol="_x", maxIter=50).fit(data) for s in range(starts)), key=lambda m: m.summary.trainingCost)
    data.unpersist()
    return spark.createDataFrame([(i, float(c[0]), float(c[1])) for i, c in enumerate(sorted(map(tuple, best.clusterCenters())))], "x int, e_km double, n_km double")


def coarsen(cells: DataFrame, max_cells: int, seed: int = 1) -> DataFrame:
    """x, e_km, n_km, l, area, include: cells gathered to max_cells centres of those with area."""
    from seamark.operators.spatial import nearest

    centres = kmeans_knots(cells.where("area > 0"), max_cells, seed=seed)
    near = nearest(cells, centres, "x", limit=max(10_000, max_cells))
    got = near.groupBy("x", "l").agg(F.sum("area").alias("area"), F.bool_or("include").alias("include"))
    return got.join(F.broadcast(centres), "x")


def pca_rotation(loading: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated loadings, rotation, eigenvalues): axes of L L' by size, each column's sum not negative; L' = L R keeps L L'."""
    u, s, vt = np.linalg.svd(loading, full_matrices=False)
    sign = np.where((u * s).sum(axis=0) < 0, -1.0, 1.0)
    return u * s * sign, vt.T * sign, s**2


def varimax(loading: np.ndarray, steps: int = 200, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(rotated loadings, rotation) by Kaiser's criterion."""
    p, k = loading.shape
    r, last = np.eye(k), 0.0
    for _ in range(steps):
        x = loading @ r
        u, s, vt = np.linalg.svd(loading.T @ (x**3 - x * (x**2).sum(axis=0) / p))
        r = u @ vt
        if s.sum() < last * (1 + tol):
            break
        last = s.sum()
    return loading @ r, r


def rotate_scores(scores: DataFrame, rotation: np.ndarray, keys: list[str]) -> DataFrame:
    """Scores (keys, f, val) in the rotated axes."""
    table = scores.sparkSession.createDataFrame([(i, j, float(rotation[i, j])) for i in range(rotation.shape[0]) for j in range(rotation.shape[1])], "f int, h int, w double")
    return scores.join(F.broadcast(table), "f").groupBy(*keys, "h").agg(F.sum(F.col("val") * F.col("w")).alias("val")).withColumnRenamed("h", "f")


def ward_clusters(points: np.ndarray, k: int, most: int = 10_000) -> np.ndarray:
    """Ward's method down to k clusters by nearest-neighbour chains; cluster numbers by first member."""
    n = len(points)
    if n > most:
        raise ValueError(f"{n} points; use bisecting clusters beyond {most}")
    centre, size, alive = points.astype(float).copy(), np.ones(n), np.ones(n, bool)
    label, merges, chain = np.arange(n), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        i = chain[-1]
        d = ((centre - centre[i]) ** 2).sum(axis=1) * size * size[i] / (size + size[i])
        d[~alive] = np.inf
        d[i] = np.inf
        j = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[j]:
            j = chain[-2]
            chain = chain[:-2]
            merges.append((float(d[j]), i, j))
            centre[j] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
            size[j] += size[i]
            alive[i] = False
        else:
            chain.append(j)
    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, i, j in sorted(merges)[: n - k]:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    roots = [root(i) for i in label]
    order = {r: c for c, r in enumerate(dict.fromkeys(roots))}
    return np.array([order[r] for r in roots])


def bisecting_clusters(rows: DataFrame, features: list[str], k: int, seed: int = 1) -> DataFrame:
    """rows with class; the distributed substitute for large tables."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="skip").transform(rows)
    return BisectingKMeans(k=k, seed=seed, featuresCol="_x", predictionCol="class").fit(data).transform(data).drop("_x")
