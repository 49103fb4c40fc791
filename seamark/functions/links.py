"""Link functions, densities and deviances as Columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def inv_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cloglog_encounter(a: Column, log_n: Column) -> Column:
    """1 - exp(-a * n), without cancellation for small n."""
    return -F.expm1(-a * F.exp(log_n))


def log_sum_exp(values: Column) -> Column:
    """Of an array of doubles."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(F.transform(values, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v))


def squeeze(p: Column, eps: float = 1e-12) -> Column:
    """Away from 0 and 1."""
    return F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))


def delta_link(p1: Column, p2: Column, a: Column | None = None) -> tuple[Column, Column]:
    """Encounter probability and positive rate; a: effort."""
    return inv_logit(p1), F.exp(p2) if a is None else a * F.exp(p2)


def poisson_link(p1: Column, p2: Column, a: Column) -> tuple[Column, Column]:
    """Numbers density exp(p1), weight exp(p2): encounter 1 - exp(-a n), positive rate a n w / encounter."""
    r1 = cloglog_encounter(a, p1)
    return r1, a * F.exp(p1 + p2) / r1


def tweedie_link(p1: Column, p2: Column, a: Column) -> tuple[Column, Column]:
    return a * F.exp(p1), F.exp(p2)


# log densities of one observation
def log_normal_density(x: Column, mean: Column, sd: Column) -> Column:
    return -F.lit(0.5 * math.log(2 * math.pi)) - F.ln(sd) - 0.5 * ((x - mean) / sd) * ((x - mean) / sd)


def lognormal_density(x: Column, mean: Column, sigma: Column) -> Column:
    """Parametrised by its mean: the log mean is ln(mean) - sigma^2 / 2."""
    return log_normal_density(F.ln(x), F.ln(mean) - sigma * sigma / 2, sigma) - F.ln(x)


def lognormal_cv_density(x: Column, mean: Column, cv: Column) -> Column:
    sd = F.sqrt(F.log1p(cv * cv))
    return lognormal_density(x, mean, sd)


def inverse_gaussian_density(x: Column, mean: Column, cv: Column) -> Column:
    shape = mean / (cv * cv)
    return 0.5 * (F.ln(shape) - F.lit(math.log(2 * math.pi)) - 3 * F.ln(x)) - shape * (x - mean) * (x - mean) / (2 * mean * mean * x)


#: Lanczos coefficients for g = 7, n = 9 (fixed values).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for positive x, about 15 digits, in generated code."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + k)
    t = y + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (y + 0.5) * F.ln(t) - t + F.ln(total)


def gamma_density(x: Column, mean: Column, cv: Column) -> Column:
    shape = 1 / (cv * cv)
    scale = mean * cv * cv
    return (shape - 1) * F.ln(x) - x / scale - lgamma(shape) - shape * F.ln(scale)


def poisson_density(x: Column, mean: Column) -> Column:
    return x * F.ln(mean) - mean - lgamma(x + 1)


def negative_binomial_density(x: Column, mean: Column, variance: Column) -> Column:
    """By mean and variance."""
    size = mean * mean / (variance - mean)
    p = mean / variance
    return lgamma(x + size) - lgamma(size) - lgamma(x + 1) + size * F.ln(p) + x * F.log1p(-p)


def zero_inflated(x: Column, encounter: Column, log_density: Column, log_zero: Column) -> Column:
    """Structural zeros with probability 1 - encounter."""
    return F.when(x == 0, F.ln((1 - encounter) + encounter * F.exp(log_zero))).otherwise(F.ln(encounter) + log_density)


def generalised_gamma_density(x: Column, mean: Column, sigma: Column, q: Column) -> Column:
    """Prentice's form, parametrised by its mean; q of either sign, not 0."""
    k = 1 / (q * q)
    beta = q / sigma
    log_theta = F.ln(mean) - lgamma(k + 1 / beta) + lgamma(k)
    w = beta * (F.ln(x) - log_theta)
    return F.ln(F.abs(beta)) + k * w - F.exp(w) - lgamma(k) - F.ln(x)


def delta_log_likelihood(b: Column, r1: Column, log_positive: Column) -> Column:
    """Bernoulli part and the density of positive values."""
    return F.when(b > 0, F.ln(squeeze(r1)) + log_positive).otherwise(F.ln(squeeze(1 - r1)))


def delta_cdf(b: Column, r1: Column, positive_cdf: Column) -> Column:
    """P(B <= b): a point mass at 0 and the positive part's share beyond."""
    return squeeze(F.when(b > 0, (1 - r1) + r1 * positive_cdf).otherwise(1 - r1))


# further observation models
def log_space_add(x: Column, y: Column) -> Column:
    """ln(exp(x) + exp(y)) without overflow."""
    top = F.greatest(x, y)
    return top + F.log1p(F.exp(F.least(x, y) - top))


def log_space_subtract(x: Column, y: Column) -> Column:
    """ln(exp(x) - exp(y)) for x > y."""
    return x + F.ln(-F.expm1(y - x))


def binomial_density(x: Column, n: Column, p: Column) -> Column:
    return lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * F.ln(p) + (n - x) * F.log1p(-p)


def lgamma_array(x: np.ndarray) -> np.ndarray:
    """For x of 1/2 and over; smaller ones by one step of the recursion."""
    small = x < 0.5
    z = np.where(small, x, x - 1)
    total = LANCZOS[0] + sum(c / (z + k) for k, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(total) - np.where(small, np.log(np.where(small, x, 1.0)), 0.0)


def tweedie_array(y: np.ndarray, mean: np.ndarray, phi: np.ndarray, p: float, rows: int = 2048) -> np.ndarray:
    """Log densities; the series is summed around its largest term, some rows at a time."""
    rate, shape, scale = mean ** (2 - p) / (phi * (2 - p)), (2 - p) / (p - 1), phi * (p - 1) * mean ** (p - 1)
    out = -rate
    at = np.flatnonzero(y > 0)
    peak = y[at] ** (2 - p) / (phi[at] * (2 - p))
    at, peak = at[np.argsort(peak)], np.sort(peak)
    for k in range(0, len(at), rows):
        i, top = at[k : k + rows], peak[k : k + rows]
        reach = int(math.ceil(12 * math.sqrt(top[-1]) + 30))
        j = np.maximum(1.0, np.floor(top) - reach)[:, None] + np.arange(2 * reach + 1)
        term = j * np.log(rate[i])[:, None] - lgamma_array(j + 1) + (j * shape - 1) * np.log(y[i])[:, None] - lgamma_array(j * shape) - j * shape * np.log(scale[i])[:, None]
        best = term.max(axis=1)
        out[i] += best + np.log(np.exp(term - best[:, None]).sum(axis=1)) - y[i] / scale[i]
    return out


def tweedie_density(y: Column, mean: Column, phi: Column, p: float) -> Column:
    """Log density of the compound Poisson with gamma jumps, 1 < p < 2.

    Its series has no closed form and special functions in lambdas are interpreted row by row, so it
    is summed in Arrow batches.
    """

    @F.pandas_udf("double")
    def density(y: pd.Series, mean: pd.Series, phi: pd.Series) -> pd.Series:
        return pd.Series(tweedie_array(y.to_numpy(float), mean.to_numpy(float), phi.to_numpy(float), p))

    return density(y, mean, phi)


def overdispersed_mean(mean: Column, sigma: Column, delta: Column) -> Column:
    """The mean times a lognormal factor of mean 1."""
    return mean * F.exp(sigma * delta - sigma * sigma / 2)


def count_log_likelihood(kind: int, b: Column, r1: Column, r2: Column, s1: Column | None = None, s2: Column | None = None, delta: Column | None = None) -> Column:
    """Log density of counts by the distribution's code.

    5: zero-inflated negative binomial with variance r2 (1 + s1) + r2^2 s2; 7: zero-inflated Poisson; 11: the same with
    lognormal overdispersion; 12: Poisson of mean r1; 13: presence by the complementary log-log link; 14: 12 with overdispersion.
    """
    zero = F.lit(0.0)
    if kind == 5:
        variance = r2 * (1 + s1) + r2 * r2 * s2
        inside = lambda x: negative_binomial_density(x, r2, variance)
    elif kind in (7, 11):
        mean = r2 if kind == 7 else overdispersed_mean(r2, s1, delta)
        inside = lambda x: poisson_density(x, mean)
    elif kind == 12:
        return poisson_density(b, r1)
    elif kind == 13:
        return F.when(b == 0, -r1).otherwise(log_space_subtract(zero, -r1))
    elif kind == 14:
        return poisson_density(b, overdispersed_mean(r1, s1, delta))
    else:
        raise ValueError(f"no counts have the code {kind}")
    return F.when(b == 0, log_space_add(F.log1p(-r1), inside(zero) + F.ln(r1))).otherwise(inside(b) + F.ln(r1))


def poisson_quantile(u: Column, mean: Column) -> Column:
    """The smallest count whose distribution reaches u: a draw, for u from draw_uniform."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("cum"), F.lit(0).alias("k"))
    step = lambda s, j: F.struct((s.p * mean / j).alias("p"), (s.cum + s.p * mean / j).alias("cum"), F.when(s.cum < u, j).otherwise(s.k).alias("k"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s.k)


# deviances
def bernoulli_deviance(encountered: Column, r1: Column) -> Column:
    return F.when(encountered, -2 * F.ln(r1)).otherwise(-2 * F.ln(1 - r1))


def normal_deviance(y: Column, mu: Column) -> Column:
    return (y - mu) * (y - mu)


def lognormal_deviance(y: Column, mu: Column) -> Column:
    return (F.ln(y) - F.ln(mu)) * (F.ln(y) - F.ln(mu))


def gamma_deviance(y: Column, mu: Column) -> Column:
    return 2 * ((y - mu) / mu - F.ln(y / mu))


def tweedie_deviance(y: Column, mu: Column, p: float) -> Column:
    first = F.when(y > 0, F.pow(y, F.lit(2 - p))).otherwise(0.0) / ((1 - p) * (2 - p))
    return 2 * (first - y * F.pow(mu, F.lit(1 - p)) / (1 - p) + F.pow(mu, F.lit(2 - p)) / (2 - p))


def soft_floor(x: Column, low: float) -> Column:
    """x where it is above low, a smooth positive continuation below."""
    return F.when(x >= low, x).otherwise(F.lit(low) / (F.lit(2.0) - x / low))


def even_chi2_survival(x: Column, n: Column) -> Column:
    """P(chi-square with 2n degrees of freedom > x): the sum of the first n Poisson terms with mean h = x / 2.

    Terms are taken relative to their largest, from there downwards and upwards, as exp(-h) alone is 0 beyond h = 745.
    Farther from it than reach they are under exp(-800) of it each, which no double's sum can hold.
    """
    h, n = x / 2, n.cast("bigint")
    top = F.least(n - 1, F.floor(h))
    reach = (F.ceil(40 * F.sqrt(h)) + 60).cast("bigint")
    none, one = F.array().cast("array<bigint>"), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    added = lambda s, term: F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))
    below = F.when(top >= 1, F.sequence(top, F.greatest(top - reach, F.lit(1).cast("bigint")), F.lit(-1).cast("bigint"))).otherwise(none)
    above = F.when(top < n - 1, F.sequence(top + 1, F.least(n - 1, top + reach))).otherwise(none)
    total = 1 + F.aggregate(below, one, lambda s, j: added(s, s["term"] * j / h), lambda s: s["sum"]) + F.aggregate(above, one, lambda s, j: added(s, s["term"] * h / j), lambda s: s["sum"])
    largest = -h + top * F.ln(h) - lgamma((top + 1).cast("double"))
    return F.when(h <= 0, 1.0).otherwise(F.exp(largest + F.ln(total)))


#: Acklam's rational approximation of the normal quantile (fixed values).
_QA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_QB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """Relative error under 1.2e-9, in generated code."""
    q, low = p - 0.5, 0.02425
    r = q * q
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    outer = _poly(tail, _QC) / (_poly(tail, _QD) * tail + 1)
    return F.when((p >= low) & (p <= 1 - low), _poly(r, _QA) * q / (_poly(r, _QB) * r + 1)).otherwise(F.when(p < low, outer).otherwise(-outer))


def information_criterion(nll: float, k: int, p: float = 2.0, n: float = math.inf) -> float:
    """AIC (p = 2, n infinite), corrected AIC (finite n), BIC (p = ln n)."""
    return p * k + 2 * nll + (0.0 if math.isinf(n) else 2 * k * (k + 1) / (n - k - 1))
