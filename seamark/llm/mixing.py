"""Mixing to target weights by soft membership (operator 7), in DataFrame operations only.

A classifier that a labelled table trains gives every document its domain
posteriors.  Rates, how often each document is to be taken, then solve a
nonnegative least-squares problem: expected tokens of every domain, summed over all
documents by rate, tokens and posterior, shall match their targets.  The solution is
found by projected gradient steps; a step needs one sum for each domain over all
documents, and a document's rate follows from its own posteriors and the sums so far, so
no state is shuffled.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import SEPARATORS, materialise

DOMAINS = ("clean", "poor", "toxic")


@dataclass(frozen=True)
class Settings:
    """sample: the most labelled rows that the classifier learns from (the smallest hashes of their ids).

    words: the most words for each domain that it looks at; support: sample documents
    that such a word needs; steps and tolerance: of the solver (relative to each target).
    """

    sample: int = 20_000
    words: int = 100
    support: int = 8
    steps: int = 25
    tolerance: float = 1e-3
    seed: int = 7


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 0)


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[.,!#*$%&|<>]+", " "), SEPARATORS), lambda w: w != ""))


def _tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")).cast("bigint")


def _shape(text: Column, n_words: Column, n_distinct: Column) -> list[Column]:
    """Small whole numbers that describe a text's form."""
    text = F.coalesce(text, F.lit(""))
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    log = lambda c, most: F.least(F.floor(F.log2(c + 1)), F.lit(most)).cast("int")
    return [
        log(1000 * per(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.length(text)), 9),
        log(1000 * per(F.regexp_count(text, F.lit("\\p{Lu}{4,}")), n_words), 10),
        F.floor(10 * per(n_distinct, n_words)).cast("int"),
        log(n_words, 14),
        F.least(F.floor(2 * per(F.length(text), n_words)), F.lit(24)).cast("int"),
    ]


def _sum_of(found: Column, listed: Column, weights: Column) -> Column:
    return F.aggregate(found, F.lit(0.0), lambda a, w: a + F.get(weights, F.array_position(listed, w).cast("int") - 1))


@dataclass
class Classifier:
    """Naive Bayes over the words that tell domains apart and the shape of a text."""

    priors: list[float]
    words: list[str] = field(default_factory=list)
    word_weights: list[list[float]] = field(default_factory=list)
    shapes: list[dict[int, list[float]]] = field(default_factory=list)
    unseen: list[list[float]] = field(default_factory=list)

    def posteriors(self, found: Column, shape: list[Column]) -> list[Column]:
        """found: the text's words among self.words."""
        listed = F.lit(self.words) if self.words else F.array().cast("array<string>")
        scores = []
        for k in range(len(self.priors)):
            score = F.lit(self.priors[k])
            if self.words:
                score += _sum_of(found, listed, F.lit(self.word_weights[k]))
            for j, c in enumerate(shape):
                other = self.unseen[j][k]
                top = max(self.shapes[j], default=0)
                score += F.coalesce(F.get(F.lit([self.shapes[j][v][k] if v in self.shapes[j] else other for v in range(top + 1)]), c), F.lit(other))
            scores.append(score)
        return scores


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Classifier:
    """Learn from a bounded sample of the labelled documents.

    Labels without a quality or toxic value, or with an id that docs lacks, are not used;
    contradictory labels of one id all count.  Without labels all documents are clean.
    """
    sample = (
        labels.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("d")).where("d IS NOT NULL AND doc_id IS NOT NULL")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "d").limit(settings.sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # settings.sample rows at most
    seen = rows.select("d", _words(F.col("text")).alias("words"), _tokens(F.col("text")).alias("n"), "text")
    shaped = seen.select("d", "words", F.array(*_shape(F.col("text"), F.col("n"), F.size("words"))).alias("shape"))
    seen = materialise(shaped, "labelled")
    n = [0] * len(DOMAINS)
    for r in seen.groupBy("d").count().collect():
        n[r.d] = r["count"]
    total = sum(n)
    priors = [math.log((x + 0.5) / (total + 1.5)) for x in n] if total else [0.0, -20.0, -20.0]
    if not total:
        return Classifier(priors)
    counts = seen.select("d", F.explode("words").alias("w")).groupBy("w").agg(*(F.count_if(F.col("d") == k).alias(f"n{k}") for k in range(len(DOMAINS))))
    # how far a word's share in a domain stands above its share elsewhere, in standard errors
    chosen: dict[str, list[int]] = {}
    for k in range(len(DOMAINS)):
        here, there = F.col(f"n{k}"), sum((F.col(f"n{j}") for j in range(len(DOMAINS)) if j != k), F.lit(0))
        n_here, n_there = max(1, n[k]), max(1, total - n[k])
        p = (here + there) / F.lit(float(total))
        z = (here / F.lit(float(n_here)) - there / F.lit(float(n_there))) / F.sqrt(p * (1 - p + F.lit(1e-9)) * F.lit(1 / n_here + 1 / n_there) + F.lit(1e-12))
        for r in counts.where(here + there >= settings.support).withColumn("z", z).where("z > 6").orderBy(F.col("z").desc(), "w").limit(settings.words).collect():
            chosen[r.w] = [r.n0, r.n1, r.n2]
    model = Classifier(priors, list(chosen), [[math.log((chosen[w][k] + 0.5) / (n[k] - chosen[w][k] + 0.5)) for w in chosen] for k in range(len(DOMAINS))])
    # words that a text lacks count too: their share is part of the prior
    model.priors = [p + sum(math.log((n[k] - chosen[w][k] + 0.5) / (n[k] + 1.0)) for w in chosen) for k, p in enumerate(priors)]
    by_shape = seen.select("d", F.posexplode("shape").alias("j", "v")).groupBy("j", "v").agg(*(F.count_if(F.col("d") == k).alias(f"n{k}") for k in range(len(DOMAINS)))).collect()  # a few bins a feature
    for j in range(5):
        bins = {r.v: (r.n0, r.n1, r.n2) for r in by_shape if r.j == j}
        size = len(bins) + 1
        model.shapes.append({v: [math.log((x[k] + 0.5) / (n[k] + 0.5 * size)) for k in range(len(DOMAINS))] for v, x in bins.items()})
        model.unseen.append([math.log(0.5 / (n[k] + 0.5 * size)) for k in range(len(DOMAINS))])
    return model


def classify(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """keep, ``n_tokens`` and ``p_<domain>``; posteriors are set between 1e-6 and 1 and add up to 1."""
    none = F.array().cast("array<string>")
    base = docs.select(*(F.col(c) for c in keep), *([] if "text" in keep else ["text"]))
    measured = base.select(*keep, *([] if "text" in keep else ["text"]), _tokens(F.col("text")).alias("n_tokens"), _words(F.col("text")).alias("_words"))
    shaped = measured.select(*keep, "n_tokens", (F.array_intersect(F.col("_words"), F.lit(model.words)) if model.words else none).alias("_found"), F.array(*_shape(F.col("text"), F.col("n_tokens"), F.size("_words"))).alias("_shape"))
    shape = [F.get("_shape", F.lit(j)) for j in range(len(model.shapes))]
    scored = shaped.select(*keep, "n_tokens", F.array(*model.posteriors(F.col("_found"), shape)).alias("_s"))
    raised = F.transform("_s", lambda s: F.greatest(F.exp(s - F.array_max("_s")), F.lit(1e-6)))
    return scored.withColumn("_e", raised).select(*keep, "n_tokens", *((F.get("_e", F.lit(k)) / F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)))


def rate(history: list[list[float]]) -> Column:
    """A document's rate after these steps."""
    r = F.lit(1.0)
    for v in history:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"p_{d}") * F.lit(v[k]) for k, d in enumerate(DOMAINS)), F.lit(0.0)))
    return r


def solve(classified: DataFrame, weights: dict[str, float], settings: Settings = Settings(), anchor: str | None = None, thin: bool = False) -> tuple[Column, list[float], list[float]]:
    """(rate, targets, totals reached).

    weights: the wanted share of tokens for each domain.  The whole amounts to the input's
    tokens, or with an anchor to so many that this domain keeps what it has.  thin: a domain that has
    less than its share keeps what it has, instead of being repeated.
    Least squares weigh each domain by what it has, so small ones count as much.
    """
    names = [f"p_{d}" for d in DOMAINS]
    has = [float(x or 0.0) for x in classified.agg(*(F.sum(F.col("n_tokens") * F.col(p)) for p in names)).first()]
    share = [weights.get(d, 0.0) / sum(weights.values()) for d in DOMAINS]
    k = DOMAINS.index(anchor) if anchor else None
    whole = has[k] / share[k] if k is not None and share[k] else sum(has)
    targets = [min(s * whole, h) if thin else s * whole for s, h in zip(share, has)]
    history: list[list[float]] = []
    reached = has
    for _ in range(settings.steps):
        off = [a - t for a, t in zip(reached, targets)]
        if all(abs(x) <= settings.tolerance * max(t, 1.0) for x, t in zip(off, targets)):
            break
        history.append([x / h if h > 0 else 0.0 for x, h in zip(off, has)])
        r = rate(history)
        reached = [float(x or 0.0) for x in classified.agg(*(F.sum(F.col("n_tokens") * F.col(p) * r) for p in names)).first()]
    if any(abs(a - t) > settings.tolerance * max(t, 1.0) for a, t in zip(reached, targets)):
        warnings.warn(f"after {len(history)} steps the domains' tokens are {reached}, not {targets}", stacklevel=2)
    return rate(history), targets, reached


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], keep: list[str], settings: Settings = Settings(), anchor: str | None = None, thin: bool = False) -> DataFrame:
    """keep with ``n_tokens``, ``p_<domain>``, ``rate`` and ``copies`` (anchor, thin: see solve).

    copies is the rate rounded up or down by a keyed hash of doc_id, so that it is the rate on
    average; null ids share one draw, and so do rows that repeat an id.  A null or
    empty text has no tokens and keeps the posteriors of its shape.  An empty table gives none.
    """
    taken = {"n_tokens", "rate", "copies", *(f"p_{d}" for d in DOMAINS)}
    keep = [c for c in keep if c not in taken]
    model = train(docs, labels, settings)
    alias = [f"_k{k}" for k in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(a) for c, a in zip(keep, alias)), F.col("doc_id").alias("_id"), "text")
    classified = materialise(classify(rows, model, [*alias, "_id"]), "classified")
    r, _, _ = solve(classified, weights, settings, anchor, thin)
    draw = F.pmod(F.xxhash64("_id", F.lit(settings.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = classified.withColumn("rate", r).withColumn("copies", F.floor(F.col("rate") + draw).cast("int"))
    return out.select(*(F.col(a).alias(c) for c, a in zip(keep, alias)), "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies")
