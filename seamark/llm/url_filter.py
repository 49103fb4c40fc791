"""URL filters by a cascade of Bloom filters (operator 8), in DataFrame operations only.

Level 0 encodes the listed keys.  Over the complete universe of keys (every host of the
corpus and every domain above one) it lets some others pass; level 1 encodes those, level 2 the
listed keys that pass level 1, and so on until none is left.  The first level that a key does
not pass tells which side it is on, so membership is exact for the universe and needs no
join: the levels are constants of the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamark.llm.common import ascii_lower, materialise

#: Keys listed unless a caller gives others.
LISTED = ("spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.net", "free-money.example.com", "adult-zone.example.net")
#: (action, host, path) rules; a rule holds for its host and all below, for paths that start with its path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule's name, its action) of the longest rule that fits; nulls if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, begins in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later, longer ones override
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(begins)
        name, action = F.when(fits, F.lit(at + begins)).otherwise(name), F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def domains(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, "\\.")
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Level:
    #: Each level hashes in its own way, else a key that passes one by chance would pass all.
    depth: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.depth), F.lit(j)), F.lit(self.bits)) for j in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        """Whether all the key's bits are set; one parsed constant holds them."""
        table = F.from_json(F.lit("[" + ",".join(map(str, self.words)) + "]"), "array<bigint>")
        ok = F.lit(True)
        for p in self.positions(key):
            word = F.get(table, F.floor(p / 64).cast("int"))
            ok &= F.getbit(word, F.pmod(p, F.lit(64)).cast("int")) == 1
        return ok


def level(keys: DataFrame, n: int, rate: float, depth: int = 0) -> Level:
    """A Bloom filter for n keys (column key): some bits a key, so as bounded as the list is."""
    bits = max(64, 64 * math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
    hashes = max(1, round(math.log2(1 / rate)))
    empty = Level(depth, bits, hashes, ())
    at = F.explode(F.array(*empty.positions(F.col("key"))))
    rows = keys.select(at.alias("p")).groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int"))).alias("bits")).collect()
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.bits
    return Level(depth, bits, hashes, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Exact for every key of the universe that the cascade was built on."""
        out = F.lit(len(self.levels) % 2 == 1)  # a key that passes all levels is on the side of the last
        for depth in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[depth].passes(key), F.lit(depth % 2 == 1)).otherwise(out)
        return out


def build(universe: DataFrame, listed: DataFrame, most_levels: int = 64) -> Cascade:
    """A cascade that tells the listed keys from all others of universe (both: column key).

    Null keys and repeats count once; listed keys that the universe lacks are encoded too.
    An empty list gives a cascade that holds no key.
    """
    inside = materialise(listed.where("key IS NOT NULL").select("key").distinct(), "listed")
    outside = materialise(universe.where("key IS NOT NULL").select("key").distinct().join(inside, "key", "left_anti"), "unlisted")
    sides, sizes = [inside, outside], [inside.count(), outside.count()]
    if not sizes[0]:
        return Cascade(())
    levels: list[Level] = []
    while len(levels) < most_levels:
        side = len(levels) % 2
        keys, others, n, m = sides[side], sides[1 - side], sizes[side], sizes[1 - side]
        if not n:
            break
        share = min(0.5, max(1e-4, n * math.sqrt(0.5) / m)) if not levels and m else 0.5
        levels.append(level(keys, n, share, len(levels)))
        passed = materialise(others.where(levels[-1].passes(F.col("key"))), "passed")
        sides[1 - side], sizes[1 - side] = passed, passed.count()
    if sizes[len(levels) % 2]:
        raise ValueError("the cascade did not end")
    return Cascade(tuple(levels))


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, keep: list[str] | None = None) -> DataFrame:
    """keep with ``host``, ``path``, ``rule`` and ``verdict`` (allow or block) for each row of pages (url).

    The longest fitting rule decides; without one, a page is blocked if its host or a domain above
    it is listed (DataFrame with column key; LISTED).  A null url, or one without ://, has empty
    parts, fits no rule and is allowed.  Repeated rows are judged alike, an empty table
    gives none.  Columns of pages named like results are replaced.
    """
    spark: SparkSession = pages.sparkSession
    names = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*(F.col(c) for c in names), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    if listed is None:
        listed = spark.sql("SELECT explode(array({})) AS key".format(",".join(f"'{x}'" for x in LISTED)))
    # every host once before the domains above it are listed
    universe = pages.select(host(F.col("url")).alias("host")).distinct().select(F.explode(domains(F.col("host"))).alias("key"))
    cascade = build(universe, listed)
    name, action = rule(F.col("host"), F.col("path"), rules)
    found = F.exists(domains(F.col("host")), cascade.listed)
    return rows.select(*names, "host", "path", name.alias("rule"), F.coalesce(action, F.when(found, "block").otherwise("allow")).alias("verdict"))
