"""Quality rules with adaptive thresholds (operator 6).

Fixed rules reject what no corpus wants.  Beyond them a document is judged against its
own language and source: for each pair, every rate of the documents that pass the fixed rules is
summarised by a mergeable quantile sketch, whole counts in bins of a fixed relative
width.  The cut-off is an upper quantile plus a multiple of its distance from the
quantile opposite; there are no fixed cut-offs and no floors.  A document fails if its
rate is beyond the cut-off by more than chance explains: a count of k may stand for
k - z sqrt(k).  Thresholds are joined with the documents, which are then filtered.

All numbers but that square root are whole, so results do not depend on the order of merging.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import WORD, materialise, slices

#: Characters that count as symbols (fixed value of the contract).
SYMBOLS = "#*$%&|<>"
_WORDS, _HAS_WORD = re.compile(WORD).findall, re.compile(WORD).search
#: Whether a character is a capital letter; there are none beyond.
_CAPITAL = np.array([unicodedata.category(chr(c)) in ("Lu", "Lt") for c in range(0x20000)])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Parameters of the filter.

    tails: for each rate the upper quantile, in hundredths, and how many times its
    distance from the opposite one is added; bits: sketch bins hold a rate's first bits, so their
    relative width is at most 2 ** (1 - bits); chance: z; least: groups of fewer
    documents are judged by their language, or else by the whole corpus.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    tails: tuple[tuple[str, int, int], ...] = (("symbols", 75, 3), ("repeats", 90, 3), ("dup_lines", 90, 3), ("upper", 75, 3))
    bits: int = 6
    chance: int = 3
    least: int = 50


#: What each rate counts, and in what.
RATES = {"symbols": ("n_symbols", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "upper": ("n_upper", "word_chars")}


def _repeat_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    k = len(number)
    _, pair = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)  # dense, so products stay far below 2**63
    _, at, times = np.unique(pair[:-1].astype(np.int64) * k + ids[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[j : n - 2 + j] |= twice
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """The five counts, then capital letters and lines with a word."""
    if not text:
        return (0,) * 7
    words = _WORDS(text)
    lines = [x for x in text.split("\n") if _HAS_WORD(x)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    symbols, upper = sum(map(text.count, SYMBOLS)), int(_CAPITAL[codes[codes < len(_CAPITAL)]].sum())
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), _repeat_words(words), upper, len(lines)


MEASURES = (*COUNTS, "n_upper", "n_lines")


def _measure(batches, keep: int):
    for batch in batches:
        for part in slices(batch):
            got = list(zip(*map(measure_text, part.column("text").to_pylist()))) or [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([part.column(k) for k in range(keep)] + [pa.array(x, pa.int64()) for x in got], names=[*part.schema.names[:keep], *MEASURES])


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the counts of each text; a null text counts as empty."""
    rows = docs.select(*keep, *([] if "text" in keep else ["text"]))
    n = len(keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]), *(f"{m} bigint" for m in MEASURES)])
    return rows.mapInArrow(lambda it: _measure(it, n), schema)


def rate(name: str) -> Column:
    """A rate in whole thousandths; 0 of nothing."""
    k, n = map(F.col, RATES[name])
    return F.when(n > 0, F.floor(F.lit(1000) * k / n)).otherwise(0).cast("bigint")  # far from the next whole number in doubles


def _shift(x: Column, bits: int) -> Column:
    return F.greatest(F.lit(0), F.length(F.bin(x)) - bits)


def bin_of(x: Column, bits: int) -> Column:
    """The least whole number with the same first bits and length as x."""
    s = _shift(x, bits)
    return F.call_function("shiftleft", F.call_function("shiftright", x, s), s)


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def sketch(measured: DataFrame, rules: Rules) -> DataFrame:
    """Quantile sketches: (lang, source, rate, bin, n), merged by adding n.

    At most some 2 ** bits bins a rate and group, however many documents there are.
    """
    each = F.array(*(F.struct(F.lit(k).alias("rate"), bin_of(rate(k), rules.bits).alias("bin")) for k, _, _ in rules.tails))
    return (
        measured.where(~base_failed(rules)).select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.explode(each).alias("x"))
        .groupBy("lang", "source", "x.rate", "x.bin").agg(F.count("*").alias("n"))
    )


def thresholds(sketches: DataFrame, rules: Rules) -> DataFrame:
    """(level, lang, source, rate, n, cut) from sketches: level 0 of a language and source, 1 of a language, 2 of all."""
    from pyspark.sql import Window

    w = Window.partitionBy("level", "lang", "source", "rate")
    levels = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("l"), F.col("source").alias("s")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("l"), F.lit(None).cast("string").alias("s")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("s")),
    ))
    merged = sketches.select(levels.alias("k"), "rate", "bin", "n").groupBy("k.level", F.col("k.l").alias("lang"), F.col("k.s").alias("source"), "rate", "bin").agg(F.sum("n").alias("n"))
    per_rate = lambda i: F.element_at(F.create_map(*(x for t in rules.tails for x in (F.lit(t[0]), F.lit(t[i])))), F.col("rate"))
    ranked = merged.withColumns({"below": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w), "q": per_rate(1), "spread": per_rate(2)})
    s = _shift(F.col("bin"), rules.bits)
    edge = F.col("bin") + F.call_function("shiftleft", F.lit(1).cast("bigint"), s) - 1
    at = lambda q: F.min(F.when(100 * F.col("below") >= q * F.col("all"), edge))
    cut = ranked.groupBy("level", "lang", "source", "rate").agg(at(F.col("q")).alias("high"), at(100 - F.col("q")).alias("low"), F.max("all").alias("n"), F.max("spread").alias("spread"))
    return cut.select("level", "lang", "source", "rate", "n", (F.col("high") + F.col("spread") * (F.col("high") - F.col("low"))).cast("bigint").alias("cut"))


def beyond(name: str, cut: Column, rules: Rules) -> Column:
    """Whether a count is over its cut-off by more than chance; never where the group has none."""
    k, n = map(F.col, RATES[name])
    return F.coalesce(F.lit(1000) * (k - F.lit(rules.chance) * F.sqrt(k)) > cut * n, F.lit(False))


def judge(docs: DataFrame, rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """The rows of docs (columns keep) with counts, ``base_failed`` and ``kept``.

    docs has text, lang and source.  A null or empty text has no words and fails
    the fixed rules.  A null language or source forms a group like any other.
    Repeated rows are judged each, an empty table gives no rows.  Columns of docs
    with the names of results are replaced.
    """
    taken = {*MEASURES, "base_failed", "kept", "limits"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in taken]
    # carried under names of their own, so that no column of docs can clash
    carried = ["text" if c == "text" else f"_c{k}" for k, c in enumerate(names)]
    more = [] if "text" in names else ["text"]
    rows = docs.select(*(F.col(c).alias(x) for c, x in zip(names, carried)), F.col("lang").alias("_lang"), F.col("source").alias("_source"), *more)
    # measured once: both the sketches and the filter read it
    measured = materialise(measure(rows, [*carried, "_lang", "_source"]), "measured")
    limits = thresholds(sketch(measured, rules), rules)
    own, lang, every = (
        limits.filter((F.col("level") == level) & ((F.col("n") >= rules.least) | (level == 2)))
        .groupBy("lang", "source")
        .agg(F.map_from_entries(F.collect_list(F.struct("rate", "cut"))).alias(f"limits{level}"))  # one entry a rate
        for level in range(3)
    )
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    # a row for each language and source; not hinted, so Spark broadcasts it only while it is small
    judged = (
        measured.alias("m")
        .join(own.alias("o"), same("m._lang", "o.lang") & same("m._source", "o.source"), "left")
        .join(lang.alias("l"), same("m._lang", "l.lang"), "left")
        .join(F.broadcast(every.select("limits2")), F.lit(True), "left")  # one row
        .select(*(F.col(f"m.{c}") for c in (*carried, *MEASURES)), F.coalesce("limits0", "limits1", "limits2").alias("limits"))
    )
    failed = base_failed(rules)
    over = F.lit(False)
    for k, _, _ in rules.tails:
        over |= beyond(k, F.element_at("limits", F.lit(k)), rules)
    return judged.select(*(F.col(x).alias(c) for c, x in zip(names, carried)), *MEASURES, "limits", failed.alias("base_failed"), (~failed & ~over).alias("kept"))
