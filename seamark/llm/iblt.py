"""Document fingerprints as invertible Bloom lookup sketches (operator 5).

A document is the set of its paragraphs' digests: lines, and within long lines runs of
words that end where a word's digest says so, so an edit changes only the paragraphs
that it touches.  Each digest is added to three cells of a sketch: a count, the sum of
digests and the sum of their checks.  Sketches of two versions subtract cell by cell; what
both hold vanishes, and peeling cells that hold one digest recovers those that
differ.  If peeling gets stuck, sketches of twice the size are tried.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import parts_for, text_bytes

#: Cells of the fingerprint that is returned; larger ones are made when it does not peel.
CELLS, HASHES = 24, 3
#: A paragraph ends after about this many words unless its line ends before.
RUN = 6
_WORDS = re.compile(r"[^\x20\x09-\x0D]+|\n").findall
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt) * _M2) * _M1
        x = (x ^ (x >> np.uint64(32))) * _M1
        return x ^ (x >> np.uint64(29))


def paragraphs(text: str | None) -> np.ndarray:
    """Sorted digests of the different paragraphs."""
    import xxhash

    out, held = set(), []
    for w in _WORDS(text or ""):
        if w == "\n":
            if held:
                out.add(xxhash.xxh3_64_intdigest(" ".join(held).encode("utf-8", "surrogatepass")))
                held = []
            continue
        held.append(w)
        if xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) % RUN == 0:
            out.add(xxhash.xxh3_64_intdigest(" ".join(held).encode("utf-8", "surrogatepass")))
            held = []
    if held:
        out.add(xxhash.xxh3_64_intdigest(" ".join(held).encode("utf-8", "surrogatepass")))
    return np.sort(np.fromiter(out, np.uint64, len(out)))


class Sketch:
    """Cells of count, sum of digests and sum of checks (all wrapping)."""

    def __init__(self, cells: int):
        self.cells = cells - cells % HASHES or HASHES
        self.count = np.zeros(self.cells, np.int64)
        self.keys = np.zeros(self.cells, np.uint64)
        self.checks = np.zeros(self.cells, np.uint64)

    @classmethod
    def of(cls, digests: np.ndarray, cells: int) -> Sketch:
        got = cls(cells)
        if len(digests):
            at = got.places(digests).ravel()
            np.add.at(got.count, at, 1)
            np.add.at(got.keys, at, np.tile(digests, HASHES))
            np.add.at(got.checks, at, np.tile(_mix(digests, 9), HASHES))
        return got

    def places(self, digests: np.ndarray) -> np.ndarray:
        """One cell in each third."""
        third = self.cells // HASHES
        return np.stack([(_mix(digests, j + 1) % np.uint64(third)).astype(np.int64) + j * third for j in range(HASHES)])

    def __sub__(self, other: Sketch) -> Sketch:
        got = Sketch(self.cells)
        with np.errstate(over="ignore"):
            got.count, got.keys, got.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return got

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(digests only in the first, only in the second), or None if it gets stuck."""
        count, keys, checks = self.count.copy(), self.keys.copy(), self.checks.copy()
        mine, other = [], []
        for _ in range(2 * self.cells + 2):
            if not (count.any() or keys.any() or checks.any()):
                none = np.zeros(0, np.uint64)
                return (np.unique(np.concatenate(mine)) if mine else none), (np.unique(np.concatenate(other)) if other else none)
            with np.errstate(over="ignore"):
                key = np.where(count < 0, np.uint64(0) - keys, keys)
                check = np.where(count < 0, np.uint64(0) - checks, checks)
            pure = np.flatnonzero((np.abs(count) == 1) & (_mix(key, 9) == check))
            if not len(pure):
                return None
            found, first = np.unique(key[pure], return_index=True)
            sign = count[pure[first]]
            at = self.places(found)
            ok = (at == pure[first]).any(axis=0)  # a digest can only stand in its own cells
            found, sign, at = found[ok], sign[ok], at[:, ok]
            if not len(found):
                return None
            mine.append(found[sign > 0])
            other.append(found[sign < 0])
            with np.errstate(over="ignore"):
                for row in at:
                    np.subtract.at(count, row, sign)
                    np.subtract.at(keys, row, np.where(sign > 0, found, np.uint64(0) - found))
                    c = _mix(found, 9)
                    np.subtract.at(checks, row, np.where(sign > 0, c, np.uint64(0) - c))
        return None

    def text(self) -> str:
        """All cells as one string, which parse reads."""
        return base64.b64encode(self.count.astype("<i4").tobytes() + self.keys.astype("<u8").tobytes() + self.checks.astype("<u8").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Sketch:
        body = base64.b64decode(text)
        got = cls(len(body) // 20)
        n = got.cells
        got.count, got.keys, got.checks = np.frombuffer(body, "<i4", n).astype(np.int64), np.frombuffer(body, "<u8", n, 4 * n).copy(), np.frombuffer(body, "<u8", n, 12 * n).copy()
        return got


def likeness_of_fingerprints(a: str, b: str) -> float | None:
    """Shared paragraphs over all, from two fingerprints alone; None where their difference does not peel."""
    first, second = Sketch.parse(a), Sketch.parse(b)
    got = (first - second).peel()
    if got is None:
        return None
    differ = len(got[0]) + len(got[1])
    every = (int(first.count.sum()) + int(second.count.sum())) // HASHES + differ  # twice those of either
    return (every - 2 * differ) / every if every else 1.0


def difference(a: np.ndarray, b: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, int]:
    """Digests that only a and only b have, by peeling; and the cells that it took.

    Starts with about twice the difference that the sizes force, and doubles.
    """
    cells = max(cells, HASHES * int(abs(len(a) - len(b)) * 0.7))
    while True:
        got = (Sketch.of(a, cells) - Sketch.of(b, cells)).peel()
        if got is not None:
            return (*got, cells)
        cells *= 2


def _peel_many(digests: np.ndarray, pair: np.ndarray, sign: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peels the differences of many pairs of documents at once, each in cells of its own.

    sign is 1 for digests of a pair's first document, -1 for its second's; cells are
    multiples of HASHES.  Returns, for each pair, whether it peeled, how many digests only the
    first and only the second has, and the sum of squares of the counts before peeling.
    """
    third, begin = cells // HASHES, np.cumsum(cells) - cells
    n, pairs = int(cells.sum()), len(cells)
    owner = np.repeat(np.arange(pairs), cells)

    def places(d, p):
        return [begin[p] + j * third[p] + (_mix(d, j + 1) % third[p].astype(np.uint64)).astype(np.int64) for j in range(HASHES)]

    count, keys, checks = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    def add(d, p, s):
        negative = s < 0
        with np.errstate(over="ignore"):
            d_signed, c = np.where(negative, np.uint64(0) - d, d), _mix(d, 9)
            c = np.where(negative, np.uint64(0) - c, c)
            at = places(d, p)
            for x in at:
                np.add.at(count, x, s)
                np.add.at(keys, x, d_signed)
                np.add.at(checks, x, c)
        return np.concatenate(at)

    add(digests, pair, sign)
    squares = np.bincount(owner, weights=count.astype(float) ** 2, minlength=pairs)
    first, second = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    look = np.arange(n)
    while len(look):
        c, k, x = count[look], keys[look], checks[look]
        with np.errstate(over="ignore"):
            negative = c < 0
            k, x = np.where(negative, np.uint64(0) - k, k), np.where(negative, np.uint64(0) - x, x)
            pure = (np.abs(c) == 1) & (_mix(k, 9) == x)
            k, c, at = k[pure], c[pure], look[pure]
            p = owner[at]
            _, once = np.unique(k ^ (p.astype(np.uint64) * _M1), return_index=True)
        k, c, p, at = k[once], c[once], p[once], at[once]
        own = np.zeros(len(k), bool)
        for place in places(k, p):
            own |= place == at  # a digest can only stand in its own cells
        k, c, p = k[own], c[own], p[own]
        first += np.bincount(p[c > 0], minlength=pairs)
        second += np.bincount(p[c < 0], minlength=pairs)
        look = np.unique(add(k, p, -c)) if len(k) else look[:0]
    left = np.bincount(owner, weights=(count != 0) | (keys != 0) | (checks != 0), minlength=pairs)
    return left == 0, first, second, squares


def likeness_many(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Shared paragraphs over all, for pairs of sets of digests; 1 for two documents without any.

    All pairs are peeled together.  What gets stuck is tried again: first in as many cells as
    the spread of the counts asks for, then in twice as many each time.
    """
    out = np.ones(len(pairs))
    todo = np.array([k for k, (a, b) in enumerate(pairs) if len(a) or len(b)], np.int64)
    cells = np.full(len(pairs), CELLS, np.int64)
    first = True
    while len(todo):
        sets = [x for k in todo for x in pairs[k]]
        sizes = np.array([len(x) for x in sets], np.int64)
        digests = np.concatenate(sets)
        pair, sign = np.repeat(np.arange(len(todo)), sizes.reshape(-1, 2).sum(axis=1)), np.repeat(np.tile([1, -1], len(todo)), sizes)
        done, only_a, only_b, squares = _peel_many(digests, pair, sign, cells[todo])
        total = sizes.reshape(-1, 2).sum(axis=1)
        both = (total - only_a - only_b) / 2
        out[todo[done]] = (both / (both + only_a + only_b))[done]
        stuck = ~done
        # what the counts vary beyond the surplus that the sizes tell of grows with the difference
        surplus = np.abs(sizes[::2] - sizes[1::2])
        guess = np.clip((squares - 9.0 * surplus**2 / cells[todo]) / HASHES, surplus, total)
        grown = np.maximum(cells[todo] * 2, np.ceil(1.8 * guess).astype(np.int64) if first else 0)
        cells[todo] = grown - grown % HASHES
        todo, first = todo[stuck], False
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(likeness_many([(a, b)])[0])


def edited(text: str, following: str) -> str:
    """The last half replaced by as much of the start of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())


def _compare(batches):
    """Rows of a bucket from the largest id down; each is compared with the next one, a guest row ends its bucket."""
    before = None  # (bucket, doc_id, text, paragraphs)

    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part, out, pairs = batch.slice(begin, 256), [], []
            for bucket, guest, doc_id, text in zip(*(part.column(k).to_pylist() for k in range(4))):
                text = text or ""
                digests = paragraphs(text)
                if before is not None and before[0] == bucket:
                    other = edited(before[2], text)
                    changed = paragraphs(other)
                    pairs += [(before[3], changed), (before[3], digests)]
                    prints = Sketch.of(before[3], CELLS).text(), Sketch.of(changed, CELLS).text()
                    out.append((before[1], len(before[2]), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), *prints, other))
                before = None if guest else (bucket, doc_id, text, digests)
            if out:
                near = likeness_many(pairs).reshape(-1, 2)
                columns = list(zip(*out))
                columns[5:5] = [near[:, 0], near[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _KINDS)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_text"])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text and how near they are, in descending doc_id order.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, edited_text.

    near_edited and near_next are shares of paragraphs: what peeling the difference of the two fingerprints
    leaves; where these do not peel, of larger sketches of the same paragraphs.

    The order is made without one sorted partition: ids are cut into ranges, and the
    document that follows a range is sent to it as a guest.  Work for a row grows with the logarithm of
    the ranges' number only.  A null or empty text has no
    paragraphs.  Null ids come last; among rows that repeat an id, larger texts come first;
    the last document is followed by the first, which with one document is itself.  An
    empty table gives none; further columns are not read.
    """
    spark = docs.sparkSession
    parts = parts_for(text_bytes(docs), 6e6, least=4)
    least = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("id", F.coalesce("doc_id", F.lit(least)))
    # ids alone are cut into ranges, each with its smallest and largest: one row a range
    cut = rows.select("id").repartitionByRange(parts, "id").select(F.spark_partition_id().alias("p"), "id").groupBy("p").agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()
    cut = sorted((r.low, r.high) for r in cut)
    shared = spark.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in zip(*cut)) if cut else (np.zeros(0, np.int64),) * 2)  # 16 bytes a range

    @F.pandas_udf("bucket int, target int")
    def place(ids: pd.Series) -> pd.DataFrame:
        """The id's range, and the range above if the id heads its own; the topmost range's head goes to the lowest."""
        low, high = shared.value
        ids = ids.to_numpy()
        bucket = np.searchsorted(low, ids, "right") - 1
        return pd.DataFrame({"bucket": bucket.astype(np.int32), "target": np.where(ids == high[bucket], (bucket + 1) % len(low), -1).astype(np.int32)})

    own = F.struct(F.col("at.bucket").alias("b"), F.lit(False).alias("g"))
    targets = F.when(F.col("at.target") < 0, F.array(own)).otherwise(F.array(own, F.struct(F.col("at.target").alias("b"), F.lit(True).alias("g"))))
    dealt = rows.withColumn("at", place("id")).select("id", "doc_id", "text", F.explode(targets).alias("t")).select(F.col("t.b").alias("bucket"), F.col("t.g").alias("guest"), "id", "doc_id", "text")
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("id"), F.desc_nulls_last("text"))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_text string"
    return ordered.select("bucket", "guest", "doc_id", "text").mapInArrow(_compare, schema)
