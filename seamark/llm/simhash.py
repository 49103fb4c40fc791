"""SimHash near-duplicates by anchor points (operator 10).

Anchors are the words of a covering code: the product of two binary Golay codes
of length 23, on 46 of the 64 bits.  The Golay code is perfect, so every
fingerprint has exactly one anchor, its home, within three bits in each half.  If
two fingerprints differ in at most t bits, e1 of them in one half and e2 in the
other, then the second lies within 3 + e1 and 3 + e2 bits of the first one's
home.  So every fingerprint is sent to all anchors within that radius (61 on average
for t = 2), and each anchor compares those at home with those that were
sent: no pair is missed and few others meet.

Equal fingerprints are one from the start, so copies never meet one another, and
each batch of anchors sends on only a spanning forest of the links that it finds.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import materialise, parts_for, runs, slices
from seamark.llm.components import components

BITS, HALF, RADIUS = 64, 23, 3
CODE_BITS = 2 * HALF
#: Generator of the binary Golay code (fixed value): x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GOLAY = 0b110001110101
#: Pairs compared at once; anchors with more are compared by looking up what lies around each fingerprint.
_PAIRS = 4_000_000


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the XXH64 values of the word shingles, repeats included."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return 0
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        n = len(words) - shingle + 1
        joined = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches, keep: int, shingle: int, seed: int):
    for batch in batches:
        for part in slices(batch):
            got = np.array([fingerprint(t, shingle, seed) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(k) for k in range(keep)] + [pa.array(got, pa.int64())], names=[*part.schema.names[:keep], "fp"])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3, seed: int = 42) -> DataFrame:
    """keep and ``fp``, the 64 bits as a signed long; null and empty texts have 0."""
    rows = docs.select(*(F.col(c) for c in keep), *([] if "text" in keep else ["text"]))
    n = len(keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n]), "fp bigint"])
    return rows.mapInArrow(lambda it: _fingerprints(it, n, shingle, seed), schema)


def _syndrome(x: int) -> int:
    for k in range(HALF - 1, 10, -1):
        if x >> k & 1:
            x ^= _GOLAY << (k - 11)
    return x


@lru_cache(maxsize=4)
def _code(t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome tables for the low 12 and high 11 bits; for each syndrome the patterns that lead to an anchor within RADIUS + t, and by how much each exceeds RADIUS."""
    unit = [_syndrome(1 << k) for k in range(HALF)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for table, first, width in ((low, 0, 12), (high, 12, 11)):
        for k in range(width):
            table[1 << k : 2 << k] = table[: 1 << k] ^ unit[first + k]
    found: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for w in range(RADIUS + t + 1):
        for bits in combinations(range(HALF), w):
            s = 0
            for b in bits:
                s ^= unit[b]
            found[s].append((sum(1 << b for b in bits), max(0, w - RADIUS)))
    most = max(map(len, found))
    pattern, over = np.zeros((1 << 11, most), np.int64), np.full((1 << 11, most), t + 1, np.int64)
    for s, x in enumerate(found):
        pattern[s, : len(x)], over[s, : len(x)] = zip(*x)
    return low, high, pattern, over, np.array(list(map(len, found)))


def anchors(fps: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the fingerprint, anchor, whether it is the home) for all anchors near enough."""
    low, high, pattern, over, _ = _code(t)
    halves = []
    for shift in (0, HALF):
        x = (fps >> np.uint64(shift)).astype(np.int64) & ((1 << HALF) - 1)
        s = low[x & 0xFFF] ^ high[x >> 12]
        halves.append((x[:, None] ^ pattern[s], over[s]))
    (a, ea), (b, eb) = halves
    i, j, k = np.nonzero(ea[:, :, None] + eb[:, None, :] <= t)
    return i, a[i, j] << HALF | b[i, k], ea[i, j] + eb[i, k] == 0


def _send(batches, t: int, tagged: bool):
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fps), 1000):
            part = fps[at : at + 1000]
            i, anchor, home = anchors(part, t)
            if tagged:
                anchor |= (part[i] >> np.uint64(CODE_BITS) << np.uint64(CODE_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[i].view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])


@lru_cache(maxsize=4)
def _ball(t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for w in range(1, t + 1) for bits in combinations(range(BITS), w)], np.uint64)


def _links_of_one(home: np.ndarray, fps: np.ndarray, t: int):
    """One anchor with many members: look up all that lies within t bits, linear in the members."""
    fps = np.sort(fps)
    ball = _ball(t)
    for at in range(0, len(home), 512):
        near = (home[at : at + 512, None] ^ ball).ravel()
        k = np.minimum(np.searchsorted(fps, near), len(fps) - 1)
        hit = fps[k] == near
        yield np.repeat(home[at : at + 512], len(ball))[hit], near[hit]


def _links(anchor: np.ndarray, fps: np.ndarray, home: np.ndarray, t: int):
    """(u, v) within t bits, u at home; rows are whole anchors, sorted."""
    begin = np.flatnonzero(np.diff(anchor, prepend=-1))
    size = np.diff([*begin, len(anchor)])
    group = np.repeat(np.arange(len(begin)), size)
    at_home = np.flatnonzero(home)
    at_home = at_home[size[group[at_home]] > 1]
    n = size[group[at_home]]
    large = n > len(_ball(t)) * 8
    for g in np.unique(group[at_home[large]]):
        rows = slice(begin[g], begin[g] + size[g])
        yield from _links_of_one(fps[rows][home[rows]], fps[rows], t)
    at_home, n = at_home[~large], n[~large]
    cuts = np.searchsorted(np.cumsum(n), np.arange(_PAIRS, n.sum() + _PAIRS, _PAIRS)) if len(n) else []
    for a, b in zip([0, *cuts], [*cuts, len(n)]):
        h, m = at_home[a:b], n[a:b]
        if not len(h):
            continue
        u = np.repeat(h, m)
        v = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + begin[group[u]]
        differ = np.bitwise_count(fps[u] ^ fps[v])
        ok = (differ > 0) & (differ <= t)
        yield fps[u[ok]], fps[v[ok]]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of these links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            up = new[new]
            if np.array_equal(up, new):
                break
            new = up
        if np.array_equal(new, root):
            break
        root = new
    hung = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[hung], nodes[root[hung]]


def _compare(batches, t: int):
    us, vs, held = [], [], 0

    def done():
        a, b = _forest(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    for batch in runs(batches, "anchor"):
        for u, v in _links(batch.column("anchor").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False), t):
            if len(u):
                us.append(u)
                vs.append(v)
                held += len(u)
        if held > 1_000_000:
            yield done()
            us, vs, held = [], [], 0
    if held:
        yield done()


def links(distinct: DataFrame, t: int = 2, tagged: bool = False) -> DataFrame:
    """A forest (u, v) that spans the same components as all pairs of fingerprints (column fp, distinct) within t bits.

    tagged: only the low 46 bits are a fingerprint, and those above tell sets apart between which there are no links.
    """
    count = distinct.count()
    parts = parts_for(count * 61, 400_000, least=4)
    sent = distinct.select("fp").mapInArrow(lambda it: _send(it, t, tagged), "anchor bigint, fp bigint, home boolean")
    return sent.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(lambda it: _compare(it, t), "u bigint, v bigint")


def cluster(docs: DataFrame, keep: list[str], shingle: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """keep, ``fp`` and ``component_id``: the smallest doc_id that links lead to.

    A null or empty text has fingerprint zero and is linked like any other.  Rows
    that repeat an id count each; a null id is never the smallest, and a component
    of null ids alone has a null one.  An empty table gives none.  Columns of docs
    named fp or component_id are replaced.
    """
    keep = [c for c in keep if c not in ("fp", "component_id")]
    rows = docs.select(*(F.col(c).alias(f"_c{k}") for k, c in enumerate(keep)), F.col("doc_id").alias("_id"), F.col("text"))
    carried = [f"_c{k}" for k in range(len(keep))]
    printed = materialise(fingerprints(rows, [*carried, "_id"], shingle, seed), "fingerprints")
    classes = materialise(printed.groupBy("fp").agg(F.min("_id").alias("least")), "classes")
    rooted = components(links(classes, distance))
    of_class = classes.join(rooted, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    # only classes with links need their root's row; the others are their own
    labels = of_class.join(named, "root").select("fp", "component_id")
    # many documents may share one fingerprint: one row on the right, adaptive execution splits the left
    return printed.join(labels, "fp").select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(keep)), "fp", "component_id")


def hex16(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
