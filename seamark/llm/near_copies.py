"""One document of each group of near copies (the corpus pipeline's second stage).

SimHash proposes, shingles decide.  Five fingerprints of 46 bits over each text's
different words, each with its own seed, go through the anchors of operator 10 with two bits of
distance; texts that meet in any of them are candidates (97 in 100 pairs of the wanted
likeness were, in the tables measured; each further seed halves what is missed).  Candidates
are then compared by the 64-bit hashes of all their five-word shingles, and are near
copies from a Jaccard similarity of 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamark.llm.common import materialise, runs, slices
from seamark.llm.components import components
from seamark.llm.simhash import CODE_BITS, links

SEEDS, SHINGLE, SIMILARITY = 5, 5, 0.8
#: Larger groups of candidates are dealt into shares of SHARE texts, about PIVOTS of which go to every share.
SHARE, PIVOTS = 2_000, 32


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> bytes:
    """Hashes of a text's different shingles, sorted; a text of fewer words is one shingle."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    joined = [b" ".join(words)] if len(words) < SHINGLE else set(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)))))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, joined), "<u8", len(joined))).tobytes()


def prints(text: str | None) -> list[int]:
    """Fingerprints of a text's different words, each below its seed."""
    import xxhash

    own = set(text.encode("utf-8", "surrogatepass").lower().split()) if text else set()
    base = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    found = []
    for seed in range(SEEDS):
        bits = np.unpackbits(_mix(base, seed + 1).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) if len(base) else np.zeros(64, np.int64)
        value = int.from_bytes(np.packbits(2 * bits > len(base), bitorder="little").tobytes(), "little") & ((1 << CODE_BITS) - 1)
        found.append(seed << CODE_BITS | value)
    return found


def _signatures(batches):
    for batch in batches:
        for part in slices(batch):
            got = pa.array(list(map(prints, part.column("text").to_pylist())), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "doc_id", "key")), got], names=["rid", "doc_id", "key", "prints"])


def _shingled(batches):
    for batch in batches:
        for part in slices(batch):
            got = pa.array(list(map(shingles, part.column("text").to_pylist())), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("root"), part.column("rid"), got], names=["root", "rid", "shingles"])


def _group(sets: list[np.ndarray], known: list[int]) -> list[int]:
    """The position of the first text that links lead to, for each text; every pair is settled.

    Texts with the same value of known are joined from the start.
    Two sets with a Jaccard similarity of t share one of the first n - ceil(t n) + 1 of either
    under any common order, here rarest first; pairs that share none, or that links
    already join, need no comparison.
    """
    _, first, which = np.unique(known, return_index=True, return_inverse=True)
    root = first[which]
    count, n = len(sets), np.array([len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, begin = np.repeat(np.arange(count), n), np.concatenate([[0], np.cumsum(n)])
    code = code[np.lexsort((code, times[code], owner))]
    prefix = n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1
    leads = (np.arange(len(code)) - begin[owner] < prefix[owner]) & (times[code] > 1)
    token, holder = code[leads], owner[leads]
    own = np.searchsorted(holder, np.arange(count + 1))
    by = np.argsort(token, kind="stable")
    holders, lists = holder[by], np.searchsorted(token[by], np.arange(len(times) + 1))
    mark = np.zeros(len(times), bool)
    for j in range(count):
        mine = token[own[j] : own[j + 1]]
        size = lists[mine + 1] - lists[mine]
        at = np.repeat(lists[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        met = np.zeros(count, bool)
        met[holders[at]] = True
        met[j:] = False
        met &= np.minimum(n, n[j]) >= SIMILARITY * np.maximum(n, n[j]) - 1e-9
        near, chunk = np.flatnonzero(met), 4
        mark[code[begin[j] : begin[j + 1]]] = True
        while len(near := near[root[near] != root[j]]):
            some, near, chunk = near[:chunk], near[chunk:], min(256, chunk * 4)
            both = np.array([np.count_nonzero(mark[code[begin[i] : begin[i + 1]]]) for i in some])
            for i in some[both >= SIMILARITY * (n[some] + n[j] - both) - 1e-9]:
                x, y = sorted((root[i], root[j]))
                root[root == y] = x
        mark[code[begin[j] : begin[j + 1]]] = False
    return root.tolist()


def _decide(batches):
    """(u, v) that span the same components as known links and all pairs of near copies within a part."""
    for batch in runs(batches, "part"):
        parts = batch.column("part").to_numpy()
        cuts = np.flatnonzero(np.diff(parts, prepend=parts[0] - 1))
        rid, known = (batch.column(c).to_pylist() for c in ("rid", "known"))
        sets = [np.frombuffer(s, "<u8") for s in batch.column("shingles").to_pylist()]
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(parts)]):
            out += [(rid[a + i], rid[a + k]) for i, k in enumerate(_group(sets[a:b], known[a:b])) if k != i]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["u", "v"])


def _compared(rows: DataFrame, parts: Column) -> DataFrame:
    """rows: rid, known, shingles; each goes to all of its parts, and those of a part are compared."""
    dealt = rows.select(F.explode(parts).alias("part"), "rid", "known", "shingles")
    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_decide, "u bigint, v bigint")


def _each(count: Column, part) -> Column:
    return F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), part)


def verified(candidates: DataFrame) -> DataFrame:
    """(u, v) that span the same components as all pairs of near copies within a group.

    candidates: root (the group), rid, shingles.  Groups are compared in shares,
    and some texts in all of them.  Where this leaves a group in several components, its
    largest one meets all other texts, and they each other, share by share: every
    pair that links do not join is compared, and no task holds over two shares.
    """
    part, draw = F.xxhash64, F.xxhash64("rid")
    sizes = candidates.groupBy("root").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    sized = materialise(candidates.join(sizes, "root"), "candidates")
    pivot = (F.col("shares") > 1) & (F.pmod(F.xxhash64("rid", F.lit(1)), F.col("shares") * SHARE) < PIVOTS)
    own = F.array(part("root", F.pmod(draw, F.col("shares"))))
    first = materialise(_compared(sized.withColumn("known", F.col("rid")), F.when(pivot, _each(F.col("shares"), lambda q: part("root", q))).otherwise(own)), "verified")
    large = sized.where("shares > 1")
    if large.isEmpty():
        return first
    joined = components(first).select(F.col("node").alias("rid"), F.col("root").alias("known"))
    placed = materialise(large.join(joined, "rid", "left").withColumn("known", F.coalesce("known", "rid")), "placed")
    most = placed.groupBy("root", "known").count().groupBy("root").agg(F.max(F.struct("count", "known")).alias("m"), F.sum("count").alias("all")).where("all > m.count")
    open_ = placed.join(most.select("root", F.col("m.known").alias("main"), F.ceil(F.col("m.count") / SHARE).alias("mains"), F.ceil((F.col("all") - F.col("m.count")) / SHARE).alias("rests")), "root")
    main, rest = F.pmod(draw, F.col("mains")), F.pmod(draw, F.col("rests"))
    among = _each(F.col("rests"), lambda q: part("root", F.lit(0), F.least(q, rest), F.greatest(q, rest)))
    across = _each(F.col("mains"), lambda q: part("root", F.lit(1), q, rest))
    to_rest = _each(F.col("rests"), lambda q: part("root", F.lit(1), main, q))
    return first.union(_compared(open_, F.when(F.col("known") == F.col("main"), to_rest).otherwise(F.concat(among, across))))


def _row_key(key: Column, doc_id: Column) -> Column:
    return F.concat_ws("/", key, F.coalesce(doc_id.cast("string"), F.lit("none")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group of copies and near copies.

    The smallest doc_id of a group stays (a null one only where all are null).  Null
    and empty texts are copies of one another.  Of rows that repeat both id and text one
    stays.  An empty table stays empty; all columns are returned as they came.
    """
    key = F.md5(F.coalesce("text", F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), "text")
    signed = materialise(rows.mapInArrow(_signatures, "rid bigint, doc_id bigint, key string, prints array<bigint>"), "signatures")
    # copies are one from here on: the smallest id stands for its text
    texts = materialise(
        signed.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("best"), F.min("prints").alias("prints")).select("key", F.col("best.rid").alias("rid"), F.col("best.doc_id").alias("doc_id"), "prints"), "texts"
    )
    printed = texts.select("rid", F.explode("prints").alias("fp"))
    nodes = materialise(printed.groupBy("fp").agg(F.min("rid").alias("node")), "nodes")
    same = printed.join(nodes, "fp").select(F.col("rid").alias("u"), F.col("node").alias("v"))
    near = links(nodes.select("fp"), 2, tagged=True).join(nodes.select(F.col("fp").alias("u"), F.col("node").alias("a")), "u").join(nodes.select(F.col("fp").alias("v"), F.col("node").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    rooted = components(same.union(near))
    groups = materialise(rooted.select(F.col("node").alias("rid"), "root").union(rooted.select(F.col("root").alias("rid"), "root").distinct()), "groups")
    # only candidates need their shingles; one row is enough where id and text repeat
    wanted = groups.join(texts, "rid").select("root", "rid", _row_key(F.col("key"), F.col("doc_id")).alias("_k"))
    met = docs.select(_row_key(key, F.col("doc_id").cast("bigint")).alias("_k"), "text").join(wanted, "_k")
    met = met.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("_k"))).where("_n = 1").select("root", "rid", "text")
    alike = components(verified(met.mapInArrow(_shingled, "root bigint, rid bigint, shingles binary")))
    members = alike.select(F.col("node").alias("rid"), "root").union(alike.select(F.col("root").alias("rid"), "root").distinct())
    first = members.join(texts.select("rid", "doc_id"), "rid").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("best"))
    followers = members.join(first.select(F.col("best.rid").alias("rid")), "rid", "left_anti")
    kept = materialise(texts.select("rid").join(followers, "rid", "left_anti"), "kept")
    stay = signed.select("rid", "doc_id", "key").join(kept, "rid", "left_semi").select(_row_key(F.col("key"), F.col("doc_id")).alias("_k"))
    # by text and id together, so that the rows of a frequent text are dealt out; the window then needs no further exchange
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _row_key(key, F.col("doc_id").cast("bigint")).alias("_k"))
    one = F.row_number().over(Window.partitionBy("_k").orderBy("_k"))
    return whole.join(stay, "_k").withColumn("_n", one).where("_n = 1").select("row.*")
