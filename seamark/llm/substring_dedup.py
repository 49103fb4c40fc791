"""Removal of repeated word windows (operator 2).

A first pass fills a count-min sketch.  Not every window is counted: of the runs of GRAM words
within a window the one of least hash is its anchor, so equal windows have equal
anchors at different places, and neighbouring windows mostly share theirs; one run in seven is an
anchor of any.  Each task sends, for each row of the sketch, the cells that its anchors hit and which of them were hit
twice; merging gives one bit for each cell, whether it was hit twice at least.
So a window's estimate, that of its anchor, is never too low: one whose cells are not all marked
starts nowhere else.  A second pass keeps only the windows that are marked in every row
and groups those by 96 bits of two independent hashes, which stand for the words
(of n different windows, n**2 / 2**97 pairs are expected to be taken for equal: one in 10**8 for 10**10 windows).

Only the first occurrence of a window in a chunk of documents needs the other
chunks: later ones are known to be repeats.  So a window that stands in a third of
all documents costs one entry a chunk, however often it occurs.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import parts_for, text_bytes

#: Words of one chunk; also bounds what a task holds.
CHUNK_WORDS = 1_000_000
BLOCK = 1 << 20
#: Words of an anchor; cells of the sketch for each anchor, and words for each anchor of windows of 20.
GRAM, CELLS_EACH, WORDS_EACH = 8, 4, 7
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NULL_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _rolled(words: np.ndarray, width: int, r: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of width values, in log2(width) passes."""
    out, have, power, got = None, 0, r, words
    size, left = 1, width
    while left:
        if left & 1:
            if out is None:
                out, have = got, size
            else:  # what stands ahead, then this power of two
                n = len(words) - have - size + 1
                scale = np.uint64(pow(int(r), size, 1 << 64))
                out = out[:n] * scale + got[have : have + n]
                have += size
        left >>= 1
        if left:
            got = got[: len(got) - size] * power + got[size:]
            power = power * power
            size *= 2
    return out


def window_hashes(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return _mix(_rolled(_mix(words), width, _A)), _mix(_rolled(_mix(words ^ _B), width, _B))


def split_words(text: str | None) -> list[bytes]:
    """bytes.split() cuts at exactly the six ASCII separators."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Chunk:
    """Documents of some million words: ids, digests, and the windows of each."""

    def __init__(self, width: int):
        self.width, self.ids, self.digests, self.words, self.sizes, self.n = width, [], [], [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        import xxhash

        words = split_words(text)
        if len(words) < self.width:
            return
        self.ids.append(_NULL_ID if doc_id is None else doc_id)
        self.digests.append(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
        self.words.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        self.sizes.append(len(words))
        self.n += len(words)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window its position in the chunk, the position of its document, its start; windows never cross documents."""
        sizes = np.array(self.sizes, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.flatnonzero(start + self.width <= sizes[doc]) if len(sizes) else np.zeros(0, np.int64)
        return at, doc[at], start[at]

    def anchors(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the anchors of windows at these positions, each place once; and which of them is each window's."""
        gram = min(GRAM, self.width)
        with np.errstate(over="ignore"):
            h = _mix(_rolled(_mix(np.concatenate(self.words)), gram, _A))
        least = np.lib.stride_tricks.sliding_window_view(h, self.width - gram + 1).argmin(axis=1)  # the first of equal ones
        place, which = np.unique(at + least[at], return_inverse=True)
        return h[place], which

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h1, h2 = window_hashes(np.concatenate(self.words), self.width)
        return h1[at], h2[at]


def _chunks(batches, width: int):
    chunk = Chunk(width)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                chunk.add(doc_id, text)
                if chunk.n >= CHUNK_WORDS:
                    yield chunk
                    chunk = Chunk(width)
    yield chunk


def _cells(h: np.ndarray, log_cells: int) -> list[np.ndarray]:
    """The cell of each anchor in the two rows of the sketch."""
    shift = np.uint64(64 - log_cells)
    with np.errstate(over="ignore"):
        return [h >> shift, _mix(h * _B + _A) >> shift]


def _packed(x: np.ndarray) -> bytes:
    """Sorted cells of a block as compressed differences."""
    return pa.compress(np.diff(x.astype(np.int64), prepend=0).astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64))


def _sketch(batches, width: int, log_cells: int):
    for chunk in _chunks(batches, width):
        at, _, _ = chunk.places()
        if not len(at):
            continue
        out = []
        for row, cells in enumerate(_cells(chunk.anchors(at)[0], log_cells)):
            cell, times = np.unique(cells.astype(np.int64), return_counts=True)
            cuts = np.flatnonzero(np.diff(cell // BLOCK, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(cell)]):
                block, twice = int(cell[a] // BLOCK), cell[a:b][times[a:b] > 1]
                base = block * BLOCK
                out.append((row << 40 | block, b - a, _packed(cell[a:b] - base), len(twice), _packed(twice - base)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], names=["block", "n", "once", "m", "twice"])


def _merge_blocks(batches):
    """Bits of the cells hit twice; blocks arrive sorted, so only one is held."""
    now, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for block, n, a, m, b in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if block != now:
                if now is not None:
                    yield done()
                now, once, twice = block, np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
            hit = _unpacked(a, n)
            twice[hit[once[hit]]] = True
            once[hit] = True
            if m:
                twice[_unpacked(b, m)] = True
    if now is not None:
        yield done()


def sketch(docs: DataFrame, width: int, log_cells: int, parts: int) -> dict[int, bytes]:
    """The merged sketch, at most 2 * 2**log_cells bits: {row and block: bits}."""
    sent = docs.select("doc_id", "text").mapInArrow(lambda it: _sketch(it, width, log_cells), "block bigint, n bigint, once binary, m bigint, twice binary")
    merged = sent.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_merge_blocks, "block bigint, bits binary")
    return {r.block: bytes(r.bits) for r in merged.toLocalIterator()}


class Marks:
    """The merged sketch in a worker."""

    def __init__(self, blocks: dict[int, bytes], log_cells: int):
        size = max(1, (1 << log_cells) // 8)
        self.rows = [np.zeros(max(size, BLOCK // 8), np.uint8) for _ in range(2)]
        for key, bits in blocks.items():
            at = (key & ((1 << 40) - 1)) * (BLOCK // 8)
            self.rows[key >> 40][at : at + len(bits)] = np.frombuffer(bits, np.uint8)
        self.log_cells = log_cells

    def repeated(self, h: np.ndarray) -> np.ndarray:
        """False only for anchors that occur once."""
        ok = np.ones(len(h), bool)
        for bits, cells in zip(self.rows, _cells(h, self.log_cells)):
            cells = cells.astype(np.int64)
            ok &= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return ok


_marks: dict[str, Marks] = {}


def _marks_of(shared, key: str, log_cells: int) -> Marks:
    """key: of one call, as a worker may serve several."""
    if key not in _marks:
        _marks.clear()
        _marks[key] = Marks(shared.value, log_cells)
    return _marks[key]


def _blob(ids, digests, doc, start, *more) -> bytes:
    """Windows of some documents, sorted by document and start, as one compressed string.

    ids and digests are those of the chunk, doc indexes them; more: further arrays of the same length.
    """
    used, at = np.unique(doc, return_inverse=True)
    body = np.array([len(used), len(doc)], "<i8").tobytes()
    parts = [ids[used].astype("<i8"), digests[used].astype("<u8"), np.bincount(at, minlength=len(used)).astype("<u4"), np.diff(start, prepend=0).astype("<i4"), *more]
    body += b"".join(x.tobytes() for x in parts)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unblob(data: bytes, *more: str):
    body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n_docs, n = np.frombuffer(body, "<i8", 2).tolist()
    at, out = 16, []
    for kind, k in (("<i8", n_docs), ("<u8", n_docs), ("<u4", n_docs), ("<i4", n), *((m, n) for m in more)):
        out.append(np.frombuffer(body, kind, k, at))
        at += out[-1].nbytes
    ids, digests, counts, steps, *rest = out
    doc = np.repeat(np.arange(n_docs), counts)
    return ids, digests, doc, np.cumsum(steps.astype(np.int64)), *rest


def _home(ids: np.ndarray, parts: int) -> np.ndarray:
    """The group of each document for the last step; remove_repeats has the same in SQL."""
    return ids % 1_000_003 % parts


def _rows(out: list[tuple[int, int, bytes]]):
    kinds = (pa.int32(), pa.int64(), pa.binary())
    for at in range(0, len(out), 256):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 256]), kinds)], names=["kind", "part", "data"])


def _by_home(ids, digests, doc, start, parts: int):
    """Repeats, dealt by the document's group."""
    if not len(doc):
        return
    home = _home(ids, parts)[doc]
    order = np.lexsort((start, doc, home))
    doc, start, home = doc[order], start[order], home[order]
    cuts = np.flatnonzero(np.diff(home, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(home)]):
        yield int(home[a]), _blob(ids, digests, doc[a:b], start[a:b])


def _candidates(batches, width: int, shared, key: str, log_cells: int, groups: int, parts: int):
    """kind 0: first occurrences in this chunk, by window group; kind 1: later ones, by document group."""
    marks = _marks_of(shared, key, log_cells)
    for chunk in _chunks(batches, width):
        at, doc, start = chunk.places()
        if not len(at):
            continue
        ids, digests = np.array(chunk.ids, np.int64), np.array(chunk.digests, np.uint64)
        anchors, which = chunk.anchors(at)
        ok = np.flatnonzero(marks.repeated(anchors)[which])
        if not len(ok):
            continue
        h1, h2 = chunk.hashes(at[ok])
        h2, doc, start = (h2 >> np.uint64(32)).astype(np.uint32), doc[ok], start[ok]
        order = np.lexsort((start, ids[doc], h2, h1))
        h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
        at = ids[doc]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (at != at[first]) | (start != start[first])  # rows with one id and equal texts share their places
        out = [(1, p, data) for p, data in _by_home(ids, digests, doc[later], start[later], parts)]
        k = np.flatnonzero(~later)
        h1, h2, doc, start = h1[k], h2[k], doc[k], start[k]
        group = (h1 % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((start, doc, group))
        h1, h2, doc, start, group = h1[order], h2[order], doc[order], start[order], group[order]
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        out += [(0, int(group[a]), _blob(ids, digests, doc[a:b], start[a:b], h1[a:b].astype("<u8"), h2[a:b].astype("<u4"))) for a, b in zip(cuts, [*cuts[1:], len(group)])]
        yield from _rows(out)


def _exact(batches, parts: int):
    """Groups equal windows; everything but the earliest place goes to its document's group."""
    held: list[bytes] = []
    now = None

    def done():
        got = [_unblob(x, "<u8", "<u4") for x in held]
        base = np.cumsum([0, *(len(g[0]) for g in got)])
        ids, digests = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        doc = np.concatenate([g[2] + b for g, b in zip(got, base)])
        start, h1, h2 = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5))
        order = np.lexsort((start, ids[doc], h2, h1))
        h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
        at = ids[doc]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (at != at[first]) | (start != start[first])
        yield from _rows([(1, p, data) for p, data in _by_home(ids, digests, doc[later], start[later], parts)])

    for batch in batches:
        passed = []
        for kind, part, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if kind:
                passed.append((kind, part, data))
                continue
            if part != now and held:
                yield from done()
                held = []
            now = part
            held.append(data)
        yield from _rows(passed)
    if held:
        yield from done()


def _kept_words(words: list[bytes], starts: np.ndarray | None, width: int) -> tuple[list[bytes], int]:
    if starts is None or not len(starts):
        return words, 0
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    keep = np.cumsum(step[:-1]) == 0
    return [words[k] for k in np.flatnonzero(keep)], int(len(words) - keep.sum())


def _assemble(batches, width: int, keep: int):
    """Marks of a group of documents come first, then its documents."""
    import xxhash

    now, starts = None, {}
    for batch in batches:
        for begin in range(0, batch.num_rows, 256):
            part = batch.slice(begin, 256)
            cols = [part.column(k).to_pylist() for k in range(5)]
            rows, out = [], []
            for k, (group, is_doc, data, doc_id, text) in enumerate(zip(*cols)):
                if group != now:
                    now, starts = group, {}
                if not is_doc:
                    ids, digests, doc, start = _unblob(data)
                    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
                    for a, b in zip(cuts, [*cuts[1:], len(doc)]):
                        starts.setdefault((int(ids[doc[a]]), int(digests[doc[a]])), []).append(start[a:b].astype(np.int32))
                    continue
                words = split_words(text)
                found = None
                if len(words) >= width:
                    found = starts.get((_NULL_ID if doc_id is None else doc_id, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))))
                left, removed = _kept_words(words, np.concatenate(found) if found else None, width)
                rows.append(k)
                out.append((len(words), removed, (b" ".join(left)).decode("utf-8", "surrogatepass")))
            if rows:
                part = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(5, 5 + keep)] + [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=[*part.schema.names[5:], "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, width: int = 20, max_log_cells: int = 30, keep: list[str] | None = None) -> DataFrame:
    """Remove every word that a window with an earlier equal window covers.

    Earlier: in a document of smaller doc_id, or in the same document at a smaller
    start; windows are judged on the input.  Returns the columns keep of docs (all
    but text) with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined
    by one blank).

    max_log_cells bounds the sketch: two rows of at most 2**max_log_cells bits (256 MB
    at 30) are broadcast.  Below that bound, which some 11 GB of text reach, a row has at least four cells an
    anchor, so one window in twenty passes without need; beyond it more windows pass to the exact step (half of
    them at 50 GB), and none is lost.

    Null ids come before all others.  A null text has no words.  Rows that repeat
    an id are judged each: against equal places (same id, same start) neither
    is earlier, so exact repeats of a row stay alike.  Columns of docs named like
    results are replaced.  An empty table gives none.
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("text", "n_words", "n_removed", "kept_text")]
    total = text_bytes(docs)  # sizes only
    log_cells = max(20, min(max_log_cells, int(np.ceil(np.log2(max(1, total) / 6 / WORDS_EACH * CELLS_EACH)))))  # six bytes a word
    groups = parts_for(total, 10e6, least=8)
    shared = spark.sparkContext.broadcast(sketch(docs, width, log_cells, parts_for(2 * 2**log_cells, BLOCK * 8, most=groups)))
    key = uuid.uuid4().hex
    found = docs.select("doc_id", "text").mapInArrow(lambda it: _candidates(it, width, shared, key, log_cells, groups, groups), "kind int, part bigint, data binary")
    spread = F.when(F.col("kind") == 0, F.col("part")).otherwise(F.pmod(F.xxhash64("part", "data"), F.lit(groups)))
    exact = found.withColumn("to", spread).repartition(groups, "to").sortWithinPartitions("kind", "part").select("kind", "part", "data")
    marked = exact.mapInArrow(lambda it: _exact(it, groups), "kind int, part bigint, data binary")
    carried = [F.col(c).alias(f"_c{k}") for k, c in enumerate(names)]
    with_home = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), *carried)
    texts = with_home.withColumn("home", F.pmod(F.pmod(F.coalesce(F.col("doc_id"), F.lit(_NULL_ID)), F.lit(1_000_003)), F.lit(groups)))
    fields = {f.name: f.dataType for f in docs.schema}
    blank = marked.select(F.col("part").alias("home"), F.lit(False).alias("is_doc"), "data", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), *(F.lit(None).cast(fields[c]).alias(f"_c{k}") for k, c in enumerate(names)))
    both = blank.unionByName(texts.withColumns({"is_doc": F.lit(True), "data": F.lit(None).cast("binary")}))
    schema = ", ".join([*(f"`_c{k}` {fields[c].simpleString()}" for k, c in enumerate(names)), "n_words bigint, n_removed bigint, kept_text string"])
    n = len(names)
    done = both.repartition(groups, "home").sortWithinPartitions("home", "is_doc").mapInArrow(lambda it: _assemble(it, width, n), schema)
    return done.select(*(F.col(f"_c{k}").alias(c) for k, c in enumerate(names)), "n_words", "n_removed", "kept_text")
