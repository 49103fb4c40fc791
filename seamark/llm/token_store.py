"""Content-addressed store for token ids (operator 4).

A rolling hash over the ids cuts every document's stream into chunks, so equal
passages give equal chunks wherever they stand.  A chunk is named by the digest of
its bytes and stored once; a document is a recipe, the list of its chunks' names;
its Merkle root over these names, the root of each range of recipes over its documents, and the
root of the store over its ranges let a reader verify what it rebuilds: chunks, recipes, ranges or
files that are lost, changed or cut short raise a ValueError, or Spark's error for the file.

Layout under the store's path:

* ``data/table=chunks``: digest (16 bytes), n, data (ids as little-endian unsigned 16
  or 32-bit integers), one row for each different chunk;
* ``recipes``: doc_id, start, n_tokens, chunk names in order, Merkle root; files and
  their rows in ascending doc_id order;
* ``manifest``: for each range of recipes its documents, ids, first start and Merkle root
  over the documents' roots; and one row (file -1) for the store, its root over the ranges' roots.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamark.llm.common import parts_for, release, slices, text_bytes

DIGEST = 16

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian unsigned 32-bit integers, which this machine's arrays are not")
#: A chunk ends where the rolling hash of the last WINDOW ids has MASK_BITS low zeros, between LEAST and MOST ids.
WINDOW, MASK_BITS, LEAST, MOST = 16, 8, 64, 2048
_R = np.uint64(0x9E3779B97F4A7C15)


def _candidates(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash lets a chunk end; each depends on the WINDOW ids before it alone."""
    if len(ids) < WINDOW:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * _R
        x ^= x >> np.uint64(29)
        size, h, r = 1, x, _R
        while size < WINDOW:  # doubling: the hash of 2k ids from two of k
            h = h[: len(h) - size] * r + h[size:]
            r, size = r * r, size * 2
        h ^= h >> np.uint64(32)
        h = h * np.uint64(0xD6E8FEB86659FD93)
    return np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + WINDOW


def _ends(candidates: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the ids from begin to end; candidates: places within them."""
    if end - begin <= LEAST:
        return [end] if end > begin else []
    out, last = [], begin
    for e in [*candidates, end]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST or e == end and e > last:
            out.append(e)
            last = e
    return out


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream; they depend only on ids nearby, except where MOST forces one."""
    return _ends(_candidates(ids).tolist(), 0, len(ids))


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(names: list[bytes]) -> bytes:
    """Root over names; an odd one moves up as it is, no names give the digest of nothing."""
    level = [digest(b"\0" + x) for x in names] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[k : k + 2])) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


# crc32 of joined chunks from the chunks' own: appending n zero bytes multiplies by x**(8n) modulo the polynomial
_POLY = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in GF(2)[x] modulo the polynomial, reflected bits."""
    out, b = np.zeros_like(a), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(_POLY), np.uint32(0))
    return out


def _zeros(n_bytes: np.ndarray) -> np.ndarray:
    """x**(8n) for each n."""
    out = np.full(len(n_bytes), 1 << 31, np.uint32)  # one
    power, left = np.array([1 << 23], np.uint32), n_bytes.astype(np.int64).copy()  # x**8
    while left.any():
        out = np.where(left & 1, _times(out, np.broadcast_to(power, out.shape)), out)
        power, left = _times(power, power), left >> 1
    return out


def crc32_joined(crcs: np.ndarray, lengths: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """crc32 of each owner's chunks joined in order, from each chunk's crc32 and length in bytes; owner is sorted."""
    if not len(crcs):
        return np.zeros(owners, np.uint32)
    upto = np.cumsum(lengths)
    total = np.bincount(owner, weights=lengths, minlength=owners).astype(np.int64)
    end = np.cumsum(total)[owner]
    moved = _times(crcs.astype(np.uint32), _zeros(end - upto))
    out = np.zeros(owners, np.uint32)
    np.bitwise_xor.at(out, owner, moved)
    return out


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flat (begin, size) in the order of code: their sizes, the runs in a row, and where each begins, with the end."""
    n = size[code]
    upto = np.concatenate([[0], np.cumsum(n)])
    return n, flat[np.repeat(begin[code] - upto[:-1], n) + np.arange(upto[-1])], upto


class WordTokenizer:
    """A tokenizers file; texts are encoded by word where that is the same, else whole."""

    #: Marks that may follow a word's letters; the library parts them from these.
    MARKS = ".,!?;:#*$%&|"
    #: Letters that normal form or lower case turn into more than letters, or by what stands beside them.
    ODD = "[\u03a3" + "".join(c for c in map(chr, range(0xC0, 0x30000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha()) + "]"

    def __init__(self, data: bytes, kept: int = 400_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_buffer(data)
        #: Ids of runs of letters, of marks, and of words that are neither; emptied before a batch once it is full.
        self.parts: dict[str, bytes] = {}
        self.kept = kept
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        #: White space on which Arrow and the library could differ; texts that hold any are encoded whole.
        self.odd = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]").search
        ids = self._ids
        #: Whether words can be cut at white space, lowered (A-Z), and their letters and marks encoded apart.
        self.cuts = ids("ab cd") == ids("ab") + ids("cd")
        self.lowers = ids("Ab,") == ids("ab,")
        self.splits = ids("ab,") == ids("ab") + ids(",") and ids("\u00e9l!!") == ids("\u00e9l") + ids("!!")
        #: Which ids end a word, for files that mark it.
        suffix = json.loads(data).get("model", {}).get("end_of_word_suffix")
        self.last = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self.last[[i for token, i in self.whole.get_vocab().items() if token.endswith(suffix)]] = True

    def _ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, letters: list[str], at_once: int = 64) -> list[bytes]:
        """Ids of runs of letters, many to a text; an id that ends a word tells where one stops."""
        lines = [" ".join(letters[k : k + at_once]) for k in range(0, len(letters), at_once)]
        ids = np.array([i for e in self.whole.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(letters) or ends and ends[-1] != 4 * len(ids):
            return self._each(letters)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _table(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different strings in a row, and how many each has."""
        strings, parts, odd = strings.to_pylist(), self.parts, re.compile(self.ODD).search
        found = list(map(parts.get, strings))
        new = [x for x, f in zip(strings, found) if f is None]
        if new:
            letters = [x for x in new if self.splits and x.isalpha() and (x.isascii() or not odd(x))]
            parts.update(zip(letters, self._joined(letters)))
            rest = [x for x in new if x not in parts]
            parts.update(zip(rest, self._each(rest)))
            found = [parts[x] if f is None else f for x, f in zip(strings, found)]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words in a row, and how many each has; by their letters and marks where that is the same."""
        heads = pc.utf8_rtrim(words, characters=self.MARKS)
        fits = pc.and_(pc.utf8_is_alpha(heads), pc.invert(pc.match_substring_regex(heads, self.ODD)))
        heads = pc.if_else(fits if self.splits else pa.scalar(False), heads, words)
        # what follows the letters, from the words' own bytes
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, "<i8")[words.offset : words.offset + len(words) + 1]
        letters = pc.binary_length(heads).to_numpy()
        _, marks, upto = _gathered(np.frombuffer(data or b"", np.uint8), ends[:-1] + letters, np.diff(ends) - letters, np.arange(len(words)))
        tails = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(upto.astype("<i8").tobytes()), pa.py_buffer(marks.tobytes()))
        flat, sizes, codes = [], [], []
        for x in (heads.dictionary_encode(), tails.dictionary_encode()):
            ids, size = self._table(x.dictionary)
            codes.append(x.indices.to_numpy() + sum(map(len, sizes)))
            flat.append(ids)
            sizes.append(size)
        size = np.concatenate(sizes)
        n, ids, _ = _gathered(np.concatenate(flat), np.cumsum(size) - size, size, np.stack(codes, axis=1).ravel())
        return ids, n.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's end; a null is empty."""
        if len(self.parts) >= self.kept:
            self.parts.clear()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = {k: t for k, t in enumerate(texts.to_pylist()) if not self.cuts or self.odd(t) or any(x in t for x in self.special)}
        if odd:
            by_hand = np.zeros(len(texts), bool)
            by_hand[list(odd)] = True
            texts = pc.if_else(pa.array(by_hand), "", texts)
        for space in "\t\n\r":
            texts = pc.replace_substring(texts, space, " ")
        split = pc.split_pattern(pc.ascii_lower(texts) if self.lowers else texts, " ")  # two in a row give an empty word, without ids
        coded = split.values.dictionary_encode()
        flat, size = self._words(coded.dictionary)
        _, ids, upto = _gathered(flat, np.cumsum(size) - size, size, coded.indices.to_numpy())
        ends = upto[split.offsets.to_numpy()[1:]]
        if odd:
            cuts = np.concatenate([[0], ends])
            each = [np.array(self._ids(odd[k]), "<u4") if k in odd else ids[cuts[k] : cuts[k + 1]] for k in range(len(texts))]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        return ids, ends


_tokenizers: dict[bytes, WordTokenizer] = {}


def _tokenizer(data: bytes) -> WordTokenizer:
    if data not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[data] = WordTokenizer(data)
    return _tokenizers[data]


_SENT = "digest binary, doc_id bigint, data binary, n bigint, root binary"
_KINDS = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary())


def _encode(batches, shared, end_id: int, kind: str):
    """Chunks (with a digest) that are new in this task, and recipes (without; data: the names joined)."""
    run, seen = _tokenizer(shared.value), set()
    wide = np.dtype(kind).itemsize
    for batch in batches:
        for part in slices(batch, 2048):
            out = []
            ids, ends = run.encode(part.column("text"))
            ids = np.insert(ids, ends, np.uint32(end_id))
            data, places = ids.astype(kind).tobytes(), _candidates(ids)
            ends = ends + np.arange(1, len(ends) + 1)
            begins = np.concatenate([[0], ends[:-1]])
            # a place within a document looks back on ids of this document alone
            first, last = np.searchsorted(places, begins + WINDOW), np.searchsorted(places, ends, "right")
            places = places.tolist()
            for doc_id, begin, end, a, b in zip(part.column("doc_id").to_pylist(), begins.tolist(), ends.tolist(), first.tolist(), last.tolist()):
                names, at = [], begin
                for e in _ends(places[a:b], begin, end):
                    raw = data[at * wide : e * wide]
                    names.append(name := digest(raw))
                    if name not in seen:
                        if len(seen) > 500_000:
                            seen.clear()  # a chunk may then be sent again; the exchange keeps one
                        seen.add(name)
                        out.append((name, None, raw, e - at, None))
                    at = e
                out.append((None, doc_id, b"".join(names), end - begin, merkle(names)))
            for k in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 4096]), _KINDS)], names=["digest", "doc_id", "data", "n", "root"])
    release()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Encode docs (doc_id, text) and write the store.

    A null or empty text has the end id alone.  Null ids come first; rows that
    repeat an id have a recipe each, ordered by the recipes' names.  An empty table
    gives a store without rows; further columns are not read.  Text moves nowhere:
    only new chunks and recipes are shuffled, each chunk about once a task.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_buffer(raw).get_vocab_size(with_added_tokens=True), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(raw)  # the tokenizer's file, some MB
    parts = parts_for(text_bytes(docs), 12e6, least=4)
    sent = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda it: _encode(it, shared, end_id, kind), _SENT)
    table = F.when(F.col("digest").isNull(), "recipes").otherwise("chunks")
    # recipes have a number each, so that none is taken for another
    named = sent.withColumns({"table": table, "row": F.when(F.col("digest").isNull(), F.monotonically_increasing_id())})
    dealt = named.withColumn("to", F.pmod(F.xxhash64("digest", "row"), F.lit(parts))).repartition(parts, "to")
    once = dealt.groupBy("table", "to", "digest", "row").agg(*(F.first(c).alias(c) for c in ("doc_id", "data", "n", "root")))  # needs no further exchange
    once.select(*(x.split()[0] for x in _SENT.split(", ")), "table").write.partitionBy("table").option("compression", "zstd").parquet(f"{path}/data")
    order = [F.col("doc_id").asc_nulls_first(), F.col("data")]
    files = parts_for(parts, 4)
    _table(spark, path, "recipes").drop("digest").repartitionByRange(files, *order).withColumn("file", F.spark_partition_id()).write.parquet(f"{path}/ranges")
    ranges = spark.read.schema("doc_id bigint, data binary, n bigint, root binary, file int").parquet(f"{path}/ranges")
    first, at = [], 0
    for file, n in sorted(tuple(r) for r in ranges.groupBy("file").agg(F.sum("n")).collect()):  # a row for each file
        first.append((file, at))
        at += n
    begin = F.broadcast(spark.createDataFrame(first, "file int, begin bigint"))
    within = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one file's documents
    numbered = ranges.join(begin, "file").withColumn("start", F.col("begin") + F.sum("n").over(within) - F.col("n"))
    numbered.select("file", "doc_id", "start", F.col("n").alias("n_tokens"), F.col("data").alias("names"), "root").repartitionByRange(files, "start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    ranges = _ranges(recipes(spark, path))
    every = ranges.orderBy("start", "file").collect()  # a row for each file
    whole = (-1, sum(r.documents for r in every), sum(r.n_tokens for r in every), 0, merkle([bytes(r.root) for r in every]))
    spark.createDataFrame([*(tuple(r) for r in every), whole], _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


_MANIFEST = "file int, documents bigint, n_tokens bigint, start bigint, root binary"


def _range_roots(batches):
    """One row for each range; its documents are neighbours, by start."""
    now, roots, n, start = None, [], 0, 0

    def done():
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((now, pa.int32()), (len(roots), pa.int64()), (n, pa.int64()), (start, pa.int64()), (merkle(roots), pa.binary()))], names=["file", "documents", "n_tokens", "start", "root"])

    for batch in batches:
        for file, at, tokens, root in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if file != now:
                if now is not None:
                    yield done()
                now, roots, n, start = file, [], 0, at
            if at != start + n:
                raise ValueError(f"documents are missing before the one at {at}")
            roots.append(root)
            n += tokens
    if now is not None:
        yield done()


def _ranges(found: DataFrame) -> DataFrame:
    """What the recipes found say of each range."""
    return found.select("file", "start", "n_tokens", "root").repartition("file").sortWithinPartitions("file", "start").mapInArrow(_range_roots, _MANIFEST)


def verify(spark: SparkSession, path: str) -> None:
    """Raises unless the recipes are those of the manifest, and the manifest is whole."""
    kept = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    rows = sorted(tuple(r) for r in kept.collect())  # a row for each file
    if not rows or rows[0][0] != -1:
        raise ValueError("the manifest is lost")
    (_, documents, tokens, _, root), *each = rows
    each.sort(key=lambda r: (r[3], r[0]))
    if documents != sum(r[1] for r in each) or tokens != sum(r[2] for r in each) or root != merkle([bytes(r[4]) for r in each]):
        raise ValueError("the manifest is damaged")
    names = ["documents", "n_tokens", "start", "root"]
    both = _ranges(recipes(spark, path)).alias("a").join(kept.where("file >= 0").alias("b"), "file", "full")
    differ = F.lit(False)
    for c in names:
        differ |= ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    bad = both.where(differ).select("file").first()
    if bad is not None:
        raise ValueError(f"the recipes of range {bad.file} are not those of the manifest")


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(f"{_SENT}, table string").parquet(f"{path}/data").where(F.col("table") == name).drop("table")


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """file, doc_id, start, n_tokens, names (digests joined), root."""
    return spark.read.schema("file int, doc_id bigint, start bigint, n_tokens bigint, names binary, root binary").parquet(f"{path}/recipes")


def _checked(batches, wide: int):
    """crc32 and length of each chunk over its ids as 32-bit integers, after its name is verified."""
    for batch in batches:
        rows = []
        for name, data, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if digest(data) != name:
                raise ValueError(f"chunk {name.hex()} does not have its name's content")
            ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4").tobytes()
            rows.append((name, zlib.crc32(ids), len(ids), ids if wide else None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["digest", "crc", "bytes", "ids"])


def _pieces(spark: SparkSession, path: str, wide: bool) -> DataFrame:
    """One row for each chunk of each document, with what the chunk holds."""
    chunks = _table(spark, path, "chunks").select("digest", "data", "n").mapInArrow(lambda it: _checked(it, wide), "digest binary, crc bigint, bytes bigint, ids binary")
    names = F.transform(F.sequence(F.lit(1), (F.length("names") / DIGEST).cast("int")), lambda k: F.substring(F.col("names"), (k - 1) * DIGEST + 1, F.lit(DIGEST)))
    exploded = recipes(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode(names).alias("pos", "digest"))
    # a chunk that many documents share is one row on the other side; adaptive execution splits its partition
    return exploded.join(chunks if wide else chunks.drop("ids"), "digest", "left")


def _runs(batches, key: str):
    """Batches of whole documents; rows of one document are neighbours."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        rest = batch.slice(last)
        if last:
            yield batch.slice(0, last)
    if rest is not None and rest.num_rows:
        yield rest


def _verified(batch):
    """Row numbers of each document's first chunk, its owner array; raises where the root does not fit."""
    starts = batch.column("start").to_numpy()
    begin = np.flatnonzero(np.diff(starts, prepend=-1))
    owner = np.repeat(np.arange(len(begin)), np.diff([*begin, len(starts)]))
    names, roots = batch.column("digest").to_pylist(), batch.column("root").to_pylist()
    if batch.column(batch.num_columns - 1).null_count:
        raise ValueError("a chunk is lost")
    for a, b in zip(begin, [*begin[1:], len(starts)]):
        if merkle(names[a:b]) != roots[a]:
            raise ValueError(f"the document at {starts[a]} does not have its recipe's root")
    return begin, owner


def _sums(batches):
    for batch in _runs(batches, "start"):
        begin, owner = _verified(batch)
        crc = crc32_joined(batch.column("crc").to_numpy().astype(np.uint32), batch.column("bytes").to_numpy(), owner, len(begin))
        heads = batch.take(pa.array(begin))
        got = np.bincount(owner, weights=batch.column("bytes").to_numpy(), minlength=len(begin)).astype(np.int64) // 4
        if not np.array_equal(got, heads.column("n_tokens").to_numpy()):
            raise ValueError("a document does not have its recipe's length")
        yield pa.RecordBatch.from_arrays([heads.column("doc_id"), heads.column("start"), pa.array(got), pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _joined(batches):
    for batch in _runs(batches, "start"):
        begin, owner = _verified(batch)
        ids = batch.column("ids").to_pylist()
        heads = batch.take(pa.array(begin))
        whole = [b"".join(ids[a:b]) for a, b in zip(begin, [*begin[1:], len(ids)])]
        yield pa.RecordBatch.from_arrays([heads.column("doc_id"), heads.column("start"), heads.column("n_tokens"), pa.array(whole, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition(F.col("start")).sortWithinPartitions("start", "pos")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    The manifest, and every recipe against it, are verified first; then every chunk's name, every
    recipe's Merkle root and length.  The crc32 of a document is made of its chunks' own, so no ids are shuffled.
    """
    verify(spark, path)
    rows = _pieces(spark, path, False).select("doc_id", "start", "n_tokens", "root", "pos", "digest", "crc", "bytes")
    return _in_order(rows).mapInArrow(_sums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, verified as in checksums."""
    verify(spark, path)
    rows = _pieces(spark, path, True).select("doc_id", "start", "n_tokens", "root", "pos", "digest", "ids")
    return _in_order(rows).mapInArrow(_joined, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
