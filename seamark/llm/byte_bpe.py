"""Byte-level BPE by prefix dynamic programming (operator 3).

For every prefix of a byte string exactly one vocabulary entry can end its
encoding.  ``PrefixTokens`` stores that entry for each prefix, so the encoding of
any prefix is read off by walking back, bytes can be appended without touching
what is there, and an edit re-encodes only until the stored entries agree again.

Which entry ends a prefix is decided locally: among the entries that are suffixes
of the prefix, the one that may follow the entry ending the rest.  Two entries
may stand next to each other if merging their joint bytes keeps the border; that
is read from the order in which the right edge of the one and the left edge of
the other are merged (``Vocabulary.may_follow``).
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seamark.llm.common import slices

#: Rust's white space: Python's ``\s`` also takes U+001C to U+001F, which the patterns of rank files do not mean.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_NEVER = 1 << 40

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian unsigned 32-bit integers, which this machine's arrays are not")


def parse_ranks(data: bytes) -> list[bytes]:
    """Entries of a rank file, by rank."""
    got = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, data.splitlines()) if a)
    if [r for r, _ in got] != list(range(len(got))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in got]


class Vocabulary:
    """A rank file with what the dynamic programme needs: merge edges, neighbours and a suffix automaton."""

    def __init__(self, data: bytes, pairs_kept: int = 2_000_000):
        import ahocorasick

        self.tokens = parse_ranks(data)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.size = [len(t) for t in self.tokens]
        self.longest = max(self.size)
        self.pairs_kept = pairs_kept
        self._ok: dict[int, bool] = {}
        self._join: dict[int, int] = {}
        rank = self.rank
        for i, t in enumerate(self.tokens):
            for k in range(1, len(t)):
                a = rank.get(t[:k])
                if a is not None and (b := rank.get(t[k:])) is not None:
                    self._join[a << 20 | b] = i
        #: The two parts of an entry's last merge; None for single bytes and for entries that merging never makes.
        self.halves = [self._last_merge(t) for t in self.tokens]
        self._right: dict[int, list[int]] = {}
        self._left: dict[int, list[int]] = {}
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(self.tokens):
            if len(t) == 1 or self.halves[i]:
                self.auto.add_word(t.decode("latin-1"), i)
        self.auto.make_automaton()

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost on ties; quadratic, for entries and tests."""
        parts = [self.rank[data[i : i + 1]] for i in range(len(data))]
        while len(parts) > 1:
            low, at = min((self._join.get(a << 20 | b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if low == _NEVER:
                break
            parts[at : at + 2] = [low]
        return parts

    def _last_merge(self, t: bytes) -> tuple[int, int] | None:
        if len(t) == 1:
            return None
        parts = [self.rank[t[i : i + 1]] for i in range(len(t))]
        while len(parts) > 2:
            low, at = min((self._join.get(a << 20 | b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if low == _NEVER:
                return None
            parts[at : at + 2] = [low]
        return (parts[0], parts[1]) if self._join.get(parts[0] << 20 | parts[1]) == self.rank[t] else None

    def _edge(self, token: int, side: int, kept: dict[int, list[int]]) -> list[int]:
        """What stands at an entry's right (1) or left (0) border while it is merged, from the byte up."""
        got = kept.get(token)
        if got is None:
            got = [token]
            while (h := self.halves[got[-1]]) is not None:
                got.append(h[side])
            got.reverse()
            kept[token] = got
        return got

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b leaves exactly a and b."""
        key = a << 20 | b
        ok = self._ok.get(key)
        if ok is None:
            if len(self._ok) >= self.pairs_kept:
                self._ok.clear()
            ok = self._ok[key] = self._border_holds(self._edge(a, 1, self._right), self._edge(b, 0, self._left))
        return ok

    def _border_holds(self, left: list[int], right: list[int]) -> bool:
        i = j = 0
        while True:
            grow_left = left[i + 1] if i + 1 < len(left) else _NEVER
            grow_right = right[j + 1] if j + 1 < len(right) else _NEVER
            across = self._join.get(left[i] << 20 | right[j], _NEVER)
            # a merge across the border comes before one to its right of the same rank, and after one to its left
            if across < grow_left and across <= grow_right and across != _NEVER:
                return False
            if grow_left == grow_right == _NEVER:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1

    def encode(self, data: bytes) -> list[int]:
        """The entries of one piece."""
        whole = self.rank.get(data)
        if whole is not None and (len(data) == 1 or self.halves[whole]):
            return [whole]
        return PrefixTokens(self, data).tokens()


class PrefixTokens:
    """One byte string with, for each prefix, the entry that ends its encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last = [-1]
        if data:
            self.append(data)

    def _scan(self, start: int, stop: int) -> Iterator[tuple[int, int]]:
        """(prefix length, entry) for prefixes start < length <= stop, in order."""
        v = self.vocabulary
        base = max(0, start - v.longest + 1)
        last, size, follow = self.last, v.size, v.may_follow
        done = start
        for end, token in v.auto.iter(self.data[base:stop].decode("latin-1")):
            end += base + 1
            if end <= done:
                continue
            at = end - size[token]
            if at == 0 or follow(last[at], token):
                done = end
                yield end, token

    def append(self, data: bytes) -> None:
        """The loop of _scan, in line: this is where the time goes."""
        v, last = self.vocabulary, self.last
        size, known = v.size, v._ok.get
        done = len(self.data)
        self.data += data
        base = max(0, done - v.longest + 1)
        for end, token in v.auto.iter(self.data[base:].decode("latin-1")):
            end += base + 1
            if end > done:
                before = last[end - size[token]]
                ok = True if before < 0 else known(before << 20 | token)
                if ok or (ok is None and v.may_follow(before, token)):
                    last.append(token)
                    done = end

    def splice(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes start to stop; returns how many prefixes were encoded anew."""
        old = self.last[stop + 1 :]
        self.data[start:stop] = new
        del self.last[start + 1 :]
        shift, calm, fresh = start + len(new), 0, 0
        for end, token in self._scan(start, len(self.data)):
            self.last.append(token)
            fresh += 1
            k = end - shift - 1
            calm = calm + 1 if k >= 0 and old[k] == token else 0
            if calm >= self.vocabulary.longest:  # all that later prefixes look at is as it was
                self.last += old[k + 1 :]
                break
        return fresh

    def tokens(self, length: int | None = None) -> list[int]:
        """The encoding of the first length bytes (all)."""
        at, out = len(self.data) if length is None else length, []
        while at:
            out.append(self.last[at])
            at -= self.vocabulary.size[self.last[at]]
        out.reverse()
        return out


class _Kept(dict):
    """Encoded strings by text; emptied when full, so memory is bounded."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        got = self[text] = self.make(text)
        return got


class Codec:
    """Text to little-endian unsigned 32-bit ids and back, piece by piece."""

    def __init__(self, ranks: bytes, pattern: str, kept: int = 600_000):
        import regex

        self.vocabulary = Vocabulary(ranks)
        self.find = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")).findall
        #: Between words that one blank or line end parts, the usual patterns always cut; other texts are matched whole.
        self.plain = pattern == USUAL
        self.runs = re.compile(f"[{SPACE}\\x1c-\\x1f][{SPACE}\\x1c-\\x1f]|[\\x00\\t\\x0b-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]").search
        self.pieces = _Kept(self.encode_piece, kept)
        self.units = _Kept(self.encode_unit, kept)

    def encode_unit(self, unit: str) -> bytes:
        pieces = self.find(unit)
        return self.pieces[unit] if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))

    def encode_piece(self, piece: str) -> bytes:
        return array("I", self.vocabulary.encode(piece.encode())).tobytes()

    def encode(self, text: str) -> bytes:
        if self.plain and not self.runs(text):
            units = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
            return b"".join(map(self.units.__getitem__, units))
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: The pattern for which cutting at single blanks and line ends is known to be exact (fixed value, the rank files' own).
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_codecs: dict[tuple[bytes, str], Codec] = {}


def codec(ranks: bytes, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    got = _codecs.get((ranks, pattern))
    if got is None:
        _codecs.clear()
        got = _codecs[ranks, pattern] = Codec(ranks, pattern)
    return got


class IncrementalText:
    """A text whose ids stay right under appends and edits, at the cost of what lies near them.

    A piece depends on its own text and at most two characters behind it, so
    pieces that end three characters or more before an edit stay, and matching
    stops where a piece starts at the same place as before.
    """

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text, self.pieces = codec, "", []
        self.edit(0, 0, text)

    def append(self, text: str) -> int:
        return self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters start to stop; returns how many pieces were matched anew."""
        import bisect
        from itertools import accumulate

        starts = [0, *accumulate(map(len, self.pieces))]
        keep = max(0, bisect.bisect_right(starts, start - 3) - 1)
        shift = len(new) - (stop - start)
        old = {s + shift: k for k, s in enumerate(starts) if s >= stop}
        self.text = self.text[:start] + new + self.text[stop:]
        at, fresh = starts[keep], []
        while at < len(self.text) and not (at >= start + len(new) and at in old):
            ahead = 256
            while True:  # a match that ends well inside what it sees is the match on the whole text
                piece = self.codec.find(self.text[at : at + ahead])[0]
                if len(piece) + 3 <= ahead or at + ahead >= len(self.text):
                    break
                ahead *= 4
            fresh.append(piece)
            at += len(piece)
        tail = self.pieces[old[at] :] if at in old and at >= start + len(new) else []
        self.pieces = self.pieces[:keep] + fresh + tail
        return len(fresh)

    def ids(self) -> bytes:
        return b"".join(map(self.codec.pieces.__getitem__, self.pieces))


def _encode(batches, ranks, pattern: str):
    run = codec(ranks.value, pattern)
    for batch in batches:
        for part in slices(batch):
            ids = [run.encode(t) if t else b"" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(k) for k in range(part.num_columns)] + [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                names=[*part.schema.names, "ids", "n_tokens"],
            )


def _decode(batches, ranks, pattern: str):
    run = codec(ranks.value, pattern)
    for batch in batches:
        for part in slices(batch):
            got = [None if x is None else run.decode(x) for x in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(k) for k in range(part.num_columns)] + [pa.array(got, pa.binary())], names=[*part.schema.names, "decoded"])


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:  # a vocabulary file of about 1 MB
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` to the rows of docs.

    path: a rank file.  keep: columns to carry (all); a column named ids, n_tokens
    or decoded is replaced.  Each row is encoded on its own, without a shuffle: a null
    or empty text has no ids, repeated rows repeat, an empty table stays empty,
    nulls in other columns are carried.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "n_tokens", "decoded", "text")]
    rows = docs.select(*kept, "text")
    ranks = _ranks(docs, path)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "ids binary", "n_tokens bigint"])
    return rows.mapInArrow(lambda it: _encode(it, ranks, pattern), schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Add ``decoded`` (binary): the bytes of each row's ids; null ids give null."""
    rows = encoded.drop("decoded")
    ranks = _ranks(encoded, path)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "decoded binary"])
    return rows.mapInArrow(lambda it: _decode(it, ranks, pattern), schema)
