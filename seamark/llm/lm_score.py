"""Language-model scores by subword lattices (operator 1).

The vocabulary of pieces is an existing one and stays as it is.  A word is cut into
pieces in every possible way; the first piece is drawn from one distribution, whose
entries tell whether the word ends with the piece, each further one from another, and
the word's probability is the sum over all its segmentations, by a forward recursion
in log space.  The weights start as the vocabulary's scores, taken as log
probabilities over a temperature and normalised over the pieces.  Training adapts the
weights of pieces, and nothing else: expected counts from forward and backward passes
over the training documents' words, to which the vocabulary's own weights are added as a
prior.  There is no table of word probabilities.

A document belongs to one class (a language of the training documents) and is a
sequence of words and one end; each class has its own weights and its own share of
ends.  The probability of a text is the sum over the classes, so all texts'
probabilities add up to 1 or less.

Lattices are summed once for each different word of the corpus, not for each occurrence.
Words that make up more than one in 50,000 tokens, so at most 50,000 words, are looked up
in a broadcast table; the rest, none of which can be hot, are joined.  The same words serve
for some rounds of adaptation on the driver; the last round is over all words.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.llm.common import materialise, parts_for, release, slices, text_bytes

#: A word is looked up rather than joined if it makes up more than 1 / HEAVY of all tokens.
HEAVY = 50_000
#: Distinct words that a task counts before it sends them on.
HELD = 200_000
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_MARK = "▁".encode()
#: Expected counts are summed in whole parts of 1 / _SCALE, so that the order does not matter.
_SCALE = 1 << 10
#: Rounds of adaptation on the frequent words alone, before those on all words.
BURN_IN = 6


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words between ASCII separators; both bytes methods treat ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def vocabulary(path: str) -> list[tuple[bytes, float]]:
    """Pieces of a sentencepiece model as bytes, with its scores.

    Control pieces are left out; byte pieces become their byte.  Those, and pieces whose
    score only marks them as unused, get the lowest score of the others.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out, marked = [], []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            marked.append(bytes([int(model.id_to_piece(i)[3:5], 16)]))
        elif model.get_score(i) < -1e6:
            marked.append(model.id_to_piece(i).encode())
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            out.append((model.id_to_piece(i).encode(), model.get_score(i)))
    least, have = min((x for _, x in out), default=0.0), {k for k, _ in out}
    return [*out, *((k, least) for k in dict.fromkeys(marked) if k not in have)]


def _hash(data: bytes) -> int:
    h = 0
    for b in data:
        h = (h * _R + b + 1) & _MASK
    return h


class Lattice:
    """Weights of pieces in each class, and sums over the segmentations of words."""

    def __init__(self, opening: list[bytes], going: list[bytes], weights: np.ndarray):
        """weights: natural logarithms of probabilities, a column a class.

        Rows: opening pieces that are followed by more, the same as whole words (one
        distribution together); continuing pieces followed by more, the same as a
        word's last (another).
        """
        self.opening, self.going, self.weights = opening, going, weights
        self.tables = []
        for first, kind in ((0, opening), (2 * len(opening), going)):
            by: dict[int, list[tuple[int, int]]] = {}
            for at, piece in enumerate(kind, first):
                by.setdefault(len(piece), []).append((_hash(piece), at))
            self.tables.append({size: tuple(np.array(x, kind) for x, kind in zip(zip(*sorted(rows)), (np.uint64, np.int64))) for size, rows in by.items()})
        self.longest = max(max(t, default=1) for t in self.tables)
        self.powers = np.array([pow(_R, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    @classmethod
    def from_scores(cls, pieces: list[tuple[bytes, float]], classes: int, temperature: float = 4000.0) -> Lattice:
        """Weights proportional to exp(score / temperature), normalised over the pieces.

        A temperature of 1 fits scores that are log probabilities; those of merge
        vocabularies count merges, which a temperature of some thousand spreads as
        pieces are.  Each byte is a piece, with the lowest score if the vocabulary lacks it.
        """
        top, low = max((x for _, x in pieces), default=0.0), min((x for _, x in pieces), default=0.0)
        share = {piece: math.exp((x - top) / temperature) for piece, x in pieces}
        for b in range(256):
            share.setdefault(bytes([b]), math.exp((low - top) / temperature))
        n_mark = len(_MARK)
        opening = {k[n_mark:]: v for k, v in share.items() if k.startswith(_MARK) and k != _MARK and _MARK not in k[n_mark:]}
        for b in range(256):
            opening.setdefault(bytes([b]), share[bytes([b])])
        going = {k: v for k, v in share.items() if k and _MARK not in k}
        for k, v in opening.items():  # a piece that opens a word may be all that the vocabulary has for it
            going.setdefault(k, v)
        logs = [np.log(np.array(list(x.values())) / sum(x.values()) / 2) for x in (opening, going)]
        return cls(list(opening), list(going), np.repeat(np.concatenate([logs[0], logs[0], logs[1], logs[1]])[:, None], classes, axis=1))

    def updated(self, expected: np.ndarray, prior: np.ndarray, strength: float = 50.0) -> Lattice:
        """Weights from expected counts; a class's are smoothed towards those of all classes, and these towards prior."""
        parts = []
        for rows in (slice(0, 2 * len(self.opening)), slice(2 * len(self.opening), None)):
            pooled = expected[rows].sum(axis=1, keepdims=True) + strength * prior[rows]
            x = expected[rows] + strength * pooled / pooled.sum()
            parts.append(np.log(x / x.sum(axis=0)))
        return Lattice(self.opening, self.going, np.concatenate(parts))

    def _edges(self, letters: np.ndarray):
        """(start, end, words, rows of weights) of all pieces in words of one length, by end; start -1: an opening piece."""
        n, length = letters.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                prefix[k + 1] = prefix[k] * np.uint64(_R) + letters[:, k] + np.uint64(1)
            for end in range(1, length + 1):
                for size in range(1, min(end, self.longest) + 1):
                    kind = 0 if size == end else 1
                    if size not in self.tables[kind]:
                        continue
                    h = prefix[end] - prefix[end - size] * self.powers[size]
                    keys, at = self.tables[kind][size]
                    i = np.searchsorted(keys, h)
                    i[i == len(keys)] = 0
                    hit = np.flatnonzero(keys[i] == h)
                    if len(hit):
                        last = (len(self.going) if kind else len(self.opening)) if end == length else 0
                        yield (end - size if kind else -1), end, hit, at[i[hit]] + last

    def forward(self, letters: np.ndarray, edges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each word (rows of letters, one length) in each class, and the forward table.

        edges: gets the lattice's edges for the backward pass.
        """
        n, length = letters.shape
        alpha = np.full((length + 1, n, self.weights.shape[1]), -np.inf)
        for edge in self._edges(letters):
            start, end, words, at = edge
            term = self.weights[at] if start < 0 else alpha[start, words] + self.weights[at]
            alpha[end, words] = np.logaddexp(alpha[end, words], term)
            if edges is not None:
                edges.append(edge)
        return alpha[length], alpha

    def expected(self, letters: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
        """Add the expected counts of words of one length to into; weight: of each word in each class."""
        edges: list = []
        total, alpha = self.forward(letters, edges)
        length = letters.shape[1]
        beta = np.full_like(alpha, -np.inf)
        beta[length] = 0.0
        places, shares = [], []
        for start, end, words, at in reversed(sorted(edges, key=lambda e: e[1])):
            ahead = self.weights[at] + beta[end, words]
            if start >= 0:
                beta[start, words] = np.logaddexp(beta[start, words], ahead)
                ahead = ahead + alpha[start, words]
            places.append(at)
            shares.append(np.exp(ahead - total[words]) * weight[words])
        at, share = np.concatenate(places), np.concatenate(shares)
        for k in range(into.shape[1]):
            into[:, k] += np.bincount(at, weights=share[:, k], minlength=len(into))


def _by_length(words: list[bytes], most: int = 1 << 18):
    """(positions, letters) of words of one length, in blocks of bounded size."""
    sizes = np.array([len(w) for w in words])
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        size = int(sizes[order[a]])
        step = max(1, most // max(1, size * min(size, 16)))
        for k in range(a, b, step):
            at = order[k : min(b, k + step)]
            yield at, np.frombuffer(b"".join(words[i] for i in at), np.uint8).reshape(len(at), size)


def log_probabilities(lattice: Lattice, words: list[bytes]) -> np.ndarray:
    """Of each word in each class."""
    out = np.zeros((len(words), lattice.weights.shape[1]))
    for at, letters in _by_length(words):
        out[at] = lattice.forward(letters)[0]
    return out


def held_out(doc_id: Column, modulus: int = 7, kept_out: int = 2) -> Column:
    """The documents that the model does not learn from; those without an id are learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == kept_out, F.lit(False))


def classes(docs: DataFrame, most: int = 64) -> tuple[list[str | None], int]:
    """The languages of most training documents, and the number of classes.

    Each of the first most languages is a class of its own; the documents of any
    others share one further class, the last.
    """
    found = docs.where(~F.col("held_out")).groupBy("lang").count().orderBy(F.col("count").desc(), F.col("lang").asc_nulls_first()).limit(most + 1).collect()
    return [r.lang for r in found[:most]], max(1, len(found))


def _count(batches, langs: list[str | None], n_classes: int):
    """(word, occurrences, occurrences in training documents of each class); ends are counted under a blank, which no word can be."""
    number = {x: k for k, x in enumerate(langs)}
    every, train = Counter(), [Counter() for _ in range(n_classes)]
    names = ["word", "n", *(f"c{k}" for k in range(len(train)))]

    def done():
        words = list(every)
        for k in range(0, len(words), 50_000):
            part = words[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(map(every.__getitem__, part), pa.int64()), *(pa.array(map(t.get, part, repeat(0)), pa.int64()) for t in train)], names=names)
        for t in (every, *train):
            t.clear()

    for batch in batches:
        for part in slices(batch):
            for text, lang, out in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "held_out"))):
                words = words_of(text)
                words.append(b" ")
                every.update(words)
                if not out:
                    train[number.get(lang, n_classes - 1)].update(words)
                if len(every) > HELD:
                    yield from done()
    yield from done()
    release()


def _expect(batches, shared):
    """Expected counts of the pieces over known words, each as often as a class has it."""
    lattice = shared.value
    into = np.zeros_like(lattice.weights)
    for batch in batches:
        for part in slices(batch, 50_000):
            times = np.stack([part.column(f"c{k}").to_numpy() for k in range(into.shape[1])], axis=1).astype(float)
            for at, letters in _by_length(part.column("word").to_pylist()):
                lattice.expected(letters, times[at], into)
    at, k = np.nonzero(into)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(k, pa.int64()), pa.array(np.rint(into[at, k] * _SCALE).astype(np.int64))], names=["at", "k", "n"])
    release()


def _score_words(batches, shared, more: list[float]):
    """lb: log10(c + 1); lm0 to lmK: log10 of the word's probability in each class, with that of a word following (more)."""
    lattice = shared.value
    for batch in batches:
        for part in slices(batch, 50_000):
            words = part.column("word").to_pylist()
            c = sum(part.column(f"c{k}").to_numpy() for k in range(len(more)))
            lm = log_probabilities(lattice, words) / math.log(10) + np.array(more)
            yield pa.RecordBatch.from_arrays(
                [part.column("word"), pa.array(np.log10(c + 1.0)), pa.array((c > 0).astype(np.int64)), *(pa.array(lm[:, k]) for k in range(len(more)))], names=["word", "lb", "known", *(f"lm{k}" for k in range(len(more)))]
            )
    release()


def _sent(classes: int) -> str:
    return "word binary, row bigint, doc_id bigint, held_out boolean, n bigint, known bigint, lb double" + "".join(f", lm{k} double" for k in range(classes))


def _look_up(batches, shared, end: list[float]):
    """A row with the sums over heavy words for each document, and one row for each other word.

    The former have a blank and the row's number for a word, which matches none and
    deals them evenly.  end: lb, known and lm of the end.
    """
    from pyspark import TaskContext

    at, table = shared.value
    row = TaskContext.get().partitionId() << 33
    get = at.get
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * (len(end) - 1))
    names = [c.split()[0] for c in _sent(len(end) - 2).split(", ")]
    for batch in batches:
        for part in slices(batch, 256):
            heads, words, owners = [], [], []
            for doc_id, text, out in zip(*(part.column(k).to_pylist() for k in ("doc_id", "text", "held_out"))):
                row += 1
                own = words_of(text)
                found = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
                rare = found < 0
                sums = (table[found[~rare]].sum(axis=0) + end).tolist()
                heads.append((b" %d" % row, row, doc_id, out, len(own) + 1, round(sums[1]), sums[0], *sums[2:]))
                more = list(compress(own, rare))
                words += more
                owners += [row] * len(more)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*heads), kinds)], names=names)
            for k in range(0, len(words), 50_000):
                w = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(owners[k : k + 50_000], pa.int64()), *(pa.nulls(len(w), t) for t in kinds[2:])], names=names)
    release()


@dataclass(frozen=True)
class Model:
    """Adapted weights; and for each class log10 of: a further word, the end of a text, the class itself."""

    lattice: Lattice
    more: list[float]
    end: list[float]
    prior: list[float]
    #: Counts over the training documents, ends included: tokens, different tokens, ends.
    tokens: int
    types: int
    ends: int

    def log10_text(self, text: str | None) -> float:
        """log10 of a text's probability, on one machine."""
        lm = np.array(self.end) + self.prior
        for w in words_of(text):
            lm = lm + log_probabilities(self.lattice, [w])[0] / math.log(10) + self.more
        return float(np.logaddexp.reduce(lm * math.log(10)) / math.log(10))


def _log10(x: float) -> float:
    return math.log10(x) if x > 0 else -300.0


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", held_out(F.col("doc_id")).alias("held_out"))


def _is_word() -> Column:
    return F.col("word") != F.lit(b" ")


def fit(docs: DataFrame, model_path: str, rounds: int = 1, temperature: float = 4000.0, parts: int | None = None) -> tuple[Model, DataFrame, DataFrame]:
    """The model learnt from docs' training documents; all words with their counts; and the frequent words' own."""
    sc = docs.sparkSession.sparkContext
    rows = _rows(docs)
    langs, n_classes = classes(rows)
    cs = [f"c{k}" for k in range(n_classes)]
    parts = parts or parts_for(text_bytes(docs), 12e6, least=4)
    counted = rows.select("text", "lang", "held_out").mapInArrow(lambda it: _count(it, langs, n_classes), "word binary, n bigint, " + ", ".join(f"{c} bigint" for c in cs))
    vocab = materialise(counted.repartition(parts, "word").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", *cs))), "words")
    c_all = sum((F.col(c) for c in cs[1:]), F.col("c0"))
    sums = vocab.agg(F.sum("n").alias("every"), F.count_if(c_all > 0).alias("types"), *(F.struct(F.sum(c), F.sum(F.when(_is_word(), F.col(c)))).alias(f"t{k}") for k, c in enumerate(cs))).first()
    tokens, own = ([sums[f"t{k}"][i] or 0 for k in range(n_classes)] for i in (0, 1))
    ends = [t - w for t, w in zip(tokens, own)]

    lattice = Lattice.from_scores(vocabulary(model_path), n_classes, temperature)
    prior = np.exp(lattice.weights[:, :1])
    heavy = vocab.where(_is_word() & (F.col("n") * HEAVY > (sums.every or 0))).select("word", *cs)  # at most HEAVY of them
    if any(own):
        frequent = heavy.where(c_all > 0).toPandas()
        words, times = [bytes(w) for w in frequent.word], frequent[cs].to_numpy(float)
        for _ in range(BURN_IN if words else 0):
            expected = np.zeros_like(lattice.weights)
            for at, letters in _by_length(words):
                lattice.expected(letters, times[at], expected)
            lattice = lattice.updated(expected, prior)
        known = vocab.where(_is_word() & (c_all > 0)).select("word", *cs)
        for _ in range(rounds):
            shared = sc.broadcast(lattice)  # as large as the vocabulary
            got = known.mapInArrow(lambda it, s=shared: _expect(it, s), "at bigint, k bigint, n bigint").groupBy("at", "k").agg(F.sum("n").alias("n")).toPandas()  # at most four rows a piece and class
            expected = np.zeros_like(lattice.weights)
            expected[got["at"].to_numpy(int), got["k"].to_numpy(int)] = got["n"].to_numpy() / _SCALE
            lattice = lattice.updated(expected, prior)
    share = [(w / t, e / t) if t else (0.5, 0.5) for w, e, t in zip(own, ends, tokens)]
    model = Model(lattice, [_log10(w) for w, _ in share], [_log10(e) for _, e in share], [_log10(e / sum(ends) if sum(ends) else 1.0) for e in ends], sum(tokens), sums.types or 0, sum(ends))
    return model, vocab, heavy.select("word")


def score(docs: DataFrame, model_path: str, rounds: int = 1, temperature: float = 4000.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text, lang).

    Both scores are log10 probabilities: base_score of a unigram model of words with one
    added to every count, score of the lattice model.  Training documents are those that
    held_out does not name.  A null or empty text is its end alone.  Null ids
    belong to the training documents, a null language is a class like others, rows that
    repeat an id are learnt from and scored each, an empty table gives no rows;
    further columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    rows, parts = _rows(docs), parts_for(text_bytes(docs), 12e6, least=4)
    model, vocab, heavy = fit(docs, model_path, rounds, temperature, parts)
    n_classes, more = len(model.more), model.more
    cs, lms = [f"c{k}" for k in range(n_classes)], [f"lm{k}" for k in range(n_classes)]
    shared = sc.broadcast(model.lattice)
    scored = materialise(vocab.where(_is_word()).select("word", *cs).mapInArrow(lambda it: _score_words(it, shared, more), "word binary, lb double, known bigint, " + ", ".join(f"{x} double" for x in lms)), "word-scores")
    table = scored.join(F.broadcast(heavy), "word", "left_semi").collect()
    at = {bytes(r.word): k for k, r in enumerate(table)}
    looked = sc.broadcast((at, np.array([tuple(r)[1:] for r in table], float).reshape(-1, n_classes + 2)))
    end = [math.log10(model.ends + 1), int(model.ends > 0), *model.end]
    sent = rows.select("doc_id", "text", "held_out").mapInArrow(lambda it: _look_up(it, looked, end), _sent(n_classes))
    rare = scored.join(F.broadcast(heavy), "word", "left_anti").select("word", *(F.col(x).alias(f"r_{x}") for x in ("lb", "known", *lms)))
    joined = sent.repartition(parts, "word").join(rare.repartition(parts, "word").hint("shuffle_hash"), "word", "left")
    summed = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n").alias("n_tokens"),
        F.sum(F.coalesce("known", "r_known", F.lit(0))).alias("n_known"), *(F.sum(F.coalesce(x, f"r_{x}", F.lit(0.0))).alias(x) for x in ("lb", *lms)),
    )
    each = F.array(*(F.col(x) + F.lit(p) for x, p in zip(lms, model.prior)))
    top = F.array_max("_each")
    whole = top + F.log10(F.aggregate("_each", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), x - top)))
    return summed.withColumn("_each", each).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("lb") - F.col("n_tokens") * math.log10(model.tokens + model.types + 1)).alias("base_score"), whole.alias("score"),
    )
