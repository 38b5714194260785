"""Operator 7, toxicity with noisy-channel deobfuscation.

A token that looks disguised (digits or signs among letters, letters repeated three times
or more, letters set apart by blanks or signs) spans a lattice: every character offers the
letters it may stand for, and repeated letters may be dropped.  A Viterbi search over
pairs of letters finds the reading with the highest sum of channel and character language
model log-probabilities.  A row of letters set apart by blanks may hold several words: each
blank offers a word break.  Undisguised tokens have one path only and stay as they are.  The
restored text is then scored: a logistic regression over the presence of words and stems whose
share among documents labelled toxic is significantly high.

The language model counts the character trigrams (code points) of all documents, without
labels.  The classifier learns from a bounded sample of labelled rows whose id is not held
out (`TRAIN_DOCS` ids, lowest hash first, with one text of at most `TRAIN_DOC_BYTES` bytes
each); every text is scored whole.  Scores
use the text only.

Edge cases: null or empty text gets the classifier's bias (a low score); contradicting
labels of an id count as toxic; without labels of both kinds every score is 0; repeated
rows score alike; very long texts are cut into chunks by document only; an empty table
gives an empty result; only id and text are read, so other columns never clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

THRESHOLD = 0.7
#: Most documents, and most bytes of each, that the classifier learns from.
TRAIN_DOCS, TRAIN_DOC_BYTES = 20_000, 20_000
#: Most words that the classifier knows, and what a word needs to be one: fewest toxic
#: documents, and log-likelihood by which its share among them exceeds that of all (a
#: chance of about e**-12 for any one word).
FEATURES = 2000
MIN_TOXIC_DOCS, LEAST_LIFT = 4, 12
#: Bytes of the word beginnings that are scored beside whole words.
STEMS = (4, 5, 6, 7)
#: Letters that a sign may stand for.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t"}
LEET_COST, KEEP_COST, DROP_COST = -0.5, -4.0, -0.7
#: Disguised tokens whose readings a worker keeps.
CACHE = 100_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in STANDS_FOR]] = True
_CORE = _LETTER | _SIGN
_JOINER = np.zeros(256, bool)
_JOINER[[ord(c) for c in ".-_*'~,/"]] = True


class CharModel:
    """Trigram model of characters, with counts of (a, b, c) at word starts too."""

    def __init__(self, counts: dict[str, int]):
        self.tri, self.bi = {}, {}
        for g, n in counts.items():
            self.tri[g] = self.tri.get(g, 0) + n
            self.bi[g[:2]] = self.bi.get(g[:2], 0) + n
        self.known: dict[str, float] = {}

    def log(self, a: str, b: str, c: str) -> float:
        g = a + b + c
        if g not in self.known:
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[g] = math.log((self.tri.get(g, 0) + 0.02) / (self.bi.get(a + b, 0) + 1.0))
        return self.known[g]


def decode(token: str, model: CharModel) -> str:
    """The best reading of a lower-case token: Viterbi over (last two letters).  A reading is
    a chain of (reading before, letter), so the time grows with the length of the token.
    A blank between letters may be a word break, which ends one word and begins the next."""
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {(" ", " "): (0.0, None)}
    previous = ""
    for c in token:
        if c == " ":
            for (a, b), (score, chain) in list(states.items()):
                s = score + model.log(a, b, " ")
                if chain and s > states.get((" ", " "), (-math.inf, None))[0]:
                    states[" ", " "] = s, (chain, " ")
        if c in ".-_*'~,/ ":
            continue
        offers = [(x, LEET_COST) for x in STANDS_FOR.get(c, "")]
        offers.append((c, KEEP_COST if c in STANDS_FOR else 0.0))
        after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (score, chain) in states.items():
            for x, cost in offers:
                s = score + cost + model.log(a, b, x)
                if s > after.get((b, x), (-math.inf, None))[0]:
                    after[b, x] = s, (chain, x)
            if c == previous and chain and b != " " and any(x == b for x, _ in offers):  # a repetition may be dropped
                s = score + DROP_COST
                if s > after.get((a, b), (-math.inf, None))[0]:
                    after[a, b] = s, chain
        previous, states = c, after
    _, chain = max(((score + model.log(a, b, " "), chain) for (a, b), (score, chain) in states.items()), key=lambda x: x[0])
    letters = []
    while chain:
        chain, x = chain
        letters.append(x)
    return "".join(reversed(letters))


def code_points(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 documents, and how many start before each byte."""
    start = (low & 0xC0) != 0x80
    start[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    at = np.flatnonzero(start)
    before = np.concatenate(([0], np.cumsum(start)))
    points = low[at].astype(np.int32)
    wide = np.flatnonzero(points >= 0xC0)
    size = 2 + (points[wide] >= 0xE0) + (points[wide] >= 0xF0)
    value = points[wide] & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        value[more] = value[more] << 6 | low[np.minimum(at[wide[more]] + k, len(low) - 1)] & 0x3F
    points[wide] = np.minimum(value, 0x10FFFF)
    return points, before


def _classes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and which are signs."""
    short = np.minimum(points, 0x7F)
    letter, sign = _LETTER[short], _SIGN[short]
    wide = np.flatnonzero(points > 0x7F)
    values, place = np.unique(points[wide], return_inverse=True)
    letter[wide] = np.array([chr(c).isalpha() for c in values.tolist()], bool)[place]
    return letter, sign


def disguised(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Documents and texts of the tokens, or rows of single letters, that look disguised.  A
    token begins at its first letter or sign and ends at its last one; the signs ! | + at its
    end are punctuation, all others count wherever they stand."""
    s, e, bounds = C.words(low, offsets, C.SPACE_WORDS)
    if not len(s):
        return np.zeros(0, np.int64), []
    points, before = code_points(low, offsets)
    letter, sign = _classes(points)
    s, e = before[s], before[e]
    core = letter | sign
    place = np.arange(len(points))
    first = np.minimum.accumulate(np.where(core, place, len(points))[::-1])[::-1]
    last = np.maximum.accumulate(np.where(core & ~np.isin(points, [ord(c) for c in "!|+"]), place, -1))
    s, e = np.minimum(first[s], e), last[e - 1] + 1
    e = np.maximum(s, e)
    joiner = _JOINER[np.minimum(points, 0x7F)]
    sums = lambda m: (lambda c: c[e] - c[s])(np.concatenate(([0], np.cumsum(m))))
    n_letter = sums(letter)
    # a token's first place looks back at another token, so repetitions and pairs start behind it
    open_ = np.ones(len(points) + 1, bool)
    open_[s] = False
    same = np.zeros(len(points), bool)
    same[1:] = (points[1:] == points[:-1]) & open_[1:-1]
    triple = np.zeros(len(points), bool)
    triple[2:] = same[2:] & same[1:-1] & letter[2:]
    pair = np.zeros(len(points), bool)  # two letters side by side
    pair[1:] = letter[1:] & letter[:-1] & open_[1:-1]
    flagged = (n_letter >= 2) & (sums(sign) > 0)
    flagged |= (n_letter > 0) & (sums(triple) > 0)
    flagged |= (n_letter >= 3) & (sums(pair) == 0) & (sums(joiner) >= 2)
    doc = np.searchsorted(bounds, np.arange(len(s)), "right") - 1
    text = lambda a, b: "".join(map(chr, points[a:b].tolist())).encode("utf-8", "replace").decode()
    docs, texts = doc[flagged].tolist(), [text(a, b) for a, b in zip(s[flagged].tolist(), e[flagged].tolist(), strict=True)]
    single = np.concatenate(([False], (e - s) == 1, [False]))
    edge = np.flatnonzero(single[1:] != single[:-1])
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        while b - a >= 3:
            stop = min(b, int(bounds[doc[a] + 1]))
            if stop - a >= 3:
                docs.append(int(doc[a]))
                texts.append(" ".join(text(k, k + 1) for k in s[a:stop].tolist()))
            a = stop
    return np.array(docs, np.int64), texts


class Restorer:
    """Restored words of the disguised tokens of a chunk of documents."""

    def __init__(self, counts: dict[str, int]):
        self.model = CharModel(counts)
        self.known: dict[str, str] = {}

    def reading(self, token: str) -> str:
        if token not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[token] = decode(token, self.model)
        return self.known[token]

    def words(self, low: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Documents and hashes of each restored token and its stems."""
        docs, texts = disguised(low, offsets)
        here = {t: self.reading(t) for t in set(texts)}  # the cache may be cleared on the way
        words = {t: here[t].split(" ") for t in here}
        docs = np.repeat(docs, [len(words[t]) for t in texts])
        data, cuts = C.buffers(pa.array([w for t in texts for w in words[t]], pa.large_string()))
        prefix, s, e = C.prefix_hash(C.BYTE_VALUE[data]), cuts[:-1], cuts[1:]
        owners, hashes = [docs], [C.span_hash(prefix, s, e)]
        for k in STEMS:
            long = np.flatnonzero(e - s > k)
            owners.append(docs[long])
            hashes.append(~C.span_hash(prefix, s[long], s[long] + k))
        return owners, hashes


def _chunks(column, restorer: Restorer):
    """(first document, documents, owner and hash of every distinct word of each document)."""
    data, offsets = C.buffers(column)
    for a, b in C.doc_chunks(offsets):
        low, cuts = C.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        s, e, bounds = C.words(low, cuts, C.ALNUM_WORDS)
        prefix = C.prefix_hash(C.BYTE_VALUE[low])
        owner = np.repeat(np.arange(b - a), np.diff(bounds))
        owners, hashes = [owner], [C.span_hash(prefix, s, e)]
        for k in STEMS:
            long = np.flatnonzero(e - s > k)
            owners.append(owner[long])
            hashes.append(~C.span_hash(prefix, s[long], s[long] + k))
        d, r = restorer.words(low, cuts)
        yield a, b, np.concatenate((*owners, *d)), np.concatenate((*hashes, *r))


def _distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    return o[new], x[new]


class Classifier:
    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(words)
        self.words, self.weights, self.bias = words[order], weights[order], bias
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.words >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `h` of known words, and their numbers."""
        at = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
        i = np.searchsorted(self.words, h[at])
        ok = self.words[np.minimum(i, len(self.words) - 1)] == h[at] if len(self.words) else np.zeros(len(at), bool)
        return at[ok], i[ok]


def sample_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, most: int) -> DataFrame:
    """(text, label) of at most `most` labelled ids that are not held out: one text for each id,
    of at most `TRAIN_DOC_BYTES` bytes."""
    marks = labels.where((C.crc_third("doc_id") != 1) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    picked = marks.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(most)
    # `most` ids of 12 bytes: a proven bound
    texts = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t")).where(F.octet_length("t") <= TRAIN_DOC_BYTES)
    return texts.join(F.broadcast(picked), F.col("i") == F.col("doc_id")).groupBy("i").agg(F.min("t").alias("t"), F.first("y").alias("y")).select("t", "y")


_ASCII = 27  # a blank and a-z


def _trigrams(batches):
    """Rows (g, n): three code points of 21 bits each, and how often they follow another in
    words, which have two blanks before them and one after."""
    plain = np.zeros(_ASCII**3, np.int64)
    for batch in batches:
        data, offsets = C.buffers(batch.column(0))
        for a, b in C.doc_chunks(offsets):
            low, cuts = C.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            if not len(low):
                continue
            points, before = code_points(low, cuts)
            letter, _ = _classes(points)
            edge = np.zeros(len(points) + 1, bool)
            edge[before[cuts]] = True  # words end with their document
            after = np.concatenate(([False], letter[:-1])) & ~edge[:-1]
            s = np.flatnonzero(letter & ~after)
            if not len(s):
                continue
            word = np.cumsum(letter & ~after)[letter]  # number of each letter's word, from 1
            flat = np.full(len(word) + 3 * len(s), 0x20, np.int64)
            flat[np.arange(len(word)) + 3 * word - 1] = points[letter]
            x, y, z = flat[:-2], flat[1:-1], flat[2:]
            ok = ~((y == 0x20) & (x != 0x20)) & ~((x == 0x20) & (y == 0x20) & (z == 0x20))
            x, y, z = x[ok], y[ok], z[ok]
            short = np.where(flat == 0x20, 0, np.where(flat < 0x7F, flat - 0x60, _ASCII))
            i, j, k = short[:-2][ok], short[1:-1][ok], short[2:][ok]
            own = (i < _ASCII) & (j < _ASCII) & (k < _ASCII)
            plain += np.bincount((i[own] * _ASCII + j[own]) * _ASCII + k[own], minlength=len(plain))
            values, n = np.unique((x[~own] << 42) | (y[~own] << 21) | z[~own], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n)], names=["g", "n"])
    at = np.flatnonzero(plain)
    point = lambda v: np.where(v == 0, 0x20, v + 0x60)
    values = (point(at // _ASCII**2) << 42) | (point(at // _ASCII % _ASCII) << 21) | point(at % _ASCII)
    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(plain[at])], names=["g", "n"])


def char_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Counts of all character trigrams of all documents."""
    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(_trigrams, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    grams = rows.toArrow()
    g, n = grams.column("g").to_pylist(), grams.column("n").to_pylist()
    return {chr(v >> 42) + chr(v >> 21 & 0x1FFFFF) + chr(v & 0x1FFFFF): k for v, k in zip(g, n, strict=True)}


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", most: int = TRAIN_DOCS) -> tuple[dict[str, int], Classifier | None]:
    sample = C.shared_table(sample_rows(docs, labels, id, text, most))
    sizes = {int(r.y): r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    if not n_bad or not n_good:
        return {}, None
    counts = char_counts(docs, text)

    def word_rows(batches):
        restorer = Restorer(counts)
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), np.int64)
            for a, b, owner, h in _chunks(batch.column(0), restorer):
                o, x = _distinct(owner, h)
                values, inverse = np.unique(x, return_inverse=True)
                bad = np.bincount(inverse, y[a:b][o], len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(bad), pa.array(np.bincount(inverse, minlength=len(values)) - bad)], names=["w", "bad", "good"])

    base = n_bad / (n_bad + n_good)
    seen = sample.mapInArrow(word_rows, "w long, bad long, good long").groupBy("w").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    lift = F.col("bad") * F.log((F.col("bad") + 0.0) / ((F.col("bad") + F.col("good")) * base))
    kept = seen.where((F.col("bad") >= MIN_TOXIC_DOCS) & (F.col("bad") > F.col("good"))).withColumn("g", lift).where(F.col("g") > LEAST_LIFT).orderBy(F.desc("g"), "w").limit(FEATURES).select("w").collect()
    words = np.sort(np.array([r.w for r in kept], np.int64).view(np.uint64))
    probe = Classifier(words, np.zeros(len(words)), 0.0)

    def presence(batches):
        restorer = Restorer(counts)
        for batch in batches:
            y = batch.column(1).to_pylist()
            for a, b, owner, h in _chunks(batch.column(0), restorer):
                at, i = probe.find(h)
                own = [[] for _ in range(b - a)]
                for o, k in sorted(set(zip(owner[at].tolist(), i.tolist(), strict=True))):
                    own[o].append(k)
                yield pa.RecordBatch.from_arrays([pa.array(y[a:b], pa.int32()), pa.array(own, pa.list_(pa.int32()))], names=["y", "x"])

    rows = sample.mapInArrow(presence, "y int, x array<int>").groupBy("y", "x").agg(F.count("*").alias("n")).orderBy("y", "x").collect()
    return counts, _fit(words, rows)


def _fit(words: np.ndarray, rows: list, penalty: float = 0.05, rounds: int = 800) -> Classifier:
    """Logistic regression with a ridge penalty and weights that are not negative."""
    k = len(words)
    at = np.concatenate([np.full(len(r.x), j) for j, r in enumerate(rows)] or [np.zeros(0)]).astype(np.int64)
    col = np.concatenate([np.array(r.x, np.int64) for r in rows] or [np.zeros(0, np.int64)]).astype(np.int64)
    y, n = np.array([r.y for r in rows], float), np.array([r.n for r in rows], float)
    w, bias = np.ones(k), -2.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(at, w[col], len(rows))
        d = n * (1 / (1 + np.exp(-z)) - y)
        g = np.append(np.bincount(col, d[at], k) + penalty * w, d.sum()) / n.sum()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, bias = np.maximum(w - move[:k], 0), bias - move[k]
    return Classifier(words, w, float(bias))


def scored(docs: DataFrame, counts: dict[str, int], model: Classifier | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, __score)."""

    def run(batches):
        restorer = Restorer(counts)
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for a, b, owner, h in _chunks(batch.column(1), restorer) if model else ():
                at, i = model.find(h)
                o, k = _distinct(owner[at], i) if len(at) else (owner[at], i)
                z = model.bias + np.bincount(o, model.weights[k], b - a)
                score[a:b] = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["id", "__score"])

    kind = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("__score", T.DoubleType())])
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, kind).withColumnRenamed("id", id)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    counts, model = train(docs, C.table(spark, sf_dir, "labels"))
    rows = scored(docs, counts, model)
    return rows.select("doc_id", (C.crc_third("doc_id") == 1).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
