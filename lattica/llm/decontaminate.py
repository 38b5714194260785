"""Operator 2, benchmark decontamination: suffix arrays of the training shards, searched
by every test suffix.

The benchmark's windows (10 words, or a whole shorter item) are the query set.  Each chunk
of documents is one shard: its words are hashed, the suffixes that can match at all (those
whose first words start some test suffix) are sorted into a suffix array over word hashes,
and every test suffix that can occur is looked up in it by binary search.  Word hashes have
64 bits, a window 640.  A hit names the class of equal windows, never the items one by one:
items are looked up once for each set of classes, so thousands of equal items cost nothing.

The longest verbatim match of a document is found by following the places of its hits in
the benchmark from word to word; its place in the document, and an item and place where it
stands, are returned beside its length.

A benchmark whose hashed words take up to `BLOCK_BYTES` is broadcast and searched in one pass over the
documents.  A larger one is never gathered: its windows are a table, a bitmap of their
hashes (of at most 2**`MOST_BITS` bits) filters the suffixes of every shard, and the sorted
suffixes that are left meet the sorted windows in one join.  Both ways give equal results.

Edge cases: a null or empty text has no words and is never hit; items without words have
no windows; null item ids count as ''; repeated items count once by id; ties (one passage
in several items) count for each item, and the least item id is named for the longest match;
repeated rows get equal results; empty tables give empty results or no hits.  All columns
of the documents are kept; results are named after `prefix`, which must not begin the name
of an input column.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW = 10
#: Bytes of hashed words (8 a word) of a benchmark that is sent to each task.
BLOCK_BYTES = 8_000_000
#: Leading words by which suffixes are prefiltered, and bits of that filter.
LEAD, LEAD_BITS = 3, 20
#: Most bits of the filter of a large benchmark (2**28 are 32 MB).
MOST_BITS = 28
#: Sets of classes whose items a worker keeps, and windows of an item in one Arrow batch.
CACHE, PIECE = 1000, 100_000
#: A word: not one of [\x00-\x2F\x3A-\x60\x7B-\x7F], once letters are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RESULTS = (("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("sha", pa.string()), ("longest", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64()))
_SPARK = {pa.int64(): T.LongType(), pa.string(): T.StringType()}


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = C.LOWER[data]
    s, e, bounds = C.words(low, offsets, C.ALNUM_WORDS)
    return C.span_hash(C.prefix_hash(C.BYTE_VALUE[low]), s, e), bounds


def _lead(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on (words beyond the end count as 0)."""
    out = h * np.uint64(3)
    for j in range(1, k):
        out = C.mix(out)
        out[: len(h) - j] += h[j:]
    return C.mix(out)


def _rows(h: np.ndarray, at: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """Suffixes from `at`, cut to `width` words, as byte strings in the order of their words."""
    idx = at[:, None] + np.arange(width)
    m = np.where(idx < ends[:, None], h[np.minimum(idx, len(h) - 1)], np.uint64(0)).astype(">u8")
    return np.ascontiguousarray(m).view(f"S{8 * width}").ravel()


def _sizes(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window of the sequences begins, and its words."""
    n = np.diff(bounds)
    m = np.minimum(n, window)
    count = np.where(n > 0, n - m + 1, 0)
    at = np.repeat(bounds[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return at, np.repeat(m, count)


class TestSuffixes:
    """The sorted windows of word sequences and the places they come from.  `items`: id and
    hashed words of each item; equal sequences are held once, with all their ids."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        owners: dict[bytes, set[str]] = {}
        for i, words in items:
            owners.setdefault(words, set()).add(i)
        texts = sorted(owners, key=lambda w: (min(owners[w]), w))  # the least id comes first
        self.ids = [sorted(owners[w]) for w in texts]
        h = np.frombuffer(b"".join(texts), np.uint64)
        self.bounds = np.concatenate(([0], np.cumsum([len(w) // 8 for w in texts]))).astype(np.int64)
        at, m = _sizes(self.bounds, window)
        self.leads = {}
        self.classes: list[tuple[int, np.ndarray, np.ndarray]] = []  # words, sorted distinct windows, their leads
        places, sizes, n = [], [], 0
        for size in np.unique(m).tolist():
            own = at[m == size]
            keys, inverse = np.unique(_rows(h, own, own + size, window), return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            lead = np.empty(len(keys), np.uint64)
            lead[inverse] = _lead(h, min(size, LEAD))[own]
            self.classes.append((size, keys, lead, n))
            n += len(keys)
            places.append(own[order])
            sizes.append(np.bincount(inverse, minlength=len(keys)))
        self.places = np.concatenate([np.zeros(0, np.int64), *places])
        self.cuts = np.concatenate(([0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes])))).astype(np.int64)
        self.filters: dict[int, np.ndarray] = {}
        for size, _, lead, _ in self.classes:
            bits = self.filters.setdefault(min(size, LEAD), np.zeros(1 << LEAD_BITS, bool))
            bits[(lead >> np.uint64(64 - LEAD_BITS)).astype(np.int64)] = True
        self.known: dict[bytes, tuple[int, str]] = {}

    def matches(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word position, words, class) of every window that occurs, by position."""
        none = tuple(np.zeros(0, np.int64) for _ in range(3))
        if not len(h) or not self.classes:
            return none
        maybe, seen = np.zeros(len(h), bool), {}
        for k, bits in self.filters.items():
            short = (_lead(h, k) >> np.uint64(64 - LEAD_BITS)).astype(np.int64)
            maybe |= bits[short]
            seen[k] = np.zeros(1 << LEAD_BITS, bool)
            seen[k][short] = True
        at = np.flatnonzero(maybe)
        if not len(at):
            return none
        ends = bounds[np.searchsorted(bounds, at, "right")]
        keys = _rows(h, at, ends, self.window)
        order = np.argsort(keys, kind="stable")
        suffixes, at, left = keys[order], at[order], (ends - at)[order]  # the shard's suffix array
        found = []
        width = 8 * self.window
        for m, tests, lead, first in self.classes:
            asked = np.flatnonzero(seen[min(m, LEAD)][(lead >> np.uint64(64 - LEAD_BITS)).astype(np.int64)])
            low = top = tests[asked]
            if m < self.window and len(asked):
                raw = np.frombuffer(low.astype(f"S{width}").tobytes(), np.uint8).reshape(-1, width).copy()
                raw[:, 8 * m :] = 255
                top = raw.view(f"S{width}").ravel()
            lo, hi = np.searchsorted(suffixes, low, "left"), np.searchsorted(suffixes, top, "right")
            n = hi - lo
            where = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            number = np.repeat(asked + first, n)
            whole = left[where] >= m  # a window ends with its document at the latest
            found.append((at[where[whole]], np.full(whole.sum(), m), number[whole]))
        pos, m, number = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((m, pos))
        return pos[order], m[order], number[order]

    def items(self, classes: np.ndarray) -> tuple[int, str]:
        """How many items hold any of these classes, and the digest of their ids."""
        key = np.unique(classes).tobytes()
        if key not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            own = np.frombuffer(key, np.int64)
            at = np.concatenate([self.places[self.cuts[k] : self.cuts[k + 1]] for k in own.tolist()])
            sequences = np.unique(np.searchsorted(self.bounds, at, "right") - 1)
            ids = sorted({i for s in sequences.tolist() for i in self.ids[s]})
            self.known[key] = len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()
        return self.known[key]

    def longest(self, pos: np.ndarray, m: np.ndarray, classes: np.ndarray) -> tuple[int, int, str, int]:
        """Words of the longest match of one document, its first position, and the first item and
        place where it stands.  Only windows of full size can go on."""
        best = (0, 0, 0)
        active: dict[int, int] = {}
        before = -2
        for p, w, k in zip(pos.tolist(), m.tolist(), classes.tolist(), strict=True):
            places = self.places[self.cuts[k] : self.cuts[k + 1]]
            if w == self.window:
                if p != before + 1:
                    active = {}
                before = p
                active = {g: active.get(g - 1, p) for g in places.tolist()}
                start = min(active.values())
                here = (p - start + w, -start, -min(g - (p - start) for g, s in active.items() if s == start))
            else:
                here = (w, -p, -int(places.min()))
            best = max(best, here)
        g = -best[2]
        s = int(np.searchsorted(self.bounds, g, "right")) - 1
        return best[0], -best[1], self.ids[s][0], g - int(self.bounds[s])


def _query_set(block) -> TestSuffixes:
    """Built once by each worker, which keeps it beside the broadcast, and not by each task."""
    if "suffixes" not in vars(block):
        block.suffixes = TestSuffixes(block.value)
    return block.suffixes


def _binary(keys: np.ndarray) -> pa.Array:
    raw, size = keys.tobytes(), keys.dtype.itemsize
    return pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())


def _search(block, text: int, names: list[str]):
    def run(batches):
        tests = _query_set(block)
        for batch in batches:
            data, offsets = C.buffers(batch.column(text))
            n = batch.num_rows
            n_words, n_hit, n_items, longest, at, item_at = (np.zeros(n, np.int64) for _ in range(6))
            sha, item = [hashlib.sha256(b"").hexdigest()] * n, [None] * n
            for a, b in C.doc_chunks(offsets):
                h, bounds = _hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n_words[a:b] = np.diff(bounds)
                pos, m, number = tests.matches(h, bounds)
                if not len(pos):
                    continue
                delta = np.zeros(len(h) + 1, np.int64)
                np.add.at(delta, pos, 1)
                np.add.at(delta, pos + m, -1)
                hits = np.concatenate(([0], np.cumsum(np.cumsum(delta[:-1]) > 0)))
                n_hit[a:b] = np.diff(hits[bounds])
                cuts = np.searchsorted(pos, bounds)
                for d in np.flatnonzero(np.diff(cuts)).tolist():
                    own = slice(cuts[d], cuts[d + 1])
                    n_items[a + d], sha[a + d] = tests.items(number[own])
                    longest[a + d], first, item[a + d], item_at[a + d] = tests.longest(pos[own], m[own], number[own])
                    at[a + d] = first - bounds[d]
            empty = longest == 0
            new = [pa.array(n_words), pa.array(n_hit), pa.array(n_items), pa.array(sha, pa.string()), pa.array(longest), pa.array(at, mask=empty), pa.array(item, pa.string()), pa.array(item_at, mask=empty)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=names)

    return run


def hashed_items(items: DataFrame, id: str, text: str) -> DataFrame:
    """Rows (item, words): the hashed words of every item that has any."""

    def run(batches):
        for batch in batches:
            data, offsets = C.buffers(batch.column(1))
            for a, b in C.doc_chunks(offsets):
                h, bounds = _hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                words = [h[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words, pa.binary())], names=["item", "words"])

    rows = items.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "item string, words binary").where("octet_length(words) > 0").distinct()


def _item_windows(batches):
    """Rows (sequence, place, m, key, hash): every window of every sequence."""
    for batch in batches:
        for s, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h = np.frombuffer(words, np.uint64)
            places, m = _sizes(np.array([0, len(h)]), WINDOW)
            lead = _lead(h, int(m[0])).view(np.int64)
            for k in range(0, len(places), PIECE):
                at, n = places[k : k + PIECE], m[k : k + PIECE]
                columns = [pa.array(np.full(len(at), s, np.int64)), pa.array(at), pa.array(n.astype(np.int32)), _binary(_rows(h, at, at + n, WINDOW)), pa.array(lead[at])]
                yield pa.RecordBatch.from_arrays(columns, names=["sequence", "place", "m", "key", "hash"])


def _suffixes(bitmap, bits: int, sizes: list[int], text: int):
    """Rows (id, th, pos, m, key): the suffix array of each shard of documents, as far as the
    bitmap lets its suffixes through."""

    def run(batches):
        known = bitmap.value
        for batch in batches:
            data, offsets = C.buffers(batch.column(text))
            for a, b in C.doc_chunks(offsets):
                h, bounds = _hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(h):
                    continue
                doc = np.repeat(np.arange(b - a), np.diff(bounds))
                ends = bounds[1:][doc]
                for m in sizes:
                    bit = (_lead(h, m) >> np.uint64(64 - bits)).astype(np.int64)
                    at = np.flatnonzero((known[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool) & (np.arange(len(h)) + m <= ends))
                    if not len(at):
                        continue
                    keys = _rows(h, at, at + m, WINDOW)
                    order = np.argsort(keys, kind="stable")
                    at = at[order]
                    own = pa.array(a + doc[at])
                    columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(at - bounds[doc[at]]), pa.array(np.full(len(at), m, np.int32)), _binary(keys[order])]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "th", "pos", "m", "key"])

    return run


def _joined(docs: DataFrame, words: DataFrame, id: str, text: str, prefix: str) -> DataFrame:
    """Results for a benchmark of any size; nothing of it but a bitmap goes to the driver."""
    spark = docs.sparkSession
    named = C.shared_table(words.withColumn("sequence", F.xxhash64("words", F.lit(1))))
    sequences = named.groupBy("sequence").agg(F.first("words").alias("words"))
    windows = C.shared_table(sequences.select("sequence", "words").mapInArrow(_item_windows, "sequence long, place long, m int, key binary, hash long"))
    bits = min(MOST_BITS, max(LEAD_BITS, (16 * windows.count()).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    rows = windows.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - bits}) & 63 AS INT))")).alias("b")).toArrow()
    bitmap = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    bitmap[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    sizes = sorted(r.m for r in windows.select("m").distinct().collect())  # WINDOW values at most
    keyed = docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = T.StructType([keyed.schema["id"], keyed.schema["th"], *T._parse_datatype_string("pos long, m int, key binary").fields])
    found = keyed.mapInArrow(_suffixes(spark.sparkContext.broadcast(bitmap), bits, sizes, 2), kind)
    classes = windows.groupBy("key", "m").agg(F.count("*").alias("held"), *(F.sum(F.xxhash64("sequence", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)))
    # repeated rows give equal hits; a class is one row, so a frequent window multiplies nothing
    hits = C.shared_table(found.join(classes, ["key", "m"]).select("id", "th", "pos", "m", "key", "held", "s1", "s2").distinct())
    # words inside any hit: an ending before which none is open adds nothing twice
    order = W.partitionBy("id", "th").orderBy("pos", "m")
    reach = F.coalesce(F.max(F.col("pos") + F.col("m")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = hits.withColumn("new", F.greatest(F.lit(0), F.col("pos") + F.col("m") - F.greatest("pos", reach)))
    covered = covered.groupBy("id", "th").agg(F.sum("new").alias("n_hit"))
    # items of a document: classes with one set of sequences are looked up once
    sets = classes.groupBy("held", "s1", "s2").agg(F.min(F.struct("key", "m")).alias("c"))
    members = sets.select("held", "s1", "s2", F.col("c.key").alias("key"), F.col("c.m").alias("m")).join(windows, ["key", "m"]).select("held", "s1", "s2", "sequence").distinct()
    items = hits.select("id", "th", "held", "s1", "s2").distinct().join(members, ["held", "s1", "s2"]).select("id", "th", "sequence").distinct()
    items = items.join(named.select("sequence", "item"), "sequence").groupBy("id", "th").agg(F.sort_array(F.collect_set("item")).alias("items"))
    items = items.select("id", "th", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("sha"))
    # the longest match: windows on one diagonal of document and sequence that follow each other
    paired = hits.join(windows.select("key", "m", "sequence", "place"), ["key", "m"]).select("id", "th", "sequence", "pos", "place", "m", (F.col("pos") - F.col("place")).alias("line"))
    own = W.partitionBy("id", "th", "sequence", "line").orderBy("pos")
    runs = paired.withColumn("run", F.col("pos") - F.row_number().over(own)).groupBy("id", "th", "sequence", "line", "run").agg((F.max(F.col("pos") + F.col("m")) - F.min("pos")).alias("longest"), F.min("pos").alias("at"), F.min("place").alias("item_at"))
    firsts = named.groupBy("sequence").agg(F.min("item").alias("item"))
    rank = F.struct(F.col("longest"), -F.col("at"))
    best = runs.groupBy("id", "th").agg(F.max(rank).alias("top"))
    best = runs.join(best.select(F.col("id").alias("i"), F.col("th").alias("t"), "top"), F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).where(rank == F.col("top")).join(firsts, "sequence")
    best = best.groupBy("id", "th").agg(F.min(F.struct("item", "item_at")).alias("x"), F.first("longest").alias("longest"), F.first("at").alias("at")).select("id", "th", "longest", "at", "x.item", "x.item_at")

    def onto(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnsRenamed({"id": "__i", "th": "__t"})
        return left.join(right, F.col("id").eqNullSafe(F.col("__i")) & (F.col("th") == F.col("__t"))).drop("__i", "__t")

    results = onto(onto(covered, items), best).select(*(F.col(c).alias(f"{prefix}{c}") for c in ("id", "th", "n_hit", "n_items", "sha", "longest", "at", "item", "item_at")))
    counted = docs.withColumn(f"{prefix}n_words", F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long"))
    joined = counted.join(results, F.col(f"`{id}`").eqNullSafe(F.col(f"{prefix}id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col(f"{prefix}th")), "left")
    nothing = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "sha": F.lit(hashlib.sha256(b"").hexdigest()), "longest": F.lit(0).cast("long")}
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.coalesce(F.col(prefix + c), nothing[c]).alias(prefix + c) if c in nothing else F.col(prefix + c) for c, _ in RESULTS))


def matched(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, prefix: str = "__") -> DataFrame:
    """`docs` with, after `prefix`: n_words, n_hit, n_items, sha (of the item ids), and of the
    longest verbatim match its words (longest), first word (at), item and place in the item."""
    words = C.shared_table(hashed_items(benchmark, item_id, item_text))
    size = words.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0
    if size > block_bytes:
        return _joined(docs, words, id, text, prefix)
    # `size` bytes, which the line above has checked
    block = docs.sparkSession.sparkContext.broadcast([(r.item, bytes(r.words)) for r in words.collect()])
    names = [*docs.columns, *(prefix + c for c, _ in RESULTS)]
    out = T.StructType([*docs.schema.fields, *(T.StructField(prefix + c, _SPARK[k]) for c, k in RESULTS)])
    return docs.mapInArrow(_search(block, docs.columns.index(text), names), out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """The documents without any window of the benchmark; all columns as they were."""
    prefix = C.fresh(docs.columns)
    return matched(docs, benchmark, id, text, prefix=prefix, **names).where(F.col(f"{prefix}n_hit") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matched(docs, C.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    rows = found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.col("__n_items").alias("n_items"), F.col("__sha").alias("items_sha256"), (F.col("__n_hit") > 0).alias("contaminated"))
    return rows


SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, w, least(len(w), 10) AS m, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS p FROM b WHERE len(w) > 0),
t AS (SELECT DISTINCT item, m, array_to_string(w[p + 1 : p + m], ' ') AS g FROM i),
s AS (SELECT DISTINCT m FROM t),
d AS (SELECT r, m, unnest(range(0, len(w) - m + 1)) AS p FROM w, s WHERE len(w) >= m),
g AS (SELECT d.r, d.m, d.p, array_to_string(w.w[d.p + 1 : d.p + d.m], ' ') AS g FROM d JOIN w ON d.r = w.r),
x AS (SELECT r, g.m, p, item FROM g JOIN t ON g.m = t.m AND g.g = t.g),
h AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT r, m, p FROM x)) GROUP BY r),
k AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM x) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(k.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.r = h.r LEFT JOIN k ON w.r = k.r
"""
