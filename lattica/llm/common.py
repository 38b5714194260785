"""Shared helpers of the corpus operators: Arrow text buffers, word spans, hashes and
connected components.

Everything here works on whole texts.  Text columns arrive as Arrow buffers, so the byte
level operators never build a Python string per row, and a batch is cut into chunks of
documents (`doc_chunks`) so that the scratch arrays stay a few dozen MB whatever the
length of the batch.  A single document longer than a chunk forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut

#: Bytes of text that one chunk of documents holds (a longer document is its own chunk).
CHUNK_BYTES = 2_000_000

#: White space of `[\x20\x09-\x0D]`: everything else belongs to a word.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Complement of `[\x00-\x2F\x3A-\x60\x7B-\x7F]`: digits, a-z and all bytes of non-ASCII characters.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: ASCII upper case to lower case, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for positions 0..n."""
    if len(_powers.get("up", ())) <= n:
        m = max(n + 1, CHUNK_BYTES + 1)
        base = 0xD1342543DE82EF95
        inverse = pow(base, -1, 1 << 64)
        for name, b in (("up", base), ("down", inverse)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums P of value * base**i; a span's hash is (P[end]-P[start]) * base**-start."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix) - 1)
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _ODD)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of documents that hold at most `most` bytes, or one document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (maximal run of bytes in `table` within a document), and
    the n_docs+1 offsets of the documents in the list of words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[full] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[full[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def windows_inside(bounds: np.ndarray, n: int, size: int) -> np.ndarray:
    """For each of n words, whether a window of `size` words from it stays in its document."""
    if n == 0:
        return np.zeros(0, bool)
    end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(n) + size <= end


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Plans made in here give their shuffle files back when their execution ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_table(df: DataFrame) -> DataFrame:
    """Cut lineage and keep the rows where every executor can read them again."""
    return cut(df)


def fresh(columns: list[str]) -> str:
    """A prefix with which the name of no column begins, in whatever case."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def crc_third(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 3; remainder 1 marks the held-out rows (a null id: 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3, F.lit(0))


#: Rows of a table of ids for each task that walks it, and least tasks.
LINK_ROWS, LINK_TASKS = 100_000, 12


def few_tasks(df: DataFrame) -> tuple[DataFrame, int]:
    """A written table of small rows in as many tasks as its rows ask for, and their number."""
    tasks = max(LINK_TASKS, df.count() // LINK_ROWS)
    return df.coalesce(tasks), tasks  # never more than its partitions


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: (node, component), the smallest node
    reachable.  Every round takes the least label among neighbours and then the label of
    that label, so chains shrink geometrically; rounds end when nothing changes.  Only
    (node, label) rows are shuffled and each round is checkpointed.  A small graph's rounds
    run in fewer tasks than a shuffle has partitions."""
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    links = shared_table(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    links, tasks = few_tasks(links)
    labels = shared_table(links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")).coalesce(tasks))
    while True:
        near = links.join(labels.select(F.col("u").alias("v"), "label"), "v").coalesce(tasks).groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("low")).coalesce(tasks)
        jump = labels.select(F.col("u").alias("low"), F.col("label").alias("far"))
        step = shared_table(low.join(jump, "low", "left").select("u", "label", F.least("low", F.coalesce("far", "low")).alias("new")).coalesce(tasks))
        changed = step.where("new != label").limit(1).count()
        labels = step.select("u", F.col("new").alias("label"))
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))


def joined_components(found: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components (node, component) after further edges: only edges between two of the
    components found so far count, which are few or none."""
    name = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    own = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).join(name("u"), "u", "left").join(name("v"), "v", "left")
    between = shared_table(own.select(F.coalesce("u_in", "u").alias("u"), F.coalesce("v_in", "v").alias("v")).where("u != v").distinct())
    if not between.limit(1).count():
        return found
    moved = components(between, "u", "v").select(F.col("node").alias("component"), F.col("component").alias("into"))
    known = found.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    alone = moved.select(F.col("component").alias("node"), F.col("into").alias("component")).join(found.select("node"), "node", "left_anti")
    return shared_table(known.union(alone))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
