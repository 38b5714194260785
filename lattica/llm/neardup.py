r"""Operator 9, MinHash near-dedup: a chosen-path set similarity join.

A document's set is its distinct shingles of `words` words (64-bit hashes; 4 words unless told
otherwise).  Documents with equal
sets form one class, of which only the smallest id goes on.  `TREES` independent trees
branch classes by minwise tokens: a node at depth two is the pair of tokens chosen there;
nodes with more than `LEAF` members branch deeper, up to four tokens.  Two sets of
similarity 0.8 stay together at depth two with probability 0.64, so twelve trees miss a
link with probability 5e-6.  At depth four this is 0.41 only, so classes of any larger
node at depth two get `MORE` further trees; all of them together miss a link with probability
3e-6 even if every node branches to the end.  Members of a node
are compared exhaustively, first by a 128-slot sketch; what passes it (more than 4.5
standard deviations below the limit) joins a candidate cluster, as a star and never as all
pairs.  A node that is still larger at depth four joins one candidate cluster as it is,
a star around its smallest id, so no pair of a node stays open and the rows follow the
node's size, not its square.

Every candidate cluster is then settled exactly on the full sets.  A cluster of up to
`BLOCK` classes is one block in which all sets are compared.  A larger one is dealt over
blocks of that size; each block also gets the same small random set of pivots, which
connects what is cohesive.  Where a cluster is in several components after that, its links
between components are searched by prefix filtering: the shingles of each set are put in
one order (those that occur in one component only first, for they decide nothing, then by
frequency), and two sets of similarity 0.8 share a shingle among the first ninth of the
smaller and the first fifth of the larger one.  All sets that have such a shingle in their
prefix form a node; shingles with the same members (by count and 128 bits of id hashes) form
one.  The full sets of a node's members in different components are compared, block against
block where it is larger than `BLOCK`; the members of the component that most of the node is
in are not compared among themselves.  Where so many nodes overlap that these comparisons
are more than those of the whole cluster done in the same way, the cluster is the only node
(near copies of one text that are similar by little more or less than 0.8).  This finds every
link of a cluster, whatever its size and shape.  Its work follows the sets' common rare
shingles, and is at most that of comparing the sets outside the cluster's main component
with all of its sets once.

Edge cases: null or empty text, or one without words, has an empty set and is linked with
nothing; fewer than 4 words make one shingle; a row with a null id stands alone with a null
component and is kept; rows that share an id share a component; ties need no rule (the
smallest id represents); empty tables give empty results; only id and text are read, so
clashing extra columns do no harm.  Ids that are not integers are hashed to 64 bits inside,
and the smallest id in its own order names the component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WORDS = 4
TREES, MORE, DEPTH = 12, 12, 4
LEAF, BLOCK, PIVOTS = 200, 200, 32
#: Parts over which the members of one cluster are spread when they meet the cluster's row.
SALTS = 64
SLOTS, EMPTY, SKETCH_MIN = 128, 255, 0.64
PERCENT = 80

_seeds = C.mix(np.arange(1, 2 * (TREES + MORE) * DEPTH + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and their n+1 bounds."""
    low = C.LOWER[data]
    s, e, bounds = C.words(low, offsets, C.SPACE_WORDS)
    h = C.span_hash(C.prefix_hash(C.BYTE_VALUE[low]), s, e)
    prefix = C.prefix_hash(h)
    count = np.diff(bounds)
    full = np.flatnonzero(C.windows_inside(bounds, len(h), words))
    short = np.flatnonzero((count > 0) & (count < words))
    doc = np.concatenate((np.searchsorted(bounds, full, "right") - 1, short))
    grams = np.concatenate((C.span_hash(prefix, full, full + words), C.span_hash(prefix, bounds[short], bounds[short + 1])))
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(offsets)))


def node_keys(grams: np.ndarray, bounds: np.ndarray, trees: range) -> np.ndarray:
    """Node keys (docs, trees * 3) of each set."""
    some = np.flatnonzero(np.diff(bounds))
    first = bounds[:-1][some]
    keys = np.zeros((len(bounds) - 1, len(trees) * (DEPTH - 1)), np.uint64)
    if not len(some):
        return keys
    for k, t in enumerate(trees):
        key = None
        for d in range(DEPTH):
            j = DEPTH * t + d
            least = np.minimum.reduceat((grams ^ _seeds[2 * j]) * (_seeds[2 * j + 1] | np.uint64(1)), first)
            key = C.mix(key ^ least) if d else C.mix(least + np.uint64(t + 1))
            if d:
                keys[some, k * (DEPTH - 1) + d - 1] = key
    return keys


def signatures(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two hashes of each set, node keys of the first trees and sketches (docs, slots)."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    some = np.flatnonzero(size)
    first = bounds[:-1][some]
    sums = np.zeros((2, n), np.uint64)
    keys = node_keys(grams, bounds, range(TREES))
    sketch = np.full((n, SLOTS), EMPTY, np.uint8)
    if len(some):
        for k in range(2):
            sums[k, some] = np.add.reduceat(C.mix(grams ^ _seeds[k]), first)
        g = C.mix(grams + _seeds[0])
        slot = np.repeat(np.arange(n), size) * SLOTS + (g >> np.uint64(57)).astype(np.int64)
        low = np.full(n * SLOTS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(low, slot, g << np.uint64(7))
        held = low != np.iinfo(np.uint64).max
        flat = sketch.reshape(-1)
        flat[held] = (C.mix(low[held]) % np.uint64(EMPTY)).astype(np.uint8)
    return sums[0], sums[1], keys, sketch


def _lists(keys: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel()))


def _sets(batches, words: int):
    """(batch, first row, end, sets and their bounds) of each chunk of texts in the column `text`."""
    for batch in batches:
        data, offsets = C.buffers(batch.column(batch.schema.get_field_index("text")))
        for a, b in C.doc_chunks(offsets):
            yield batch, a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)


def _sign_more(words: int):
    """Node keys of the further trees."""

    def run(batches):
        for batch, a, b, grams, bounds in _sets(batches, words):
            keys = node_keys(grams, bounds, range(TREES, TREES + MORE))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists(keys)], names=["id", "keys"])

    return run


def _sign(words: int):
    def run(batches):
        for batch, a, b, grams, bounds in _sets(batches, words):
            s1, s2, keys, sketch = signatures(grams, bounds)
            columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _lists(keys), pa.array([x.tobytes() for x in sketch], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "s1", "s2", "keys", "sketch"])

    return run


def _grams(words: int):
    """Rows (cluster, component, id, n, gram): every shingle of every text."""

    def run(batches):
        for batch, a, b, grams, bounds in _sets(batches, words):
            size = np.diff(bounds)
            owner = pa.array(a + np.repeat(np.arange(b - a), size))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in range(3)), pa.array(np.repeat(size, size)), pa.array(grams.view(np.int64))], names=["cluster", "component", "id", "n", "gram"])

    return run


def whole_groups(batches, n_keys: int):
    """Tables of whole groups, from batches sorted by their first `n_keys` columns."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        if held:
            change[0] = any(held[-1].column(j)[-1].as_py() != k[0].item() for j, k in enumerate(keys))
        last = np.flatnonzero(change)
        if len(last):
            if last[-1]:
                held.append(batch.slice(0, int(last[-1])))
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(int(last[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds_of(table: pa.Table, n_keys: int) -> np.ndarray:
    change = np.ones(table.num_rows, bool)
    change[1:] = False
    for j in range(n_keys):
        k = table.column(j).to_numpy()
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _pairs(bounds: np.ndarray, most: int = 40_000):
    """All pairs of places (i < j) within each group, in arrays of about `most` pairs."""
    left, right, total = [], [], 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        i, j = _triangle(b - a)
        left.append(i + a)
        right.append(j + a)
        total += len(i)
        if total >= most:
            yield np.concatenate(left), np.concatenate(right)
            left, right, total = [], [], 0
    if left:
        yield np.concatenate(left), np.concatenate(right)


_triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _triangles:
        if len(_triangles) > 64:
            _triangles.clear()
        _triangles[n] = np.triu_indices(n, 1)
    return _triangles[n]


def _least_label(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component of each of n places under the links (i, j), named by its first place."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    return label


def _stars(ids: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """Edges from the first place of each component to its other places.  Rows come sorted by
    id, so that nodes with the same members make the same edges."""
    at = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(ids[label[at]]), pa.array(ids[at])], names=["a", "b"])


def _alike(batches):
    """Star edges between members of a node whose sketches are similar."""
    for table in whole_groups(batches, 1):
        ids = table.column(1).to_numpy()
        sketch = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint8).reshape(-1, SLOTS)
        left, right = [], []
        for i, j in _pairs(bounds_of(table, 1)):
            x, y = sketch[i], sketch[j]
            used = (x != EMPTY) | (y != EMPTY)
            near = ((x == y) & used).sum(1) >= SKETCH_MIN * used.sum(1)
            left.append(i[near])
            right.append(j[near])
        if left:
            yield _stars(ids, _least_label(len(ids), np.concatenate(left), np.concatenate(right)))


def _settle(words: int):
    """Star edges between members of a block whose full sets are similar enough; one of two
    members that are compared is a query."""

    def run(batches):
        for table in whole_groups(batches, 3):
            ids, query = table.column(3).to_numpy(), table.column(4).to_numpy(zero_copy_only=False)
            data, offsets = C.buffers(table.column(5))
            cuts = bounds_of(table, 3)
            left, right = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                grams, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                i, j = _links(grams, bounds, query[a:b])
                left.append(i + a)
                right.append(j + a)
            yield _stars(ids, _least_label(len(ids), np.concatenate(left), np.concatenate(right)))

    return run


def _links(grams: np.ndarray, bounds: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(bounds)
    if len(size) == 2:
        both = np.intersect1d(grams[: bounds[1]], grams[bounds[1] :], assume_unique=True).size
        ok = both and 100 * both >= PERCENT * (size.sum() - both)
        return (np.zeros(1, np.int64), np.ones(1, np.int64)) if ok else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    values, number = np.unique(grams, return_inverse=True)
    flag = np.zeros(len(values), bool)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    some = np.flatnonzero(size)
    for i in np.flatnonzero(query & (size > 0)).tolist():
        own = number[bounds[i] : bounds[i + 1]]
        flag[own] = True
        both = np.add.reduceat(flag[number].astype(np.int32), bounds[:-1][some]).astype(np.int64)
        flag[own] = False
        j = some[100 * both >= PERCENT * (size[some] + size[i] - both)]
        left.append(np.full(len(j), i))
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _leaves(keyed: DataFrame, n_trees: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From rows (id, keys): rows (node, id) to compare, star edges (a, b) of the nodes that are
    too large at the end, and the ids of those too large at depth two."""
    trees = keyed.select("id", F.posexplode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree", "x"), "keys").select("id", "tree", F.expr(f"slice(keys, tree * {DEPTH - 1} + 1, {DEPTH - 1})").alias("path"))
    leaves = over = None
    for d in range(1, DEPTH):
        own = trees.select("id", "path", F.element_at("path", d).alias("node"))
        nodes = own.groupBy("node").agg(F.count("*").alias("members"), F.min("id").alias("pivot")).where("members > 1")
        own = own.join(nodes, "node")
        if d < DEPTH - 1:
            trees = C.shared_table(own.where(F.col("members") > LEAF).select("id", "path"))
            over = trees.select("id").distinct() if over is None else over
        else:
            own = C.shared_table(own.select("node", "members", "pivot", "id"))
        part = own.where(F.col("members") <= LEAF).select("node", "id")
        leaves = part if leaves is None else leaves.union(part)
    return leaves, own.where(F.col("members") > LEAF).select(F.col("pivot").alias("a"), F.col("id").alias("b")), over


def _candidates(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """Rows (node, component): the candidate cluster of each class that has a candidate."""
    leaves, large, over = _leaves(reps.select("id", "keys"), TREES)
    keyed = C.shared_table(docs.join(C.shared_table(over).join(reps.select("id"), "id"), "id", "left_semi").mapInArrow(_sign_more(words), "id long, keys array<long>").distinct())
    more, more_large, _ = _leaves(keyed, MORE)
    rows = leaves.union(more).join(reps.select("id", "sketch"), "id").select("node", "id", "sketch")
    alike = rows.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_alike, "a long, b long")
    return C.components(alike.union(large).union(more_large), "a", "b")


def _questions(members: DataFrame, size: int) -> DataFrame | None:
    """From the members (node, id, component) of nodes: rows (node, block, group, id, query), so
    that every two members in different components meet.  Members outside the component that
    most of their node is in are queries; groups of them meet all members, block by block."""
    members, tasks = C.few_tasks(C.shared_table(members))
    parts = C.shared_table(members.groupBy("node", "component").agg(F.count("*").alias("n")).coalesce(tasks))
    main = parts.groupBy("node").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("all")).where("all > m.n")
    apart = C.shared_table(parts.join(main.select("node", "all", F.col("m.component").alias("main")), "node").where("component != main").select("node", "component", "n", "all").coalesce(tasks))
    if not apart.limit(1).count():
        return None
    open_ = C.shared_table(apart.groupBy("node").agg(F.ceil(F.sum("n") / size).alias("groups"), F.ceil(F.first("all") / size).alias("blocks")).coalesce(tasks))
    asked = members.join(apart.select("node", "component"), ["node", "component"], "left_semi").select("node", "id")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = asked.join(open_, "node").select("node", spread("blocks").alias("block"), F.pmod(F.xxhash64("id", F.lit(5)), "groups").alias("group"), "id", F.lit(True).alias("query"))
    rest = members.join(open_, "node").select("node", F.pmod(F.xxhash64("id"), "blocks").alias("block"), spread("groups").alias("group"), "id", F.lit(False).alias("query"))
    return asked.union(rest)


def _compare(rows: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Edges of rows (node, block, group, id, query) by the full sets of their texts."""
    rows = rows.join(texts, "id").select("node", "block", "group", "id", "query", "text")
    return rows.repartition("node", "block", "group").sortWithinPartitions("node", "block", "group", "id").mapInArrow(_settle(words), "a long, b long").distinct()


def _salted(rows: DataFrame, clusters: DataFrame, how: str) -> DataFrame:
    """Join members of clusters with the clusters' rows; one cluster fills SALTS tasks."""
    salted = clusters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["cluster", "salt"], how).drop("salt")


def _common_prefixes(members: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Rows (cluster, node, id, component) from rows (cluster, component, id): every two sets of a
    cluster that are similar enough and in different components meet in a node."""
    rows = members.join(texts, "id").select("cluster", "component", "id", "text")
    grams, tasks = C.few_tasks(C.shared_table(rows.mapInArrow(_grams(words), "cluster long, component long, id long, n long, gram long")))
    parts = grams.groupBy("cluster", "gram").agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
    useful = C.shared_table(parts.where("low < high").select("cluster", "gram", "held").coalesce(tasks))
    known = grams.join(useful, ["cluster", "gram"], "left").select("id", "n", "gram", "cluster", "component", F.coalesce("held", F.lit(0)).alias("held"))
    place = F.row_number().over(W.partitionBy("id").orderBy("held", "gram"))
    # with sizes x <= y <= 1.25 x, common shingles are 4/9 (x + y) at least: 8/9 of x and 4/5 of y
    first = known.withColumn("place", place).where("held > 0 AND place <= n - ceil(n * 0.8D - 1e-9D) + 1")
    first = first.select("cluster", "gram", "component", "id", (F.col("place") <= F.expr("n - ceil(n * 8 / 9 - 1e-9D) + 1")).alias("short"))
    first = C.shared_table(first.coalesce(tasks))
    # a node has two components and a set that may be the smaller one
    sums = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2)]
    nodes = first.groupBy("cluster", "gram").agg(F.count("*").alias("held"), F.max("short").alias("any"), F.min("component").alias("low"), F.max("component").alias("high"), *sums).where("low < high AND any")
    nodes = nodes.groupBy("cluster", "held", "h1", "h2").agg(F.min("gram").alias("gram"))
    return first.join(C.shared_table(nodes.select("cluster", "gram")), ["cluster", "gram"]).select("cluster", F.xxhash64("cluster", "gram").alias("node"), "id", "component")


def _comparisons(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, asked): comparisons of each group's members outside its main component with all."""
    parts = members.groupBy(*by, "component").agg(F.count("*").alias("n"))
    return parts.groupBy(*by).agg((F.sum("n") * (F.sum("n") - F.max("n"))).alias("asked"))


def _once(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Rows (node, id, component): the nodes of each cluster, or the cluster itself as one node
    where its nodes overlap so much that this takes fewer comparisons."""
    apart = _comparisons(nodes, ["cluster", "node"]).groupBy("cluster").agg(F.sum("asked").alias("apart"))
    whole = C.shared_table(_comparisons(clusters, ["cluster"]).join(apart, "cluster").where("asked < apart").select("cluster"))
    own = _salted(nodes, whole, "left_anti").select("node", "id", "component")
    return own.union(_salted(clusters, whole, "left_semi").select(F.xxhash64("cluster").alias("node"), "id", "component"))


def links(docs: DataFrame, reps: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (node, component): components of the classes under exact links."""
    clusters = _candidates(docs, reps, words).withColumnsRenamed({"component": "cluster", "node": "id"})
    large = C.shared_table(clusters.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    # the texts of candidates, from here on the only texts that move
    texts = C.shared_table(docs.join(clusters.select("id"), "id", "left_semi"))
    dealt = _salted(clusters, large, "left").select("cluster", "id", "size", F.coalesce(F.ceil(F.col("size") / BLOCK), F.lit(1)).alias("blocks"))
    dealt = C.shared_table(dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))))
    chance = (F.xxhash64("id", F.lit(3)) / float(1 << 63) + 1) / 2
    pivots = dealt.where((F.col("blocks") > 1) & (chance < PIVOTS / F.col("size")))
    pivots = pivots.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id")
    first = dealt.select("cluster", "block", "id").union(pivots).distinct().select(F.col("cluster").alias("node"), "block", F.lit(0).alias("group"), "id", F.lit(True).alias("query"))
    found = C.components(_compare(first, texts, words), "a", "b")
    if not large.limit(1).count():
        return found
    named = dealt.where("blocks > 1").join(found.withColumnRenamed("node", "id"), "id", "left").select("cluster", "id", F.coalesce("component", "id").alias("component"))
    parted = named.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("cluster")
    open_ = C.shared_table(_salted(named, parted, "left_semi"))
    if not open_.limit(1).count():
        return found
    open_ = open_.select("cluster", "component", "id")
    asked = _questions(_once(C.shared_table(_common_prefixes(open_, texts, words)), open_), BLOCK)
    return found if asked is None else C.joined_components(found, _compare(asked, texts, words), "a", "b")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (__id, __n, __component), one per document."""
    whole = isinstance(docs.schema[id].dataType, T.IntegralType)
    key = F.col(id).cast("long") if whole else F.when(F.col(id).isNotNull(), F.xxhash64(F.col(id).cast("string")))
    own = docs.select(key.alias("id"), F.col(text).cast("string").alias("text"), F.col(id).alias("name"))
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    signed = C.shared_table(own.select("id", "text").mapInArrow(_sign(words), kind))
    classed = signed.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    reps = C.shared_table(classed)
    with C.released_shuffles(docs.sparkSession):  # every step in there is written before the next one
        found = links(own.where("id IS NOT NULL").select("id", "text"), reps, words)
    named = reps.join(found.withColumnRenamed("node", "id"), "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("c"))
    rows = signed.select("id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("c", "id")).alias("c"))
    if whole:
        return rows.select(F.col("id").cast(docs.schema[id].dataType).alias("__id"), F.col("n").alias("__n"), F.col("c").cast(docs.schema[id].dataType).alias("__component"))
    names = own.select("id", "name").where("id IS NOT NULL").distinct()
    rows = rows.join(names, "id", "left")
    least = rows.where("c IS NOT NULL").groupBy("c").agg(F.min("name").alias("least"))
    return rows.join(least, "c", "left").select(F.col("name").alias("__id"), F.col("n").alias("__n"), F.col("least").alias("__component"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(C.table(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"), F.coalesce(F.col("__id") == F.col("__component"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 3))) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT e.b, r.seen FROM r JOIN e ON r.node = e.a AND r.seen < e.b),
k AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.c AS component_id, coalesce(w.doc_id = k.c, true) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN k ON w.doc_id = k.node
"""
