"""Direct lookups on elements: scans, ids, labels, equality, half-open ranges, key pages.

All of them are filters on the element table, so label and property predicates reach the
Parquet scan; a page is a filter and a top-k.  An index never changes a result: it is a
sorted projection (`index_projection`) that a page or range may read instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError, NotFound, NotValid
from ..model import Graph

#: Ids up to this number are sent as a literal table; it is joined by broadcast.
MANY_IDS = 10_000


def rows(graph: Graph, kind: str) -> DataFrame:
    return graph.vertices if kind == "vertex" else graph.edges


def by_ids(graph: Graph, kind: str, ids: list) -> DataFrame:
    """Multi-get: missing ids are dropped and duplicates kept; a null id is an error."""
    if any(x is None for x in ids):
        raise GraphError("an id is null")
    table = rows(graph, kind)
    if not ids:
        return table
    wanted = graph.spark.createDataFrame([(x,) for x in ids], f"__want {dict(table.dtypes)['id']}")
    wanted = F.broadcast(wanted) if len(ids) <= MANY_IDS else wanted
    return table.join(wanted, F.col("id") == F.col("__want")).drop("__want")


def one(graph: Graph, kind: str, id) -> DataFrame:
    found = rows(graph, kind).where(F.col("id") == id).limit(1)
    if not found.take(1):
        raise NotFound(f"no {kind} {id}")
    return found


def by_label(graph: Graph, kind: str, label: str) -> DataFrame:
    return rows(graph, kind).where(F.col("label") == label)


def by_value(graph: Graph, kind: str, label: str, key: str, value) -> DataFrame:
    """A null value matches nothing."""
    if value is None:
        return by_label(graph, kind, label).where(F.lit(False))
    return by_label(graph, kind, label).where(F.col(key) == value)


def in_range(graph: Graph, kind: str, label: str, key: str, low, high) -> DataFrame:
    """[low, high)"""
    return by_label(graph, kind, label).where((F.col(key) >= low) & (F.col(key) < high))


def page(table: DataFrame, keys: list[str], start, limit: int, reverse: bool = False) -> DataFrame:
    """`limit` rows in order of `keys` from `start` (of the first key, inclusive; null: from
    the end), rows without the key left out.  One top-k, no global sort."""
    first = F.col(keys[0])
    kept = table.where(first.isNotNull())
    if start is not None:
        kept = kept.where(first <= start if reverse else first >= start)
    return kept.orderBy(*((F.col(k).desc() if reverse else F.col(k).asc()) for k in keys)).limit(limit)


def id_page(graph: Graph, kind: str, start, limit: int) -> DataFrame:
    return page(rows(graph, kind), ["id"], start, limit)


def key_page(graph: Graph, kind: str, label: str, key: str, start, limit: int, reverse: bool = False) -> DataFrame:
    """Needs an index that serves reads, as pages are a promise of the index."""
    if graph.catalog.index(kind, label, key) is None:
        raise NotValid(f"no active index on {label}.{key}")
    return page(by_label(graph, kind, label), [key, "id"], start, limit, reverse)


def index_projection(graph: Graph, kind: str, label: str, key: str) -> DataFrame:
    """(key, id) of the elements that have the key, as the index holds them."""
    extra = [] if kind == "vertex" else [F.col("src"), F.col("dst")]
    return by_label(graph, kind, label).where(F.col(key).isNotNull()).select(F.col(key).alias("value"), "id", *extra)


def build_index(graph: Graph, kind: str, label: str, key: str, path: str | None = None, buckets: int = 0) -> tuple[Graph, DataFrame]:
    """Populate: BUILDING, check a unique index, write the sorted projection, ACTIVE."""
    catalog = graph.catalog.set_state(kind, label, key, "BUILDING")
    index = index_projection(graph, kind, label, key)
    if catalog.indices[kind, label, key].unique:
        from ..errors import NotUnique

        by = ["value"] if kind == "vertex" else ["src", "value"]
        if index.groupBy(*by).count().where("count > 1").take(1):
            raise NotUnique(f"values of {label}.{key} repeat")
    if path:
        ordered = index.repartitionByRange(buckets, "value") if buckets else index.repartitionByRange("value")
        ordered.sortWithinPartitions("value", "id").write.mode("overwrite").parquet(path)
        index = graph.spark.read.parquet(path)
    return graph.with_(catalog=catalog.set_state(kind, label, key, "ACTIVE")), index


def drop_index(graph: Graph, kind: str, label: str, key: str) -> Graph:
    catalog = graph.catalog.set_state(kind, label, key, "INACTIVE")
    return graph.with_(catalog=catalog.set_state(kind, label, key, "DROPPED"))


def orphans(index: DataFrame, elements: DataFrame) -> DataFrame:
    """Index rows whose element is gone: the audit that stands for stale-row removal."""
    return index.join(elements.select("id"), "id", "left_anti")


def properties(table: DataFrame, *keys: str, meta: tuple[str, ...] = ("id", "label", "src", "dst")) -> DataFrame:
    """One row (id, key, value) for each property that an element has; values as text."""
    keys = keys or tuple(c for c in table.columns if c not in meta)
    entries: list[Column] = [F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").cast("string").alias("value")) for k in keys]
    return table.select("id", F.explode(F.array(*entries)).alias("p")).select("id", "p.key", "p.value").where("value IS NOT NULL")
