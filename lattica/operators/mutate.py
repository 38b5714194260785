"""Mutations as batch edits: each takes a batch DataFrame and gives a new Graph.

The checks (unique ids, schema, unique indices) are one aggregation or semi join over the
batch, never a lookup per row.  Bulk variants append without checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NoSchema, NotUnique, NotValid
from ..model import E_META, STAMPS, V_META, Graph
from .catalog import COUNTER


def _stamped(batch: DataFrame, like: DataFrame) -> DataFrame:
    for c in STAMPS:
        if c in like.columns and c not in batch.columns:
            batch = batch.withColumn(c, F.current_timestamp())
    return batch


def _named(batch: DataFrame, default: str) -> DataFrame:
    """Missing ids become random text ids, missing labels the default one."""
    if "id" not in batch.columns:
        batch = batch.withColumn("id", F.expr("uuid()"))
    if "label" not in batch.columns:
        batch = batch.withColumn("label", F.lit(default))
    return batch.withColumn("label", F.coalesce("label", F.lit(default)))


def _check_new(graph: Graph, kind: str, batch: DataFrame, table: DataFrame, meta: tuple[str, ...]) -> None:
    if batch.groupBy("id").count().where("count > 1").take(1) or batch.join(table.select("id"), "id", "left_semi").take(1):
        raise NotUnique(f"a {kind} id exists")
    if graph.catalog.use_schema:
        graph.catalog.check_types(kind, batch, (*meta, *STAMPS))
    for index in graph.catalog.list_indices(kind, "write"):
        if index.unique and index.key in batch.columns:
            by = [index.key] if kind == "vertex" else ["src", index.key]
            own = batch.where((F.col("label") == index.label) & F.col(index.key).isNotNull()).select(*by)
            if index.key in table.columns:
                own = own.unionByName(table.where((F.col("label") == index.label) & F.col(index.key).isNotNull()).select(*by))
            if own.groupBy(*by).count().where("count > 1").take(1):
                raise NotUnique(f"values of {index.label}.{index.key} repeat")


def add_vertices(graph: Graph, batch: DataFrame, check: bool = True) -> Graph:
    batch = _stamped(_named(batch, "vertex"), graph.vertices)
    if check:
        _check_new(graph, "vertex", batch, graph.vertices, V_META)
    return graph.with_(vertices=graph.vertices.unionByName(batch, allowMissingColumns=True))


def add_edges(graph: Graph, batch: DataFrame, check: bool = True) -> Graph:
    batch = _stamped(_named(batch, "edge"), graph.edges)
    if check:
        if graph.catalog.use_schema:
            graph.catalog.check_connections(batch, graph.vertices)
        _check_new(graph, "edge", batch, graph.edges, E_META)
    checked = check and graph.catalog.use_schema  # then the endpoints were looked up
    return graph.with_(intact=graph.intact and checked, edges=graph.edges.unionByName(batch, allowMissingColumns=True))


def bulk_add(graph: Graph, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> Graph:
    """Append without existence checks."""
    if vertices is not None:
        graph = add_vertices(graph, vertices, check=False)
    return graph if edges is None else add_edges(graph, edges, check=False)


def remove_vertices(graph: Graph, ids: DataFrame) -> Graph:
    """With all incident edges."""
    ids = ids.select("id").distinct()
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
    return graph.with_(vertices=graph.vertices.join(ids, "id", "left_anti"), edges=edges.select(graph.edges.columns))


def remove_edges(graph: Graph, ids: DataFrame) -> Graph:
    return graph.with_(edges=graph.edges.join(ids.select("id").distinct(), "id", "left_anti"))


def _one_each(batch: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row of each key: the last by the column `order`, which is left out of the result.
    Without an order, rows of one key must be equal; others fail when the batch is read."""
    rest = [c for c in batch.columns if c not in keys and c != order]
    rows = batch.select(*keys, F.struct(*rest).alias("__row"), *([F.col(order).alias("__order")] if order else []))
    if order:
        one = F.max_by("__row", "__order")
    else:
        same = F.min(F.xxhash64("__row")) == F.max(F.xxhash64("__row"))
        one = F.when(same, F.first("__row")).otherwise(F.raise_error(F.lit("a key of the batch has different rows, and no order")))
    return rows.groupBy(*keys).agg(one.alias("__row")).select(*keys, *(F.col("__row").getField(c).alias(c) for c in rest))


def set_property(graph: Graph, kind: str, key: str, updates: DataFrame, remove_nulls: bool = True, order: str | None = None) -> Graph:
    """`updates(id, value)`: sets the key of these elements; a null value removes it.  An id
    may come more than once with one value, or with several and a column `order`, whose last
    value holds."""
    updates = _one_each(updates.select("id", "value", *([order] if order else [])), ["id"], order)
    table = graph.vertices if kind == "vertex" else graph.edges
    if graph.catalog.use_schema:
        touched = table.join(updates.select("id"), "id", "left_semi").select("label").distinct().collect()
        kinds = dict(updates.dtypes)
        for r in touched:
            declared = graph.catalog.label(kind, r.label).properties
            if key not in declared or declared[key] not in ("any", kinds["value"], COUNTER if kinds["value"] == "bigint" else None):
                raise NotValid(f"{r.label}.{key} does not take {kinds['value']}")
    new = updates.select(F.col("id").alias("__id"), F.col("value").alias("__value"))
    joined = table.join(new, F.col("id") == F.col("__id"), "left")
    old = F.col(f"`{key}`") if key in table.columns else F.lit(None).cast(dict(updates.dtypes)["value"])
    hit = F.col("__id").isNotNull()
    value = F.when(hit, F.col("__value") if remove_nulls else F.coalesce("__value", old)).otherwise(old)
    out = joined.withColumn(key, value)
    if "updated_at" in table.columns:
        out = out.withColumn("updated_at", F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at")))
    out = out.drop("__id", "__value")
    changed = graph.with_(vertices=out) if kind == "vertex" else graph.with_(edges=out)
    for index in graph.catalog.list_indices(kind, "write"):
        if index.unique and index.key == key:
            rows = out.where((F.col("label") == index.label) & F.col(key).isNotNull())
            if rows.groupBy(*([key] if kind == "vertex" else ["src", key])).count().where("count > 1").take(1):
                raise NotUnique(f"values of {index.label}.{key} repeat")
    return changed


def remove_property(graph: Graph, kind: str, key: str, ids: DataFrame) -> Graph:
    table = graph.vertices if kind == "vertex" else graph.edges
    nothing = F.lit(None).cast(dict(table.dtypes)[key])
    return set_property(graph.with_(catalog=graph.catalog), kind, key, ids.select("id", nothing.alias("value")))


def increment(graph: Graph, kind: str, key: str, deltas: DataFrame) -> Graph:
    """Counters: deltas(id, value) are summed per element first, so hot counters shrink
    before the join.  The labels of all elements that are met must declare the counter."""
    if not graph.catalog.use_schema:
        raise NoSchema("counters need a schema")
    table = graph.vertices if kind == "vertex" else graph.edges
    total = deltas.groupBy(F.col("id").alias("__id")).agg(F.sum("value").cast("long").alias("__delta"))
    for r in table.join(total, F.col("id") == F.col("__id"), "left_semi").select("label").distinct().collect():
        if graph.catalog.label(kind, r.label).properties.get(key) != COUNTER:
            raise NotValid(f"{r.label}.{key} is no counter")
    old = F.col(f"`{key}`") if key in table.columns else F.lit(None).cast("long")
    hit = F.col("__id").isNotNull()
    out = table.join(total, F.col("id") == F.col("__id"), "left").withColumn(key, F.when(hit, F.coalesce(old, F.lit(0)) + F.col("__delta")).otherwise(old))
    if "updated_at" in table.columns:
        out = out.withColumn("updated_at", F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at")))
    out = out.drop("__id", "__delta")
    return graph.with_(vertices=out) if kind == "vertex" else graph.with_(edges=out)


def _merged(table: DataFrame, batch: DataFrame, on: list[str], setters: dict[str, Column]) -> DataFrame:
    """`table` with the setters (over __<column> of the batch) applied where a row matches."""
    keyed = batch.select(*(F.col(c).alias(f"__{c}") for c in batch.columns), F.lit(True).alias("__hit"))
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    hit = table.join(keyed, match, "left")
    if "updated_at" in table.columns:
        setters = setters | {"updated_at": F.current_timestamp()}
    new = {c: F.when(F.col("__hit"), v).otherwise(F.col(f"`{c}`") if c in table.columns else F.lit(None)) for c, v in setters.items()}
    return hit.withColumns(new).select(*table.columns, *(c for c in setters if c not in table.columns))


def _unmatched(batch: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    there = table.select(*(F.col(c).alias(f"__{c}") for c in on)).distinct()
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return batch.join(there, match, "left_anti")


def merge_vertices(graph: Graph, batch: DataFrame, on: list[str], on_match: dict[str, Column] | None = None, order: str | None = None) -> Graph:
    """Upsert: rows of `batch` that match a vertex on `on` update it, the others are added.  Of
    rows with one key the last by the column `order` holds; without it they must be equal."""
    batch = _one_each(batch, on, order)
    setters = {c: F.col(f"__{c}") for c in batch.columns if c not in (*on, "id")} if on_match is None else on_match
    kept = _merged(graph.vertices, batch, on, setters)
    return add_vertices(graph.with_(vertices=kept), _unmatched(batch, graph.vertices, on), check=False)


def merge_edges(graph: Graph, batch: DataFrame, order: str | None = None) -> Graph:
    """Upsert of edges by (label, src, dst); repeated keys as in merge_vertices."""
    on = ["label", "src", "dst"]
    batch = _one_each(batch, on, order)
    kept = _merged(graph.edges, batch, on, {c: F.col(f"__{c}") for c in batch.columns if c not in (*on, "id")})
    return add_edges(graph.with_(edges=kept), _unmatched(batch, graph.edges, on), check=False)


def create_absent(graph: Graph, batch: DataFrame, order: str | None = None) -> tuple[Graph, DataFrame]:
    """The graph with the vertices of `batch` whose ids are new, and the rows that were not."""
    batch = _one_each(batch, ["id"], order)
    ids = graph.vertices.select("id")
    return add_vertices(graph, batch.join(ids, "id", "left_anti"), check=False), batch.join(ids, "id", "left_semi")


def clear(graph: Graph) -> Graph:
    return graph.with_(vertices=graph.vertices.limit(0), edges=graph.edges.limit(0))
