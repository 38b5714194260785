"""A superstep loop over DataFrames, and the graph algorithms built on it.

State is (id, value).  A superstep joins the changed vertices with the edges, combines the
messages per receiver (summed before the shuffle, so hubs do not gather raw messages), and
joins the result back.  The loop halts when nothing changes.  Lineage is cut by a reliable
checkpoint, so a lost executor costs a stage and not the run."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from ..model import Graph
from ..storage import cut


def pregel(graph: Graph, start: DataFrame, message: Column, combine: Callable[[Column], Column], update: Callable[[Column, Column], Column], direction: str = "out", max_rounds: int | None = None, edges: DataFrame | None = None) -> DataFrame:
    """`start(id, value)`: null values are silent.  `message`: expression over `value` and the
    edge's columns; `combine`: an aggregate; `update`: new value from the old one and the
    combined message.  Only vertices that changed send in the next round; rounds go on until
    none has, or fail after `max_rounds`.  Edges are made once, and written before the loop."""
    rows = graph.edges if edges is None else edges
    out = rows.withColumnRenamed("src", "__from").withColumnRenamed("dst", "__to")
    into = rows.withColumnRenamed("dst", "__from").withColumnRenamed("src", "__to")
    sends = cut({"out": out, "in": into, "both": out.unionByName(into)}[direction].drop("id"))
    state = cut(start.select("id", "value", F.col("value").isNotNull().alias("live")))
    for _ in range(max_rounds) if max_rounds is not None else count():
        live = state.where("live").select(F.col("id").alias("__from"), "value")
        got = sends.join(live, "__from").select(F.col("__to").alias("id"), message.alias("__m")).groupBy("id").agg(combine("__m").alias("__m"))
        new = state.join(got, "id", "left").withColumn("__new", F.when(F.col("__m").isNull(), F.col("value")).otherwise(update(F.col("value"), F.col("__m"))))
        state = cut(new.select("id", F.col("__new").alias("value"), (~F.col("__new").eqNullSafe(F.col("value"))).alias("live")))
        if not state.where("live").limit(1).count():
            return state.select("id", "value")
    raise GraphError("no fixpoint within the given rounds")


def max_value(graph: Graph, value: Column | None = None, direction: str = "out") -> DataFrame:
    """Every vertex takes the greatest value that reaches it; the start value is the id."""
    start = graph.vertices.select("id", (F.col("id") if value is None else value).alias("value"))
    return pregel(graph, start, F.col("value"), F.max, F.greatest, direction)


def shortest_paths(graph: Graph, source, weight: Column | None = None, direction: str = "out", unreachable: float | None = None) -> DataFrame:
    """(id, value): least sum of weights from the source; unreachable vertices are null."""
    weight = F.lit(1.0) if weight is None else weight
    start = graph.vertices.select("id", F.when(F.col("id") == source, F.lit(0.0)).alias("value"))
    found = pregel(graph, start, F.col("value") + weight, F.min, lambda old, new: F.least(old, new), direction)
    return found if unreachable is None else found.withColumn("value", F.coalesce("value", F.lit(float(unreachable))))


def bfs(graph: Graph, source, direction: str = "both", max_rounds: int | None = None) -> DataFrame:
    """(id, value): number of hops from the source."""
    start = graph.vertices.select("id", F.when(F.col("id") == source, F.lit(0)).alias("value"))
    return pregel(graph, start, F.col("value") + 1, F.min, lambda old, new: F.least(old, new), direction, max_rounds)


def connected_components(graph: Graph) -> DataFrame:
    """(id, value): the least id of the component.  Labels jump to their label's label, so
    chains shorten geometrically."""
    links = graph.edges.select("src", "dst").where("src != dst")
    links = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    state = cut(graph.vertices.select("id", F.col("id").alias("value")))
    while True:
        near = links.join(state.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("value").alias("near"))
        low = state.join(near, "id", "left").select("id", "value", F.least("value", F.coalesce("near", "value")).alias("low"))
        jump = state.select(F.col("id").alias("low"), F.col("value").alias("far"))
        step = cut(low.join(jump, "low", "left").select("id", "value", F.least("low", F.coalesce("far", "low")).alias("new")))
        moved = step.where("new != value").limit(1).count()
        state = step.select("id", F.col("new").alias("value"))
        if not moved:
            return state


def page_rank(graph: Graph, rounds: int = 10, damping: float = 0.85, weight: Column | None = None) -> DataFrame:
    """(id, value) after a fixed number of rounds; ranks sum to 1, and what vertices without
    out-edges hold is shared by all."""
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    e = graph.edges.select("src", "dst", weight.alias("w"))
    shares = e.join(e.groupBy("src").agg(F.sum("w").alias("total")), "src").groupBy("src", "dst").agg((F.sum("w") / F.first("total")).alias("share"))
    shares = cut(shares)
    n = graph.vertices.count()
    sends = shares.select(F.col("src").alias("id")).distinct().withColumn("sends", F.lit(True))
    state = cut(graph.vertices.select("id").join(sends, "id", "left").withColumn("value", F.lit(1.0 / max(n, 1))))
    for k in range(rounds):
        got = shares.join(state.select(F.col("id").alias("src"), "value"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("value") * F.col("share")).alias("got"))
        lost = state.where("sends IS NULL").agg(F.sum("value")).first()[0] or 0.0
        value = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce(F.col("got"), F.lit(0.0))
        state = state.join(got, "id", "left").select("id", "sends", value.alias("value"))
        state = cut(state) if k % 3 == 2 or k == rounds - 1 else state
    return state.select("id", "value")


def label_propagation(graph: Graph, rounds: int = 5) -> DataFrame:
    """(id, value): each round every vertex takes the label most frequent among its
    neighbours, the least one at ties."""
    links = graph.edges.select("src", "dst").where("src != dst")
    links = cut(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    state = graph.vertices.select("id", F.col("id").alias("value"))
    for _ in range(rounds):
        votes = links.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id"), "value").agg(F.count("*").alias("n"))
        most = votes.groupBy("id").agg(F.max("n").alias("m"))
        least = votes.join(most, "id").where("n = m").groupBy("id").agg(F.min("value").alias("new"))
        state = cut(state.join(least, "id", "left").select("id", F.coalesce("new", "value").alias("value")))
    return state


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c) of all triangles of the undirected simple graph.  Each edge points from
    the endpoint of lower degree to the other, so hubs span few pairs."""
    e = graph.edges.where("src != dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    deg = e.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    e = e.join(deg.withColumnsRenamed({"id": "u", "d": "du"}), "u").join(deg.withColumnsRenamed({"id": "v", "d": "dv"}), "v")
    up = F.struct("du", "u") < F.struct("dv", F.col("v").alias("u"))
    e = cut(e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("y")))
    wedge = e.join(e.withColumnRenamed("y", "z"), "x").where("y < z")
    closed = e.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
    found = wedge.join(closed, ["y", "z"], "left_semi")
    return found.select(F.sort_array(F.array("x", "y", "z")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def triangle_count(graph: Graph) -> DataFrame:
    """(id, value): triangles at each vertex."""
    t = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("value"))
    return graph.vertices.select("id").join(t, "id", "left").select("id", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def motifs(graph: Graph, *pattern: tuple[str, str, str, str | None]) -> DataFrame:
    """Edge patterns (a, edge, b, label): a row of ids for each binding of the names."""
    out, bound = None, set()
    for a, e, b, label in pattern:
        rows = graph.edges if label is None else graph.edges.where(F.col("label") == label)
        own = rows.select(F.col("src").alias(a), F.col("id").alias(e), F.col("dst").alias(b)) if a != b else rows.where("src = dst").select(F.col("src").alias(a), F.col("id").alias(e))
        shared = [x for x in dict.fromkeys((a, b)) if x in bound]
        if out is not None and not shared:
            raise GraphError("a motif must be connected")
        out = own if out is None else out.join(own, shared)
        bound |= {a, b}
    return out


def write_back(graph: Graph, result: DataFrame, key: str) -> Graph:
    """A result (id, value) as a vertex property."""
    named = result.select("id", F.col("value").alias(key))
    rows = graph.vertices.drop(key) if key in graph.vertices.columns else graph.vertices
    return graph.with_(vertices=rows.join(named, "id", "left"))


def derive_edges(graph: Graph, label: str, rows: DataFrame) -> Graph:
    """Edges (src, dst, ...) of a new label; ids come from the endpoints and a number."""
    from pyspark.sql import Window as W

    rest = [c for c in rows.columns if c not in ("src", "dst")]
    order = W.partitionBy("src", "dst").orderBy(*(rest or ["src"]))
    named = rows.withColumn("id", F.concat_ws(":", F.lit(label), "src", "dst", F.row_number().over(order))).withColumn("label", F.lit(label))
    return graph.with_(edges=graph.edges.unionByName(named, allowMissingColumns=True))
