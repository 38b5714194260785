"""Adjacency: incident edges and adjacent vertices of a set of vertices, set-oriented.

The starting vertices are a DataFrame, so one join expands all of them; Spark picks the
join from the sizes, and adaptive execution splits hubs.  Neighbours come once per edge
(parallel edges repeat them, a self-loop appears in both directions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Graph


def incident(graph: Graph, start: DataFrame, direction: str = "both", labels: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """Rows (v, dir, other, edge, label, ...) of the edges at the vertices `start(id)`."""
    inc = graph.incidence(direction, *labels)
    if where is not None:
        inc = inc.where(where)
    return inc.join(start.select(F.col("id").alias("v")), "v")


def equal_to(key: str, value) -> Column:
    """A null value matches nothing."""
    return F.lit(False) if value is None else F.col(key) == value


def within_range(key: str, low, high) -> Column:
    return (F.col(key) >= low) & (F.col(key) < high)


def incident_page(graph: Graph, start: DataFrame, direction: str, label: str, key: str, low, limit: int, reverse: bool = False) -> DataFrame:
    """The first `limit` edges of each vertex in key order (a limit per vertex is the feature).
    Where the group limit applies, Spark cuts groups before the shuffle."""
    rows = incident(graph, start, direction, (label,), F.col(key).isNotNull())
    if low is not None:
        rows = rows.where(F.col(key) <= low if reverse else F.col(key) >= low)
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in (key, "other", "edge")]
    ranked = rows.withColumn("__rank", F.row_number().over(W.partitionBy("v").orderBy(*order)))
    return ranked.where(F.col("__rank") <= limit).drop("__rank")


def adjacent(graph: Graph, edges: DataFrame) -> DataFrame:
    """Rows of incident edges -> (v, <vertex>); dangling neighbours are dropped unless the
    graph keeps them."""
    how = "left" if graph.keep_dangling else "inner"
    ends = edges.select("v", F.col("other").alias("id"))
    return ends.join(graph.vertices, "id", how)


def neighbours(graph: Graph, start: DataFrame, direction: str = "both", labels: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    return adjacent(graph, incident(graph, start, direction, labels, where))


def endpoints(graph: Graph, edges: DataFrame, direction: str = "both") -> DataFrame:
    """(edge, <vertex>) of the out vertex, the in vertex, or both in this order."""
    def end(column: str, rank: int) -> DataFrame:
        return edges.select(F.col("id").alias("edge"), F.lit(rank).alias("end"), F.col(column).alias("id")).join(graph.vertices, "id")

    parts = {"out": [("src", 0)], "in": [("dst", 1)], "both": [("src", 0), ("dst", 1)]}[direction.lower()]
    found = [end(*p) for p in parts]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def degrees(graph: Graph, direction: str = "both", *labels: str) -> DataFrame:
    """(id, degree), from edges alone."""
    return graph.incidence(direction, *labels).groupBy(F.col("v").alias("id")).agg(F.count("*").alias("degree"))


def dangling(graph: Graph) -> DataFrame:
    """Edges with a missing endpoint."""
    ids = graph.vertices.select("id")
    lost = lambda c: graph.edges.join(ids.withColumnRenamed("id", c), c, "left_anti").select(graph.edges.columns)
    return lost("src").unionByName(lost("dst")).distinct()


# neighbourhood reductions


def reduce_edges(graph: Graph, value: Column, how=F.min, direction: str = "out", where: Column | None = None) -> DataFrame:
    """(id, value): an aggregate of an expression over the edges of each vertex."""
    inc = graph.incidence(direction)
    inc = inc if where is None else inc.where(where)
    return inc.groupBy(F.col("v").alias("id")).agg(how(value).alias("value"))


def reduce_neighbours(graph: Graph, value: Column, how=F.sum, direction: str = "in", where: Column | None = None) -> DataFrame:
    """(id, value): an aggregate over the neighbours' vertices."""
    inc = graph.incidence(direction)
    inc = (inc if where is None else inc.where(where)).select("v", "other")
    far = graph.vertices.select(F.col("id").alias("other"), value.alias("__value"))
    return inc.join(far, "other").groupBy(F.col("v").alias("id")).agg(how("__value").alias("value"))


def neighbour_pairs(graph: Graph, where: Column, direction: str = "out") -> DataFrame:
    """(v, other) of the edges that qualify, both ends present."""
    ids = graph.vertices.select("id")
    inc = graph.incidence(direction).where(where).select("v", "other")
    return inc.join(ids.withColumnRenamed("id", "v"), "v").join(ids.withColumnRenamed("id", "other"), "other").select("v", "other")
