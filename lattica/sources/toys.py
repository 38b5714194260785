"""Toy graphs for tests and examples."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import Graph


def modern(spark: SparkSession) -> Graph:
    # The public six-vertex example graph.
    people = [(1, "person", "marko", 29, None), (2, "person", "vadas", 27, None), (3, "software", "lop", None, "java"), (4, "person", "josh", 32, None), (5, "software", "ripple", None, "java"), (6, "person", "peter", 35, None)]
    links = [(7, "knows", 1, 2, 0.5), (8, "knows", 1, 4, 1.0), (9, "created", 1, 3, 0.4), (10, "created", 4, 5, 1.0), (11, "created", 4, 3, 0.4), (12, "created", 6, 3, 0.2)]
    return Graph(spark.createDataFrame(people, "id long, label string, name string, age int, lang string"), spark.createDataFrame(links, "id long, label string, src long, dst long, weight double"))


def weighted(spark: SparkSession, edges: list[tuple]) -> Graph:
    """A graph of (src, dst, weight), with the endpoints as vertices."""
    rows = [(i, "e", a, b, float(w)) for i, (a, b, w) in enumerate(edges)]
    ids = sorted({x for a, b, _ in edges for x in (a, b)})
    return Graph(spark.createDataFrame([(i, "v") for i in ids], "id long, label string"), spark.createDataFrame(rows, "id long, label string, src long, dst long, weight double"))
