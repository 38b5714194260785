"""Graphs in files: Parquet folders, JSON lines of elements, GraphML, and text results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import E_META, V_META, Graph


def save(graph: Graph, path: str, mode: str = "error", bucket_vertices: int = 0) -> None:
    """Elements partitioned by label, so that a label filter reads only its folder; with
    `bucket_vertices` edges are clustered by their out vertex within that many files."""
    graph.vertices.write.mode(mode).partitionBy("label").parquet(f"{path}/vertices")
    edges = graph.edges
    if bucket_vertices:
        edges = edges.repartition(bucket_vertices, "src").sortWithinPartitions("label", "src")
    edges.write.mode(mode).partitionBy("label").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str, **settings) -> Graph:
    """Endpoints are not taken for granted; pass intact=True where they are known to exist."""
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), **({"intact": False} | settings))


def save_tables(graph: Graph, name: str, buckets: int = 32) -> None:
    """Catalog tables; edges are bucketed by src, so expansions need no shuffle of edges."""
    graph.vertices.write.mode("overwrite").bucketBy(buckets, "id").saveAsTable(f"{name}_vertices")
    graph.edges.write.mode("overwrite").bucketBy(buckets, "src").sortBy("src").saveAsTable(f"{name}_edges")


def load_tables(spark: SparkSession, name: str) -> Graph:
    return Graph(spark.table(f"{name}_vertices"), spark.table(f"{name}_edges"), intact=False)


def drop_tables(spark: SparkSession, name: str) -> None:
    for part in ("vertices", "edges"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def read_json(spark: SparkSession, path: str, properties: str) -> Graph:
    """Adjacency lines {id, label, properties: {key: [{value}]}, outE: {label: [{id, inV,
    properties}]}} with one vertex a line; `properties` is the DDL of the keys to read, with
    the columns of both kinds (missing ones are null)."""
    names = [p.strip().split()[0] for p in properties.split(",")]
    wrapped = ", ".join(f"{p.strip().split()[0]}: array<struct<value: {p.strip().split()[1]}>>" for p in properties.split(","))
    plain = ", ".join(f"{p.strip().split()[0]}: {p.strip().split()[1]}" for p in properties.split(","))
    rows = spark.read.schema(f"id string, label string, properties struct<{wrapped}>, outE map<string, array<struct<id: string, inV: string, properties: struct<{plain}>>>>").json(path)
    vertices = rows.select("id", "label", *(F.col(f"properties.{n}")[0]["value"].alias(n) for n in names))
    out = rows.where("outE IS NOT NULL").select(F.col("id").alias("src"), F.explode("outE").alias("label", "e")).select("src", "label", F.explode("e").alias("e"))
    edges = out.select(F.col("e.id").alias("id"), "label", "src", F.col("e.inV").alias("dst"), *(F.col(f"e.properties.{n}").alias(n) for n in names))
    return Graph(vertices, edges, intact=False)


def write_json(graph: Graph, path: str) -> None:
    """The inverse: one vertex a line with its out-edges."""
    ek = graph.edge_keys()
    out = graph.edges.select("src", "label", F.struct("id", F.col("dst").alias("inV"), F.struct(*ek).alias("properties") if ek else F.lit(None).alias("properties")).alias("e"))
    out = out.groupBy("src", "label").agg(F.collect_list("e").alias("e")).groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("label", "e"))).alias("outE"))
    props = F.struct(*(F.when(F.col(k).isNotNull(), F.array(F.struct(F.col(k).alias("value")))).alias(k) for k in graph.vertex_keys()))
    graph.vertices.select(*V_META, props.alias("properties")).join(out.withColumnRenamed("src", "id"), "id", "left").write.json(path)


def read_graphml(spark: SparkSession, path: str, types: dict[str, str]) -> Graph:
    """GraphML by Spark's XML reader: nodes and edges with <data key=...> children."""
    data = "data array<struct<_key: string, _VALUE: string>>"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    links = spark.read.format("xml").option("rowTag", "edge").schema(f"_id string, _source string, _target string, {data}").load(path)

    def keyed(df: DataFrame, label_key: str) -> list:
        held = F.map_from_entries(F.transform("data", lambda x: F.struct(x["_key"], F.trim(x["_VALUE"]))))
        return [F.get(F.map_values(F.map_filter(held, lambda k, _: k == label_key)), 0).alias("label"), *(held[k].cast(t).alias(k) for k, t in types.items())]

    return Graph(nodes.select(F.col("_id").alias("id"), *keyed(nodes, "labelV")), links.select(F.col("_id").alias("id"), F.col("_source").alias("src"), F.col("_target").alias("dst"), *keyed(links, "labelE")))


def write_graphml(graph: Graph, path: str) -> None:
    """Folders `nodes` and `edges` of XML files that read_graphml reads as they are."""
    def rows(table: DataFrame, attributes: dict[str, str], label: str, keys: list[str]) -> DataFrame:
        pairs = [("label", label), *((k, k) for k in keys)]
        data = F.array(*(F.struct(F.lit(name).alias("_key"), F.col(f"`{c}`").cast("string").alias("_VALUE")) for c, name in pairs))
        return table.select(*(F.col(c).cast("string").alias(n) for c, n in attributes.items()), F.filter(data, lambda x: x["_VALUE"].isNotNull()).alias("data"))

    write = lambda df, tag: df.write.format("xml").option("rootTag", "graph").option("rowTag", tag).save(f"{path}/{tag}s")
    write(rows(graph.vertices, {"id": "_id"}, "labelV", graph.vertex_keys()), "node")
    write(rows(graph.edges, {"id": "_id", "src": "_source", "dst": "_target"}, "labelE", graph.edge_keys()), "edge")


def write_text(result: DataFrame, path: str) -> None:
    """(id, value) as tab-separated text."""
    result.select(F.col("id").cast("string"), F.col("value").cast("string")).write.csv(path, sep="\t")


def vertex_values(graph: Graph, key: str = "id") -> DataFrame:
    """(id, value) of the vertices that have the key; `id` and `label` are keys too."""
    return graph.vertices.select("id", F.col(key).alias("value")).where("value IS NOT NULL")


def edge_values(graph: Graph, key: str = "id") -> DataFrame:
    return graph.edges.select("src", "dst", F.col(key).alias("value")).where("value IS NOT NULL")


def dump(graph: Graph, n: int = 20) -> str:
    """The first rows of both tables as text."""
    rows = lambda df: "\n".join(json.dumps(r.asDict(), default=str) for r in df.limit(n).collect())
    return f"{rows(graph.vertices)}\n{rows(graph.edges.select(*E_META, *graph.edge_keys()))}"
