"""The star schema as a property graph: customers, orders, parts, suppliers, nations and
regions are vertices; foreign keys are edges.

Every label is a branch of a union with a literal label column, so a filter on the label
removes the other branches from the plan and only that table is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import Graph
from ..storage import cut


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(label: str, column: str):
    return F.concat(F.lit(f"{label}:"), F.col(column).cast("string"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# label, table, primary key
VERTICES = (("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"), ("part", "part", "p_partkey"), ("order", "orders", "o_orderkey"))
# label, table, primary key, from label and key, to label and key, properties
EDGES = (
    ("in_region", "nation", "n_nationkey", ("nation", "n_nationkey"), ("region", "n_regionkey"), ()),
    ("customer_in", "customer", "c_custkey", ("customer", "c_custkey"), ("nation", "c_nationkey"), ()),
    ("supplier_in", "supplier", "s_suppkey", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), ()),
    ("placed", "orders", "o_orderkey", ("customer", "o_custkey"), ("order", "o_orderkey"), ("o_orderdate", "o_totalprice")),
)
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with `suffix`, a unique name of each row (line numbers repeat)."""
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return read(spark, sf_dir, "lineitem").withColumn("suffix", F.concat_ws("/", F.col("l_orderkey").cast("string"), n.cast("string")))


def vertex_table(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    table, key = next((t, k) for x, t, k in VERTICES if x == label)
    return read(spark, sf_dir, table).withColumns({"id": _key(label, key), "label": F.lit(label)})


def edge_table(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    if label in ("contains", "shipped_by"):
        rows = lines(spark, sf_dir)
        to = _key("part", "l_partkey") if label == "contains" else _key("supplier", "l_suppkey")
        keep = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"] if label == "contains" else ["l_quantity", "l_shipdate"]
        return rows.select(F.concat(F.lit(f"{label}:"), "suffix").alias("id"), F.lit(label).alias("label"), _key("order", "l_orderkey").alias("src"), to.alias("dst"), *keep)
    _, table, key, src, dst, keep = next(x for x in EDGES if x[0] == label)
    return read(spark, sf_dir, table).select(_key(label, key).alias("id"), F.lit(label).alias("label"), _key(*src).alias("src"), _key(*dst).alias("dst"), *keep)


def graph(spark: SparkSession, sf_dir: str, vertices: tuple[str, ...] | None = None, edges: tuple[str, ...] | None = None) -> Graph:
    """The graph with all labels, or with those named."""
    vs = [vertex_table(spark, sf_dir, x) for x in vertices or [v[0] for v in VERTICES]]
    es = [edge_table(spark, sf_dir, x) for x in (edges if edges is not None else [*(e[0] for e in EDGES), "contains", "shipped_by"])]
    es = _union(es) if es else spark.createDataFrame([], "id string, label string, src string, dst string")
    return Graph(_union(vs), es)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations, and how much one buys from another: (customer's, supplier's) nation."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supp = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
    traded = pairs.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("revenue"))
    edges = traded.select(F.concat_ws(":", F.lit("trades_with"), "c_nationkey", "s_nationkey").alias("id"), F.lit("trades_with").alias("label"), _key("nation", "c_nationkey").alias("src"), _key("nation", "s_nationkey").alias("dst"), "n", "revenue")
    return Graph(vertex_table(spark, sf_dir, "nation"), edges)


def with_next(events: DataFrame, type: str, order: list[str], value: str) -> DataFrame:
    """`events` with __next, the value of the event that follows within its type, or null.  Events
    are sorted by range over all tasks, so a frequent type fills many of them; a partition's last
    event of a type looks at the first ones of later partitions (a row a partition and type)."""
    parts = max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # written once, so that partitions keep their numbers
    rows = cut(events.repartitionByRange(parts, type, *order).withColumn("__part", F.spark_partition_id()))
    near = F.lead(value).over(W.partitionBy("__part", type).orderBy(*order))
    firsts = rows.groupBy(type, "__part").agg(F.min_by(value, F.struct(*order)).alias("__first"))
    after = firsts.select(F.col(type).alias("__t"), F.col("__part").alias("__p"), F.lead("__first").over(W.partitionBy(type).orderBy("__part")).alias("__first"))
    # a row for each type and partition: bounded by the number of types plus partitions
    rows = rows.withColumn("__next", near).join(after, F.col(type).eqNullSafe(F.col("__t")) & (F.col("__part") == F.col("__p")))
    return rows.withColumn("__next", F.coalesce("__next", "__first")).drop("__part", "__first", "__t", "__p")


def with_place(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with __place from 1 on in this order: sorted by range over all tasks, and numbered
    from the counts of the partitions before (one row for each partition)."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = cut(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    bases = kept.groupBy("__part").count().select("__part", F.coalesce(before, F.lit(0)).alias("__base"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return kept.withColumn("__n", own).join(bases, "__part").withColumn("__place", F.col("__base") + F.col("__n")).drop("__part", "__base", "__n")


def user_sequence(spark: SparkSession, sf_dir: str) -> Graph:
    """Users, and an edge from each event's user to the user of the next event of its type."""
    e = read(spark, sf_dir, "events")
    steps = with_next(e, "event_type", ["ts", "event_id"], "user_id").where("__next IS NOT NULL")
    edges = steps.select(F.concat(F.lit("next_user:"), F.col("event_id").cast("string")).alias("id"), F.lit("next_user").alias("label"), F.col("user_id").alias("src"), F.col("__next").alias("dst"), "value")
    return Graph(e.select(F.col("user_id").alias("id"), F.lit("user").alias("label")).distinct(), edges)
