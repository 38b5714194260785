"""The graph queries by name, each with the SQL that gives the same rows on the tables.

Every query goes through the public API over the star schema's graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import NotUnique, NotValid
from .functions import scalars as S
from .functions import values as X
from .model import Graph, to_map_layout, to_wide_layout
from .operators import adjacency as A
from .operators import lookup as L
from .operators import mutate as M
from .operators.catalog import Catalog
from .plans import pregel as G
from .plans import predicates as P
from .plans.traversal import __
from .sources import star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _money(c: str):
    return F.round(F.sum(F.col(c).cast("decimal(18,2)")).cast("double"), 2)


CUSTOMER = "'customer:' || c_custkey"
ORDER = "'order:' || o_orderkey"
LINES = "(SELECT *, l_orderkey || '/' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS suffix FROM lineitem)"
# (v, other) of the edges between customers and nations, nations and regions, both ways
VERTEX_LABELS = "SELECT 'region' AS label, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'order', count(*) FROM orders"


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Order value by market segment, walked from customers over placed edges."""
    g = star.graph(s, d, ("customer", "order"), ("placed",))
    t = g.V().hasLabel("customer").as_("c").out("placed").as_("o").select("c", "o").df()
    segments = g.vertices.select(F.col("id").alias("c"), "c_mktsegment")
    totals = g.vertices.select(F.col("id").alias("o"), "o_totalprice")
    return t.join(segments, "c").join(totals, "o").groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), _money("o_totalprice").alias("total"))


@query("SELECT c_mktsegment, count(*) AS n_orders, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def g00_segment_totals(s, d):
    return flagship(s, d)


# scans and lookups


@query(VERTEX_LABELS)
def s01_vertices(s, d):
    return star.graph(s, d).vertices.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT 'placed' AS label, count(*) AS n FROM orders UNION ALL SELECT 'contains', count(*) FROM lineitem UNION ALL SELECT 'shipped_by', count(*) FROM lineitem UNION ALL SELECT 'in_region', count(*) FROM nation UNION ALL SELECT 'customer_in', count(*) FROM customer UNION ALL SELECT 'supplier_in', count(*) FROM supplier")
def s02_edges(s, d):
    return star.graph(s, d).edges.groupBy("label").agg(F.count("*").alias("n"))


@query(f"SELECT {CUSTOMER} AS id, c_name FROM customer WHERE {CUSTOMER} >= 'customer:5' ORDER BY 1 LIMIT 40")
def s03_vertex_page(s, d):
    return L.id_page(star.graph(s, d, ("customer",), ()), "vertex", "customer:5", 40).select("id", "c_name")


@query("SELECT 'placed:' || o_orderkey AS id, 'customer:' || o_custkey AS src FROM orders WHERE 'placed:' || o_orderkey >= 'placed:2' ORDER BY 1 LIMIT 30")
def s04_edge_page(s, d):
    return L.id_page(star.graph(s, d, ("customer",), ("placed",)), "edge", "placed:2", 30).select("id", "src")


@query(f"SELECT {CUSTOMER} AS id, c_name FROM customer, (VALUES (3), (3), (7)) w(x) WHERE c_custkey = x")
def s05_multi_get(s, d):
    return L.by_ids(star.graph(s, d), "vertex", ["customer:3", "customer:3", "customer:7", "customer:none"]).select("id", "c_name")


@query("SELECT 'placed:' || o_orderkey AS id, 'order:' || o_orderkey AS dst FROM orders WHERE o_orderkey IN (0, 5, 9)")
def s06_multi_get_edges(s, d):
    return L.by_ids(star.graph(s, d, None, ("placed",)), "edge", ["placed:0", "placed:5", "placed:9"]).select("id", "dst")


@query("SELECT 'part:11' AS id, p_name FROM part WHERE p_partkey = 11")
def s07_point_get(s, d):
    return L.one(star.graph(s, d, ("part",), ()), "vertex", "part:11").select("id", "p_name")


@query("SELECT 'supplier:' || s_suppkey AS id, s_name FROM supplier")
def s08_label_scan(s, d):
    return L.by_label(star.graph(s, d), "vertex", "supplier").select("id", "s_name")


@query(f"SELECT {CUSTOMER} AS id FROM customer WHERE c_mktsegment = 'BUILDING'")
def s09_label_eq(s, d):
    return L.by_value(star.graph(s, d), "vertex", "customer", "c_mktsegment", "BUILDING").select("id")


@query(f"SELECT {ORDER} AS id, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000")
def s10_label_range(s, d):
    return L.in_range(star.graph(s, d), "vertex", "order", "o_totalprice", 1000.0, 50000.0).select("id", "o_totalprice")


def _indexed(s, d, label, key, unique=False):
    g = star.graph(s, d, (label,), ())
    return L.build_index(g.with_(catalog=Catalog().create_index("vertex", label, key, unique)), "vertex", label, key)


@query("SELECT 'part:' || p_partkey AS id, p_retailprice FROM part WHERE p_retailprice >= 950 ORDER BY p_retailprice, 1 LIMIT 25")
def s11_key_page(s, d):
    return L.key_page(_indexed(s, d, "part", "p_retailprice")[0], "vertex", "part", "p_retailprice", 950.0, 25).select("id", "p_retailprice")


@query("SELECT 'part:' || p_partkey AS id FROM part WHERE p_brand = 'Brand#1'")
def s12_index_eq(s, d):
    return _indexed(s, d, "part", "p_brand")[1].where("value = 'Brand#1'").select("id")


@query("SELECT 'part:' || p_partkey AS id, p_size AS value FROM part WHERE p_size >= 10 AND p_size < 20")
def s13_index_range(s, d):
    return _indexed(s, d, "part", "p_size")[1].where("value >= 10 AND value < 20").select("id", "value")


@query(f"SELECT {CUSTOMER} AS id, c_acctbal FROM customer WHERE c_acctbal <= 5000 ORDER BY c_acctbal DESC, 1 DESC LIMIT 20")
def s14_key_page_reverse(s, d):
    return L.key_page(_indexed(s, d, "customer", "c_acctbal")[0], "vertex", "customer", "c_acctbal", 5000.0, 20, reverse=True).select("id", "c_acctbal")


@query("SELECT 'vertex' AS type, 'part' AS label, 'p_size' AS property_key, true AS is_unique, 'CREATED' AS state UNION ALL SELECT 'vertex', 'order', 'o_orderdate', false, 'ACTIVE'")
def s16_indices(s, d):
    c = Catalog().create_index("vertex", "part", "p_size", unique=True).create_index("vertex", "order", "o_orderdate", populate=False)
    return c.tables(s)["indices"].select("type", "label", "property_key", "is_unique", "state")


@query(f"SELECT {CUSTOMER} AS id, c_acctbal AS value FROM customer WHERE c_acctbal IS NOT NULL")
def s20_vertex_values(s, d):
    from .sources.files import vertex_values

    return vertex_values(star.graph(s, d), "c_acctbal")


@query("SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, o_totalprice AS value FROM orders")
def s21_edge_values(s, d):
    from .sources.files import edge_values

    return edge_values(star.graph(s, d, None, ("placed",)), "o_totalprice")


# mutations


@query("SELECT count(*) + 2 AS n, count(DISTINCT r_name) AS names FROM region")
def w01_add_vertex(s, d):
    new = s.createDataFrame([("city:1", "city"), ("city:2", None)], "id string, label string")
    return M.add_vertices(star.graph(s, d, ("region",), ()), new).vertices.agg(F.count("*").alias("n"), F.countDistinct("r_name").alias("names"))


@query("SELECT 'partner' AS label, 'nation:' || (n_nationkey) AS dst FROM nation WHERE n_regionkey = 1")
def w02_add_edge(s, d):
    g = star.graph(s, d, ("region", "nation"), ("in_region",))
    new = g.edges.where("dst = 'region:1'").select(F.concat(F.lit("partner:"), "src").alias("id"), F.lit("partner").alias("label"), F.lit("region:0").alias("src"), F.col("src").alias("dst"))
    return M.add_edges(g, new).edges.where("label = 'partner'").select("label", "dst")


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def w03_remove_vertices(s, d):
    g = star.graph(s, d, ("customer", "order"), ("placed",))
    gone = M.remove_vertices(g, g.vertices.where("c_mktsegment = 'BUILDING'"))
    return gone.edges.agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice >= 100000")
def w04_remove_edges(s, d):
    g = star.graph(s, d, ("customer",), ("placed",))
    return M.remove_edges(g, g.edges.where("o_totalprice < 100000")).edges.agg(F.count("*").alias("n"))


@query("SELECT p_size, count(*) AS n FROM (SELECT CASE WHEN p_brand = 'Brand#1' THEN 99 ELSE p_size END AS p_size FROM part) GROUP BY 1")
def w05_set_property(s, d):
    g = star.graph(s, d, ("part",), ())
    up = g.vertices.where("p_brand = 'Brand#1'").select("id", F.lit(99).alias("value"))
    return M.set_property(g, "vertex", "p_size", up).vertices.groupBy("p_size").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(CASE WHEN p_size >= 10 THEN p_size END) AS held FROM part")
def w06_remove_property(s, d):
    g = star.graph(s, d, ("part",), ())
    return M.remove_property(g, "vertex", "p_size", g.vertices.where("p_size < 10")).vertices.agg(F.count("*").alias("n"), F.count("p_size").alias("held"))


@query(f"SELECT {CUSTOMER} AS id, CAST(n AS BIGINT) AS orders FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def w07_counter(s, d):
    c = Catalog(use_schema=True).create_label("vertex", "customer", "string", orders="counter")
    g = star.graph(s, d, ("customer",), ("placed",)).with_(catalog=c)
    deltas = g.edges.select(F.col("src").alias("id"), F.lit(1).alias("value"))
    return M.increment(g, "vertex", "orders", deltas).vertices.where("orders IS NOT NULL").select("id", "orders")


@query("SELECT 'placed:' || l_orderkey AS id, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def w07_edge_counter(s, d):
    c = Catalog(use_schema=True).create_label("edge", "placed", "string", lines="counter")
    g = star.graph(s, d, ("order",), ("placed",)).with_(catalog=c)
    deltas = star.read(s, d, "lineitem").select(F.concat(F.lit("placed:"), F.col("l_orderkey").cast("string")).alias("id"), F.lit(1).alias("value"))
    return M.increment(g, "edge", "lines", deltas).edges.where("lines IS NOT NULL").select("id", "lines")


@query("SELECT count(*) * 2 AS n FROM nation")
def w08_bulk_add(s, d):
    g = star.graph(s, d, ("nation",), ())
    return M.bulk_add(g, g.vertices).vertices.agg(F.count("*").alias("n"))


# adjacency


@query(f"SELECT {CUSTOMER} AS v, 'placed:' || o_orderkey AS edge, 'order:' || o_orderkey AS other FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'")
def j01_out_edges(s, d):
    g = star.graph(s, d, ("customer",), ("placed",))
    return A.incident(g, g.vertices.where("c_mktsegment = 'MACHINERY'"), "out", ("placed",)).select("v", "edge", "other")


@query("SELECT 'order:' || l_orderkey AS v, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def j02_edges_eq(s, d):
    g = star.graph(s, d, ("order",), ("contains",))
    return A.incident(g, g.vertices, "out", ("contains",), A.equal_to("l_returnflag", "R")).groupBy("v").agg(F.count("*").alias("n"))


@query("SELECT 'order:' || l_orderkey AS v, count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 GROUP BY 1")
def j03_edges_range(s, d):
    g = star.graph(s, d, ("order",), ("contains",))
    return A.incident(g, g.vertices, "out", ("contains",), A.within_range("l_quantity", 10, 20)).groupBy("v").agg(F.count("*").alias("n"))


@query("SELECT v, edge, o_totalprice FROM (SELECT 'customer:' || o_custkey AS v, 'placed:' || o_orderkey AS edge, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, 'order:' || o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def j04_edge_page(s, d):
    g = star.graph(s, d, ("customer",), ("placed",))
    return A.incident_page(g, g.vertices, "out", "placed", "o_totalprice", None, 3, reverse=True).select("v", "edge", "o_totalprice")


@query("SELECT v, label, count(*) AS n FROM (SELECT 'nation:' || c_nationkey AS v, 'customer' AS label FROM customer UNION ALL SELECT 'nation:' || s_nationkey, 'supplier' FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region' FROM nation) GROUP BY 1, 2")
def j05_both(s, d):
    g = star.graph(s, d, ("nation", "region", "customer", "supplier"), ("in_region", "customer_in", "supplier_in"))
    return A.neighbours(g, g.vertices.where("label = 'nation'"), "both").groupBy("v", "label").agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1")
def j06_neighbours_eq(s, d):
    g = star.graph(s, d, ("order", "part"), ("contains",))
    return A.neighbours(g, g.vertices.where("label = 'order'"), "out", ("contains",), A.equal_to("l_returnflag", "A")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 5 AND l_quantity < 8 GROUP BY 1")
def j07_neighbours_range(s, d):
    g = star.graph(s, d, ("order", "part"), ("contains",))
    return A.neighbours(g, g.vertices.where("label = 'order'"), "out", ("contains",), A.within_range("l_quantity", 5, 8)).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'order:' || o_orderkey) AS r FROM orders) WHERE r <= 2 GROUP BY 1")
def j08_neighbour_page(s, d):
    g = star.graph(s, d, ("customer", "order"), ("placed",))
    edges = A.incident_page(g, g.vertices.where("label = 'customer'"), "out", "placed", "o_orderdate", None, 2)
    return A.adjacent(g, edges).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT 'in_region:' || n_nationkey AS edge, 'nation:' || n_nationkey AS id FROM nation UNION ALL SELECT 'in_region:' || n_nationkey, 'region:' || n_regionkey FROM nation")
def j09_endpoints(s, d):
    g = star.graph(s, d, ("nation", "region"), ("in_region",))
    return A.endpoints(g, g.edges, "both").select("edge", "id")


@query("SELECT count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def j10_dangling(s, d):
    g = star.graph(s, d, ("customer", "nation"), ("customer_in",))
    g = g.with_(vertices=g.vertices.where("label = 'customer' OR n_regionkey = 2"))
    return A.neighbours(g, g.vertices.where("label = 'customer'"), "out").agg(F.count("*").alias("n"))


# neighbourhood reductions


@query("SELECT 'order:' || l_orderkey AS id, min(l_quantity) AS value FROM lineitem GROUP BY 1")
def a01_min_edge(s, d):
    return A.reduce_edges(star.graph(s, d, ("order",), ("contains",)), F.col("l_quantity"), F.min)


@query("SELECT 'nation:' || c_nationkey AS id, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE), 2) AS value FROM customer GROUP BY 1")
def a02_sum_neighbours(s, d):
    g = star.graph(s, d, ("customer", "nation"), ("customer_in",))
    r = A.reduce_neighbours(g, F.col("c_acctbal").cast("decimal(18,2)"), F.sum, "in")
    return r.select("id", F.round(F.col("value").cast("double"), 2).alias("value"))


@query("SELECT 'order:' || l_orderkey AS v, 'supplier:' || l_suppkey AS other FROM lineitem WHERE l_quantity > 48")
def a03_neighbour_pairs(s, d):
    g = star.graph(s, d, ("order", "supplier"), ("shipped_by",))
    return A.neighbour_pairs(g, F.col("l_quantity") > 48)


@query("SELECT 'part:' || l_partkey AS id, count(*) AS degree FROM lineitem GROUP BY 1")
def a04_degrees(s, d):
    return A.degrees(star.graph(s, d, ("part",), ("contains",)), "in", "contains")


# traversals


@query("SELECT DISTINCT 'supplier:' || l_suppkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3")
def g08_dedup(s, d):
    g = star.graph(s, d)
    return g.V("nation:3").in_("customer_in").out("placed").out("shipped_by").dedup().ids()


@query("SELECT count(*) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def g02_two_hops(s, d):
    return star.graph(s, d).V().hasLabel("customer").out("placed").out("contains").count().df()


@query("SELECT count(*) AS value FROM orders WHERE o_totalprice > 150000")
def g03_out_edges(s, d):
    return star.graph(s, d).V().hasLabel("customer").outE("placed").has("o_totalprice", P.gt(150000)).count().df()


@query("SELECT c_mktsegment AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 190000")
def g04_other_vertex(s, d):
    return star.graph(s, d).V().hasLabel("order").inE("placed").has("o_totalprice", P.gt(190000)).otherV().values("c_mktsegment").df()


@query("SELECT p_name AS value FROM part WHERE p_size >= 5 AND p_size < 9 AND p_brand <> 'Brand#2'")
def g05_has(s, d):
    return star.graph(s, d).V().has("part", "p_size", P.between(5, 9)).has("p_brand", P.neq("Brand#2")).values("p_name").df()


@query("SELECT n_name AS value FROM nation WHERE n_name LIKE 'N%' AND n_name NOT LIKE '%7' AND regexp_matches(n_name, '[0-3]')")
def g06_text_predicates(s, d):
    return star.graph(s, d).V().has("n_name", P.starting_with("N").and_(P.not_ending_with("7")).and_(P.regex("[0-3]"))).values("n_name").df()


@query("SELECT 'customer:' || c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 180000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def g07_where_child(s, d):
    rich = __.out("placed").has("o_totalprice", P.gt(180000))
    return star.graph(s, d).V().hasLabel("customer").where(rich).not_(__.out("placed").has("o_orderstatus", "P")).ids()


@query("SELECT o_totalprice AS value FROM orders ORDER BY o_totalprice DESC LIMIT 20")
def g10_order_limit(s, d):
    return star.graph(s, d).V().hasLabel("order").order(("o_totalprice", "desc")).limit(20).values("o_totalprice").df()


@query("SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'FURNITURE'")
def g11_project(s, d):
    return star.graph(s, d).V().has("customer", "c_mktsegment", "FURNITURE").project(c_name="c_name", c_acctbal="c_acctbal").df()


@query("SELECT c_name AS a, o_orderkey AS b FROM (SELECT 'customer:' || c_custkey AS c_name, 'order:' || o_orderkey AS o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 195000)")
def g12_select(s, d):
    return star.graph(s, d).V().hasLabel("customer").as_("a").out("placed").has("o_totalprice", P.gt(195000)).as_("b").select("a", "b").df()


@query("SELECT 'nation:' || a.n_nationkey || '>region:' || a.n_regionkey || '>nation:' || b.n_nationkey AS value FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def g13_simple_path(s, d):
    g = star.graph(s, d, ("nation", "region"), ("in_region",))
    paths = g.V().hasLabel("nation").out("in_region").in_("in_region").simplePath().path().df()
    return paths.select(F.array_join("value", ">").alias("value"))


@query("SELECT count(*) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def g14_repeat_times(s, d):
    g = star.graph(s, d, ("customer", "order", "part"), ("placed", "contains"))
    return g.V().hasLabel("customer").repeat(__.out("placed", "contains"), times=2).count().df()


@query("SELECT DISTINCT 'region:' || n_regionkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def g14_repeat_until(s, d):
    g = star.graph(s, d, ("customer", "nation", "region"), ("customer_in", "in_region"))
    return g.V().hasLabel("customer").repeat(__.out(), until=__.hasLabel("region")).dedup().ids()


@query("SELECT 'sum' AS k, round(sum(p_size), 3) AS v FROM part UNION ALL SELECT 'min', min(p_size) FROM part UNION ALL SELECT 'max', max(p_size) FROM part UNION ALL SELECT 'mean', round(avg(p_size), 3) FROM part")
def g15_aggregates(s, d):
    t = star.graph(s, d, ("part",), ()).V().values("p_size")
    one = lambda k, x: x.df().select(F.lit(k).alias("k"), F.round(F.col("value").cast("double"), 3).alias("v"))
    return one("sum", t.sum()).union(one("min", t.min())).union(one("max", t.max())).union(one("mean", t.mean()))


@query("SELECT o_orderpriority AS key, count(*) AS value FROM orders GROUP BY 1")
def g16_group_count(s, d):
    return star.graph(s, d).V().hasLabel("order").groupCount("o_orderpriority").df()


@query("SELECT p_brand AS key, max(p_retailprice) AS value FROM part GROUP BY 1")
def g16_group(s, d):
    return star.graph(s, d).V().hasLabel("part").group("p_brand", "p_retailprice", F.max).df()


@query("SELECT 'region:' || n_regionkey AS id FROM nation UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier")
def g17_union(s, d):
    g = star.graph(s, d, ("nation", "region", "supplier"), ("in_region", "supplier_in"))
    return g.V().hasLabel("nation").union(__.out("in_region"), __.in_("supplier_in")).ids()


@query("SELECT 'order:' || o_orderkey AS id FROM orders UNION ALL SELECT 'nation:' || c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def g17_coalesce(s, d):
    g = star.graph(s, d, ("customer", "order", "nation"), ("placed", "customer_in"))
    return g.V().hasLabel("customer").coalesce(__.out("placed"), __.out("customer_in")).ids()


@query("SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS key, count(*) AS value FROM part GROUP BY 1")
def g17_choose(s, d):
    g = star.graph(s, d, ("part",), ())
    return g.V().choose(F.col("p_p_size") > 25, __.constant("large"), __.constant("small")).groupCount().df()


@query("SELECT 'customer:' || o_custkey AS c, 'order:' || o_orderkey AS o, 'nation:' || c_nationkey AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 190000")
def g18_match(s, d):
    g = star.graph(s, d, ("customer", "order", "nation"), ("placed", "customer_in"))
    return g.V().hasLabel("customer").match(("c", __.out("placed").has("o_totalprice", P.gt(190000)), "o"), ("c", __.out("customer_in"), "n")).df()


@query("SELECT 'v' AS kind, count(DISTINCT o_custkey) + count(*) AS n FROM orders WHERE o_totalprice > 150000 UNION ALL SELECT 'e', count(*) FROM orders WHERE o_totalprice > 150000")
def g19_subgraph(s, d):
    g = star.graph(s, d, ("customer", "order"), ("placed",))
    sub = g.E().hasLabel("placed").has("o_totalprice", P.gt(150000)).subgraph()
    return sub.vertices.agg(F.count("*").alias("n")).select(F.lit("v").alias("kind"), "n").union(sub.edges.agg(F.count("*").alias("n")).select(F.lit("e").alias("kind"), "n"))


@query("SELECT 'part:' || l_partkey AS id, round(l_quantity * 1.0 + 10, 2) AS sack, count(*) AS n FROM lineitem GROUP BY 1, 2")
def g20_sack(s, d):
    g = star.graph(s, d, ("order", "part"), ("contains",))
    t = g.V().hasLabel("order").withSack(10.0).outE("contains").sack(lambda a, b: a + b, by="l_quantity").inV().state()
    return t.df.groupBy(F.col("__id").alias("id"), F.round("__sack", 2).alias("sack")).agg(F.count("*").alias("n"))


@query("SELECT upper(n_name) || '-' || length(n_name) || '-' || substr(n_name, 2, 2) AS value FROM nation")
def g23_strings(s, d):
    make = lambda c: S.concat(S.to_upper(c), "-", S.as_string(S.length(c)), "-", S.substring(c, 1, 3))
    return star.graph(s, d, ("nation",), ()).V().values("n_name").map(make).df()


@query("SELECT CAST(epoch(o_orderdate + INTERVAL 3 DAY) - epoch(TIMESTAMP '1995-01-01') AS BIGINT) AS value FROM orders")
def g24_dates(s, d):
    make = lambda c: S.date_diff(S.date_add(c, "day", 3), F.lit("1995-01-01").cast("timestamp"))
    return star.graph(s, d, ("order",), ()).V().values("o_orderdate").map(make).df()


@query("SELECT key, len(list_distinct(b)) AS shared FROM (SELECT p_brand AS key, list_filter(list(p_size), lambda x: x <= 5) AS b FROM part GROUP BY 1)")
def g25_lists(s, d):
    rows = star.graph(s, d, ("part",), ()).V().group("p_brand", "p_size", F.collect_set).df()
    few = F.array(*(F.lit(k) for k in range(6)))
    return rows.select("key", F.size(S.intersect(F.col("value"), few)).cast("long").alias("shared"))


# typed values


@query("SELECT p_size, p_retailprice, 'part:' || p_partkey AS id, row_number() OVER (ORDER BY p_size NULLS FIRST, p_retailprice NULLS FIRST, 'part:' || p_partkey) AS place FROM part")
def x01_sort_keys(s, d):
    """Places by the ordered keys of a whole number, a fraction and a text."""
    v = star.graph(s, d, ("part",), ()).vertices
    keys = [X.sort_key(F.col("p_size"), "int"), X.sort_key(F.col("p_retailprice"), "double"), X.sort_key(F.col("id"), "string")]
    placed = v.select("p_size", "p_retailprice", "id", *(k.alias(f"k{i}") for i, k in enumerate(keys)))
    return star.with_place(placed, ["k0", "k1", "k2"]).select("p_size", "p_retailprice", "id", F.col("__place").alias("place"))


@query("SELECT id, key, value FROM (SELECT 'nation:' || n_nationkey AS id, 'n_name' AS key, n_name AS value FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation)")
def f01_properties(s, d):
    return L.properties(star.graph(s, d, ("nation",), ()).vertices)


# analytics

TRADE = "t AS (SELECT 'nation:' || c_nationkey AS src, 'nation:' || s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {TRADE}, r AS (SELECT 'nation:' || n_nationkey AS id, 'nation:' || n_nationkey AS v FROM nation UNION SELECT dst, v FROM r JOIN t ON src = id) SELECT id, max(v) AS value FROM r GROUP BY 1")
def p02_max_value(s, d):
    return G.max_value(star.trade(s, d))


@query(f"WITH RECURSIVE {TRADE}, r AS (SELECT 'nation:0' AS id, 0 AS w UNION SELECT dst, w + n FROM r JOIN t ON src = id WHERE w + n < (SELECT 3 * max(n) FROM t)) SELECT 'nation:' || n_nationkey AS id, CAST(min(w) AS DOUBLE) AS value FROM nation LEFT JOIN r ON id = 'nation:' || n_nationkey GROUP BY 1")
def p03_shortest_paths(s, d):
    return G.shortest_paths(star.trade(s, d), "nation:0", F.col("n").cast("double"))


EVENTS = "e AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events), l AS (SELECT src, dst FROM e WHERE dst IS NOT NULL)"


@query(f"WITH RECURSIVE {EVENTS}, b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM l UNION ALL SELECT dst, src FROM l)), r AS (SELECT user_id AS id, user_id AS v FROM events UNION SELECT dst, least(v, dst) FROM r JOIN b ON src = id WHERE v = (SELECT min(user_id) FROM events)) SELECT id, min(v) AS value FROM r GROUP BY 1")
def p06_components(s, d):
    return G.connected_components(star.user_sequence(s, d))


@query(f"WITH {EVENTS}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM l WHERE src <> dst) SELECT count(*) AS n FROM u x JOIN u y ON x.b = y.a JOIN u z ON x.a = z.a AND y.b = z.b")
def p06_triangles(s, d):
    return G.triangles(star.user_sequence(s, d)).agg(F.count("*").alias("n"))


def _rank_sql(rounds: int) -> str:
    parts = [TRADE, "o AS (SELECT src, count(*) AS total FROM t GROUP BY 1)", "v AS (SELECT 'nation:' || n_nationkey AS id FROM nation)", "r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS value FROM v)"]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS (SELECT id, 0.15 / (SELECT count(*) FROM v) + 0.85 * (SELECT coalesce(sum(value), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM v) + 0.85 * coalesce(got, 0) AS value FROM v LEFT JOIN (SELECT dst, sum(value / total) AS got FROM t JOIN o USING (src) JOIN r{k} ON id = src GROUP BY 1) ON dst = id)")
    return f"WITH {', '.join(parts)} SELECT id, round(value, 8) AS value FROM r{rounds}"


@query(_rank_sql(5))
def p06_page_rank(s, d):
    return G.page_rank(star.trade(s, d), 5).select("id", F.round("value", 8).alias("value"))


@query("SELECT 'customer:' || o_custkey AS c, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def p06_motif(s, d):
    g = star.graph(s, d, ("customer",), ("placed", "shipped_by"))
    return G.motifs(g, ("c", "e", "o", "placed"), ("o", "f", "x", "shipped_by")).groupBy("c").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE l AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation), b AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT 'nation:0' AS id, 0 AS w UNION SELECT b.b, w + 1 FROM r JOIN b ON a = id WHERE w < 4) SELECT x.id, CAST(min(w) AS DOUBLE) AS value FROM (SELECT 'nation:' || n_nationkey AS id FROM nation UNION SELECT 'region:' || r_regionkey FROM region) x LEFT JOIN r ON r.id = x.id GROUP BY 1")
def p06_bfs(s, d):
    return G.bfs(star.graph(s, d, ("nation", "region"), ("in_region",)), "nation:0").withColumn("value", F.col("value").cast("double"))


# schema, jobs, and the remaining steps


def _schema() -> Catalog:
    c = Catalog(use_schema=True).create_label("vertex", "customer", "string", c_name="string", c_nationkey="int")
    c = c.create_label("vertex", "nation", "string", n_name="string").create_label("edge", "customer_in", "string")
    return c.connect("customer", "customer_in", "nation")


@query("SELECT 'vertex' AS type, 'customer' AS label, 'string' AS id_type, 2 AS n UNION ALL SELECT 'vertex', 'nation', 'string', 1 UNION ALL SELECT 'edge', 'customer_in', 'string', 0")
def s17_labels(s, d):
    return _schema().tables(s)["labels"].select("type", "label", "id_type", F.size("properties").alias("n"))


@query("SELECT 'customer' AS out_label, 'customer_in' AS edge_label, 'nation' AS in_label")
def s18_connections(s, d):
    return _schema().tables(s)["connections"]


@query("SELECT count(*) AS n FROM customer")
def l12_validated_edges(s, d):
    g = star.graph(s, d, ("customer", "nation"), ())
    edges = star.edge_table(s, d, "customer_in")
    return M.add_edges(g.with_(catalog=_schema()), edges).edges.agg(F.count("*").alias("n"))


@query("SELECT 'order:' || o_orderkey AS id, o_orderdate AS value FROM orders WHERE o_orderdate IS NOT NULL")
def l02_populate_index(s, d):
    return _indexed(s, d, "order", "o_orderdate")[1].select("id", "value")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice < 100000")
def w20_orphan_index_rows(s, d):
    g = star.graph(s, d, ("order",), ())
    index = L.index_projection(g, "vertex", "order", "o_totalprice")
    return L.orphans(index, g.vertices.where("o_totalprice >= 100000")).agg(F.count("*").alias("n"))


@query("WITH b AS (SELECT DISTINCT 'order:' || (l_orderkey // 4 * 5) AS id FROM lineitem) SELECT 'new' AS kind, count(*) AS n FROM b WHERE id NOT IN (SELECT 'order:' || o_orderkey FROM orders) UNION ALL SELECT 'there', count(*) FROM b WHERE id IN (SELECT 'order:' || o_orderkey FROM orders) UNION ALL SELECT 'all', (SELECT count(*) FROM orders) + (SELECT count(*) FROM b WHERE id NOT IN (SELECT 'order:' || o_orderkey FROM orders))")
def w12_repeated_keys(s, d):
    """Create where absent, from a batch in which every id comes several times."""
    g = star.graph(s, d, ("order",), ())
    batch = star.read(s, d, "lineitem").select(F.concat(F.lit("order:"), F.expr("l_orderkey div 4 * 5").cast("string")).alias("id"), F.lit("order").alias("label"), F.lit("new").alias("o_orderstatus"))
    done, there = M.create_absent(g, batch)
    n = lambda k, df: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n("new", done.vertices.where("o_orderstatus = 'new'")).union(n("there", there)).union(n("all", done.vertices))


@query(f"WITH {TRADE} SELECT 'nation:' || n_nationkey AS id, n_name, coalesce(degree, 0) AS degree FROM nation LEFT JOIN (SELECT src, count(*) AS degree FROM t GROUP BY 1) ON src = 'nation:' || n_nationkey")
def p04_write_back(s, d):
    g = star.trade(s, d)
    found = A.degrees(g, "out").withColumnRenamed("degree", "value")
    done = G.write_back(g, found, "degree")
    return done.vertices.select("id", "n_name", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


@query("SELECT 'peer:nation:' || a.n_nationkey || ':nation:' || b.n_nationkey || ':1' AS id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def p04_derive_edges(s, d):
    g = star.graph(s, d, ("nation", "region"), ("in_region",))
    pairs = G.motifs(g, ("src", "e", "r", "in_region"), ("dst", "f", "r", "in_region"))
    key = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(2)).cast("int")
    return G.derive_edges(g, "peer", pairs.where(key("src") < key("dst")).select("src", "dst")).edges.where("label = 'peer'").select("id")


@query("SELECT key, count(*) AS n FROM (SELECT 'p_size' AS key FROM part WHERE p_size IS NOT NULL UNION ALL SELECT 'p_brand' FROM part WHERE p_brand IS NOT NULL) GROUP BY 1")
def f02_keys(s, d):
    return star.graph(s, d, ("part",), ()).V().properties("p_size", "p_brand").key().groupCount().df().select("key", F.col("value").alias("n"))


@query("SELECT o_totalprice AS value FROM orders ORDER BY o_totalprice, 'order:' || o_orderkey LIMIT 10 OFFSET 5")
def g09_range(s, d):
    return star.graph(s, d, ("order",), ()).V().order("o_totalprice").range(5, 15).values("o_totalprice").df()


@query("SELECT v AS id, o_totalprice FROM (SELECT 'placed:' || o_orderkey AS v, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, 'placed:' || o_orderkey) AS r FROM orders) WHERE r <= 2")
def g17_local(s, d):
    g = star.graph(s, d, ("customer",), ("placed",))
    return g.V().local(__.outE("placed").order(("o_totalprice", "desc")).limit(2)).df().select("id", "o_totalprice")


@query("SELECT n AS key, count(*) AS value FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY 1")
def g16_group_by_child(s, d):
    return star.graph(s, d, ("customer",), ("placed",)).V().groupCount(__.out("placed").count()).df()


@query("SELECT count(*) AS value FROM nation")
def g13_cyclic_path(s, d):
    g = star.graph(s, d, ("nation", "region"), ("in_region",))
    return g.V().hasLabel("nation").out("in_region").in_("in_region").cyclicPath().count().df()


@query("SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM (SELECT CASE WHEN p_partkey < 10 THEN 0 ELSE p_size END AS p_size FROM part UNION ALL SELECT 7)")
def g21_merge(s, d):
    g = star.graph(s, d, ("part",), ())
    batch = g.vertices.where("p_partkey < 10").select("id", "label", F.lit(0).alias("p_size")).unionByName(s.createDataFrame([("part:new", "part", 7)], "id string, label string, p_size int"))
    return M.merge_vertices(g, batch, ["id", "label"]).vertices.agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY 1")
def t01_windowed_counts(s, d):
    from .streaming.changes import windowed_counts

    rows = windowed_counts(star.read(s, d, "events"), "1 day", "1 hour")
    return rows.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("days"))


# repeated keys in a batch, and steps inside children


@query("SELECT 'order:' || o_orderkey AS id, coalesce((SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey), o_orderdate) AS o_orderdate FROM orders")
def w10_bulk_set_last_wins(s, d):
    g = star.graph(s, d, ("order",), ())
    updates = star.read(s, d, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_shipdate").alias("value"), F.col("l_shipdate").alias("at"))
    return M.set_property(g, "vertex", "o_orderdate", updates, order="at").vertices.select("id", "o_orderdate")


@query("SELECT o_orderkey % 7 AS grade, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM customer")
def w10_bulk_set_edges(s, d):
    g = star.graph(s, d, ("customer",), ("placed", "customer_in"))
    updates = g.edges.where("label = 'placed'").select("id", (F.split_part("id", F.lit(":"), F.lit(2)).cast("long") % 7).alias("value"))
    return M.set_property(g, "edge", "grade", updates.unionAll(updates)).edges.groupBy("grade").agg(F.count("*").alias("n"))


@query("SELECT 'nation:' || n_nationkey AS id, max(c_acctbal) AS best FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def g21_merge_repeated(s, d):
    g = star.graph(s, d, ("nation",), ())
    batch = star.read(s, d, "customer").select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("id"), F.lit("nation").alias("label"), F.col("c_acctbal").alias("best"), F.col("c_acctbal").alias("at"))
    return M.merge_vertices(g, batch, ["id", "label"], order="at").vertices.select("id", "best")


@query("SELECT 'customer:' || o_custkey AS src, 'order:' || (o_orderkey // 2 * 2) AS dst, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey // 2 * 2 AS o_orderkey FROM orders UNION SELECT o_custkey, o_orderkey FROM orders) GROUP BY 1, 2")
def g21_merge_edges_repeated(s, d):
    g = star.graph(s, d, ("customer", "order"), ("placed",))
    even = F.concat(F.lit("order:"), F.expr("CAST(split_part(dst, ':', 2) AS BIGINT) div 2 * 2").cast("string"))
    batch = g.edges.select("label", "src", even.alias("dst"))
    named = M.merge_edges(g, batch.unionAll(batch)).edges.select("src", even.alias("dst"))
    return named.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT v AS id, o_totalprice FROM (SELECT 'placed:' || o_orderkey AS v, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, 'placed:' || o_orderkey DESC) AS r FROM orders) WHERE r <= 2")
def g09_tail_in_child(s, d):
    g = star.graph(s, d, ("customer",), ("placed",))
    return g.V().local(__.outE("placed").order("o_totalprice").tail(2)).df().select("id", "o_totalprice")


@query("SELECT least(3, n) AS key, count(*) AS value FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1")
def g09_sample_in_child(s, d):
    g = star.graph(s, d, ("customer",), ("placed",))
    t = g.V().as_("c").local(__.outE("placed").sample(3)).select("c").df().groupBy("id").count()
    return t.groupBy(F.col("count").alias("key")).agg(F.count("*").alias("value"))


@query("SELECT CAST(greatest(0, n - 2) AS BIGINT) AS key, count(*) AS value FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) WHERE n > 2 GROUP BY 1")
def g09_skip_in_child(s, d):
    g = star.graph(s, d, ("customer",), ("placed",))
    t = g.V().as_("c").local(__.outE("placed").skip(2)).select("c").df().groupBy("id").count()
    return t.groupBy(F.col("count").alias("key")).agg(F.count("*").alias("value"))


@query("SELECT c_name || '>' || CAST(o_totalprice AS VARCHAR) || '>' || o_orderstatus AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 150000 AND o_totalprice = floor(o_totalprice)")
def g13_path_by(s, d):
    g = star.graph(s, d, ("customer", "order"), ("placed",))
    paths = g.V().hasLabel("customer").outE("placed").has("o_totalprice", P.gt(150000)).filter(F.col("p_o_totalprice") == F.floor("p_o_totalprice")).inV().path("c_name", "o_totalprice", "o_orderstatus").df()
    return paths.select(F.array_join("value", ">", "?").alias("value"))


@query("SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def g16_group_in_child(s, d):
    g = star.graph(s, d, ("customer", "order"), ("placed",))
    t = g.V().hasLabel("customer").as_("c").local(__.out("placed").groupCount("o_orderpriority")).state()
    rows = t.df.select(F.col("`@c`").alias("id"), F.explode("__value").alias("priority", "n"))
    return rows.join(g.vertices.select("id", F.col("c_mktsegment").alias("segment")), "id").groupBy("segment", "priority").agg(F.sum("n").alias("n"))


def _sizes_where(test: str) -> str:
    return f"SELECT p_size AS key, count(*) AS value FROM part WHERE {test} GROUP BY 1"


def _sizes(s, d, test: P.P) -> DataFrame:
    return star.graph(s, d, ("part",), ()).V().has("p_size", test).groupCount("p_size").df()


@query(_sizes_where("p_size < 10"))
def g06_lt(s, d):
    return _sizes(s, d, P.lt(10))


@query(_sizes_where("p_size <= 10"))
def g06_lte(s, d):
    return _sizes(s, d, P.lte(10))


@query(_sizes_where("p_size >= 10"))
def g06_gte(s, d):
    return _sizes(s, d, P.gte(10))


@query(_sizes_where("p_size > 10 AND p_size < 20"))
def g06_inside(s, d):
    return _sizes(s, d, P.inside(10, 20))


@query(_sizes_where("p_size < 10 OR p_size > 20"))
def g06_outside(s, d):
    return _sizes(s, d, P.outside(10, 20))


@query(_sizes_where("p_size IN (3, 9, 27)"))
def g06_within(s, d):
    return _sizes(s, d, P.within(3, 9, 27))


@query(_sizes_where("p_size NOT IN (3, 9, 27)"))
def g06_without(s, d):
    return _sizes(s, d, P.without(3, 9, 27))


@query("SELECT 'nation:' || n_nationkey AS id FROM nation UNION ALL SELECT 'region:0' FROM region WHERE r_regionkey = 0")
def g05_ids_keys(s, d):
    g = star.graph(s, d, ("nation", "region"), ())
    return g.V().union(__.hasNot("r_name"), __.hasId("region:0")).ids()


@query("SELECT 'nation:' || n_nationkey AS id FROM nation WHERE n_regionkey = 1 OR n_nationkey < 3 UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey >= 3")
def g07_and_or(s, d):
    one, low = __.has("n_regionkey", 1), __.has("n_nationkey", P.lt(3))
    return star.graph(s, d, ("nation",), ()).V().union(__.or_(one, low), __.and_(one, __.not_(low))).ids()


@query("SELECT p_size AS value FROM part WHERE p_size > 45")
def g07_is(s, d):
    return star.graph(s, d, ("part",), ()).V().values("p_size").is_(P.gt(45)).df()


@query("SELECT 'nation:' || n_nationkey AS id, n_name AS name FROM nation")
def g11_value_map(s, d):
    t = star.graph(s, d, ("nation",), ()).V().valueMap("n_name", "n_nationkey").df()
    return t.select(F.concat(F.lit("nation:"), F.element_at(F.col("value")["n_nationkey"], 1)).alias("id"), F.col("value")["n_name"][0].alias("name"))


@query("SELECT 'placed:' || o_orderkey AS id, 'placed' AS label, 'customer:' || o_custkey AS src FROM orders")
def g11_element_map(s, d):
    t = star.graph(s, d, ("customer",), ("placed",)).E().elementMap().df()
    return t.select(F.col("value")["id"].alias("id"), F.col("value")["label"].alias("label"), F.col("value")["src"].alias("src"))


@query("SELECT p_size AS value FROM part")
def g15_fold_unfold(s, d):
    return star.graph(s, d, ("part",), ()).V().values("p_size").fold().unfold().df()


@query("SELECT bit_xor(p_partkey) AS value FROM part")
def g15_reduce(s, d):
    return star.graph(s, d, ("part",), ()).V().values("p_partkey").reduce(F.bit_xor).df()


@query("SELECT 'order:' || o_orderkey AS id FROM orders UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def g17_optional(s, d):
    return star.graph(s, d, ("customer", "order"), ("placed",)).V().hasLabel("customer").optional(__.out("placed")).ids()


@query("SELECT 'region:' || n_regionkey AS id FROM nation UNION ALL SELECT 'nation:' || s_nationkey FROM supplier")
def g17_branch(s, d):
    g = star.graph(s, d, ("nation", "region", "supplier"), ("in_region", "supplier_in"))
    return g.V().branch("label", {"nation": __.out("in_region"), "supplier": __.out("supplier_in")}).ids()


@query("SELECT 'nation:' || c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'region:' || n_regionkey, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def g14_emit(s, d):
    g = star.graph(s, d, ("customer", "nation", "region"), ("customer_in", "in_region"))
    return g.V().hasLabel("customer").repeat(__.out(), times=2, emit=True).ids().groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT count(*) * 2 AS n, CAST(sum(o_totalprice) AS DOUBLE) AS total FROM (SELECT CAST(o_totalprice AS DECIMAL(18, 2)) AS o_totalprice FROM orders)")
def g19_aggregate(s, d):
    t = star.graph(s, d, ("order",), ()).V().aggregate("prices", "o_totalprice").side_effect(__.aggregate("seen"))
    prices, seen = t.cap("prices"), t.cap("seen")
    n = prices.select("value").unionAll(seen.select(F.lit(None).cast("double").alias("value")))
    return n.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT 'part:' || p_partkey AS id, coalesce(n, 0) AS degree FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def g22_call(s, d):
    g = star.graph(s, d, ("part", "order"), ("contains",))
    t = g.V().hasLabel("part").as_("p").call("degree", direction="in").state()
    return t.df.select(F.col("`@p`").alias("id"), F.col("__value").alias("degree"))


_VOTES = "SELECT v, value, n, rank() OVER (PARTITION BY v ORDER BY n DESC) AS r FROM (SELECT dst AS v, value, count(*) AS n FROM l JOIN {k} ON src = id GROUP BY 1, 2)"
_ROUND = "SELECT ids.id, coalesce(m.value, old.value) AS value FROM ids JOIN {k} old ON ids.id = old.id LEFT JOIN (SELECT v, min(value) AS value FROM (" + _VOTES + ") WHERE r = 1 GROUP BY 1) m ON m.v = ids.id"


@query(
    "WITH e AS (SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders), l AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),"
    "ids AS (SELECT 'customer:' || c_custkey AS id FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'order:' || o_orderkey FROM orders),"
    f"s0 AS (SELECT id, id AS value FROM ids), s1 AS ({_ROUND.format(k='s0')}), s2 AS ({_ROUND.format(k='s1')}) SELECT id, value FROM s2"
)
def p06_label_propagation(s, d):
    return G.label_propagation(star.graph(s, d, ("customer", "nation", "order"), ("customer_in", "placed")), rounds=2)


@query("SELECT 'customer:' || c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 1 ELSE 3 END AS hops FROM customer WHERE c_nationkey = 3 OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3))")
def p06_bfs_customers(s, d):
    g = star.graph(s, d, ("customer", "nation", "region", "order"), ("customer_in", "in_region", "placed"))
    found = G.bfs(g, "nation:3").where("id LIKE 'customer:%'")
    near = F.when(F.col("value") == 1, 1).otherwise(F.col("value"))
    return found.where("value <= 3").select("id", near.cast("int").alias("hops"))


@query("SELECT 'next_user:' || event_id AS id, user_id AS src, nxt AS dst FROM (SELECT event_id, user_id, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def p06_event_sequence(s, d):
    return star.user_sequence(s, d).edges.select("id", "src", "dst")


# metadata and files


@query("SELECT * FROM (VALUES ('CREATED', 'BUILDING', true), ('CREATED', 'ACTIVE', true), ('BUILDING', 'CREATED', false), ('ACTIVE', 'CREATED', false), ('ACTIVE', 'INACTIVE', true), ('INACTIVE', 'BUILDING', false), ('INACTIVE', 'ACTIVE', false), ('INACTIVE', 'DROPPED', true), ('DROPPED', 'CREATED', true), ('DROPPED', 'ACTIVE', false)) t(state, next, allowed)")
def l05_transitions(s, d):
    """Which state an index may go to, tried on a catalog."""
    ways = {"CREATED": [], "BUILDING": ["BUILDING"], "ACTIVE": ["BUILDING", "ACTIVE"], "INACTIVE": ["INACTIVE"], "DROPPED": ["INACTIVE", "DROPPED"]}
    tried = [("CREATED", "BUILDING"), ("CREATED", "ACTIVE"), ("BUILDING", "CREATED"), ("ACTIVE", "CREATED"), ("ACTIVE", "INACTIVE"), ("INACTIVE", "BUILDING"), ("INACTIVE", "ACTIVE"), ("INACTIVE", "DROPPED"), ("DROPPED", "CREATED"), ("DROPPED", "ACTIVE")]

    def allowed(state: str, after: str) -> bool:
        c = Catalog().create_index("vertex", "part", "p_size")
        for x in ways[state]:
            c = c.set_state("vertex", "part", "p_size", x)
        try:
            return c.set_state("vertex", "part", "p_size", after).indices["vertex", "part", "p_size"].state == after
        except NotValid:
            return False

    return s.createDataFrame([(a, b, allowed(a, b)) for a, b in tried], "state string, next string, allowed boolean")


@query("SELECT * FROM (VALUES ('undeclared label', true), ('wrong type', true), ('unconnected labels', true), ('repeated id', true), ('repeated unique value', true), ('undeclared counter', true), ('fitting', false)) t(batch, rejected)")
def l12_rejected_batches(s, d):
    """Batches over the nations that a schema, ids and a unique index refuse."""
    c = Catalog(use_schema=True).create_label("vertex", "nation", "string", n_name="string", n_nationkey="int", n_regionkey="int").create_label("edge", "near", "string")
    nations = star.vertex_table(s, d, "nation").select("id", "label", "n_name", "n_nationkey", "n_regionkey")
    g = Graph(nations, s.createDataFrame([], "id string, label string, src string, dst string"), catalog=c)
    new = nations.select(F.concat(F.lit("new:"), "id").alias("id"), "label", "n_name", "n_nationkey", "n_regionkey")
    unique = g.with_(catalog=c.create_index("vertex", "nation", "n_name", unique=True))
    tries = {
        "undeclared label": lambda: M.add_vertices(g, new.withColumn("label", F.lit("town"))),
        "wrong type": lambda: M.add_vertices(g, new.withColumn("n_name", F.lit(1.5))),
        "unconnected labels": lambda: M.add_edges(g, nations.select(F.lit("e").alias("id"), F.lit("near").alias("label"), F.col("id").alias("src"), F.col("id").alias("dst")).limit(1)),
        "repeated id": lambda: M.add_vertices(g, nations),
        "repeated unique value": lambda: M.add_vertices(unique, new),
        "undeclared counter": lambda: M.increment(g, "vertex", "n_name", nations.select("id", F.lit(1).alias("value"))),
        "fitting": lambda: M.add_vertices(g, new),
    }

    def rejected(act) -> bool:
        try:
            act()
        except (NotUnique, NotValid):
            return True
        return False

    return s.createDataFrame([(k, rejected(f)) for k, f in tries.items()], "batch string, rejected boolean")


@query("SELECT 'placed:' || o_orderkey AS id, o_totalprice AS value FROM orders ORDER BY o_totalprice DESC, 'placed:' || o_orderkey DESC LIMIT 25")
def s14_edge_page_reverse(s, d):
    """A page in reverse order over the sorted projection of an edge index."""
    g = star.graph(s, d, ("order",), ("placed",))
    g = g.with_(catalog=Catalog().create_index("edge", "placed", "o_totalprice"))
    index = L.build_index(g, "edge", "placed", "o_totalprice")[1]
    return L.page(index, ["value", "id"], None, 25, True).select("id", "value")


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-01' - INTERVAL 100 DAY")
def f03_time_to_live(s, d):
    g = star.graph(s, d, ("order",), ())
    g = g.with_(vertices=g.vertices.withColumn("updated_at", F.col("o_orderdate").cast("timestamp")))
    return g.alive(100 * 86400, F.lit("1996-06-01").cast("timestamp")).vertices.agg(F.count("*").alias("n"))


@query("SELECT 'part:' || p_partkey AS id, p_name, p_size FROM part")
def x08_map_layout(s, d):
    """Properties as a map of texts, and back to declared types."""
    v = star.graph(s, d, ("part",), ()).vertices.select("id", "label", "p_name", "p_size")
    return to_wide_layout(to_map_layout(v), {"p_name": "string", "p_size": "int"}).select("id", "p_name", "p_size")


@query("SELECT lower(reverse(n_name)) AS a, trim('  ' || n_name || ' ') || '|' || ltrim('  ' || n_name || ' ') || '|' || rtrim('  ' || n_name || ' ') AS b, replace(n_name, 'N', 'no') AS c, array_to_string(string_split(n_name, '_'), '+') AS d, n_name || ' is ' || n_nationkey AS e FROM nation")
def g23_more_strings(s, d):
    v = star.graph(s, d, ("nation",), ()).vertices
    n = F.col("n_name")
    wide = F.concat(F.lit("  "), n, F.lit(" "))
    return v.select(
        S.to_lower(S.reverse(n)).alias("a"), S.concat(S.trim(wide), "|", S.l_trim(wide), "|", S.r_trim(wide)).alias("b"), S.replace(n, "N", "no").alias("c"),
        S.conjoin(S.split(n, "_"), "+").alias("d"), S.format_string("%{name} is %{key}", {"name": n, "key": F.col("n_nationkey")}).alias("e"),
    )


@query(
    "WITH b AS (SELECT p_brand AS key, list_sort(list_distinct(list(p_size))) AS l FROM part GROUP BY 1), f AS (SELECT key, l, [1, 2, 3, 90] AS o FROM b)"
    "SELECT key, len(list_filter(l, lambda x: NOT list_contains(o, x))) AS n_difference, len(list_filter(l, lambda x: NOT list_contains(o, x))) + len(list_filter(o, lambda x: NOT list_contains(l, x))) AS n_disjunct,"
    "len(list_distinct(list_concat(l, o))) AS n_merge, len(l) + 4 AS n_combine, 4 * len(l) AS n_product, array_to_string(l, ',') AS joined, list_min(l) > 0 AS over, list_max(l) > 45 AS large, NOT list_contains(l, 7) AS free FROM f"
)
def g25_more_lists(s, d):
    rows = star.graph(s, d, ("part",), ()).V().group("p_brand", "p_size", F.collect_set).df()
    c, o = F.sort_array("value"), F.array(*map(F.lit, (1, 2, 3, 90)))
    size = lambda x: F.size(x).cast("long")
    return rows.select(
        "key", size(S.difference(c, o)).alias("n_difference"), size(S.disjunct(c, o)).alias("n_disjunct"), size(S.merge(c, o)).alias("n_merge"), size(S.combine(c, o)).alias("n_combine"), size(S.product(c, o)).alias("n_product"),
        S.conjoin(c, ",").alias("joined"), S.all_(c, lambda x: x > 0).alias("over"), S.any_(c, lambda x: x > 45).alias("large"), S.none_(c, lambda x: x == 7).alias("free"),
    )
