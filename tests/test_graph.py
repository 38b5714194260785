"""Lookups, adjacency, schema, mutations and files on small graphs."""

import pytest
from pyspark.sql import functions as F

from lattica import errors
from lattica.functions import values as X
from lattica.model import E_META, Graph, to_map_layout, to_wide_layout
from lattica.operators import adjacency as A
from lattica.operators import lookup as L
from lattica.operators import mutate as M
from lattica.operators.catalog import ACTIVE, BUILDING, CREATED, DROPPED, INACTIVE, Catalog
from lattica.sources import files, toys


def vertices(spark, rows, keys="key1 int"):
    return spark.createDataFrame(rows, f"id string, label string, {keys}")


def graph(spark, vs, es=(), edge_keys="key1 int"):
    return Graph(vertices(spark, vs), spark.createDataFrame(list(es), f"id string, label string, src string, dst string, {edge_keys}"))


@pytest.fixture(scope="module")
def star(spark):
    vs = [(f"v{i}", "a", None) for i in range(8)]
    es = [(f"e{k}", "b", "v0", f"v{min(k, 7)}", 9 + k) for k in range(1, 8)]
    return graph(spark, vs, es)


def test_label_and_equality(spark):
    g = graph(spark, [("0", "a", 1), ("1", "a", 2), ("2", "a", None), ("3", "a", 1), ("4", "b", 1)])
    assert L.by_label(g, "vertex", "a").count() == 4
    assert L.by_value(g, "vertex", "a", "key1", 1).count() == 2
    assert L.by_value(g, "vertex", "a", "key1", None).count() == 0
    assert g.V().has("a", "key1", 1).count().to_list() == [2]


def test_ranges_and_pages(spark):
    g = graph(spark, [(str(i), "a", i) for i in range(-3, 8)])
    assert L.in_range(g, "vertex", "a", "key1", -2, 2).count() == 4
    with pytest.raises(errors.NotValid):
        L.key_page(g, "vertex", "a", "key1", None, 3)
    g, index = L.build_index(g.with_(catalog=Catalog().create_index("vertex", "a", "key1", True)), "vertex", "a", "key1")
    assert index.count() == 11
    page = lambda *a: [r.key1 for r in L.key_page(g, "vertex", "a", "key1", *a).collect()]
    assert page(None, 3) == [-3, -2, -1] and page(2, 3) == [2, 3, 4]
    assert page(2, 3, True) == [2, 1, 0] and len(page(None, 20, True)) == 11


def test_multi_get_keeps_duplicates_and_drops_missing(spark):
    g = graph(spark, [("0", "a", 1), ("1", "a", 2)])
    assert sorted(r.id for r in L.by_ids(g, "vertex", ["0", "0", "9"]).collect()) == ["0", "0"]
    with pytest.raises(errors.GraphError):
        L.by_ids(g, "vertex", [None])
    with pytest.raises(errors.NotFound):
        L.one(g, "vertex", "9")


def test_edges_of_a_vertex(star):
    start = star.vertices.where("id = 'v0'")
    assert A.incident(star, start, "out", ("b",), A.within_range("key1", 11, 15)).count() == 4
    assert A.incident(star, start, "out", ("b",), A.equal_to("key1", None)).count() == 0
    page = lambda low, n, rev=False: sorted(r.key1 for r in A.incident_page(star, start, "out", "b", "key1", low, n, rev).collect())
    assert page(None, 4) == [10, 11, 12, 13] and page(12, 4) == [12, 13, 14, 15] and page(12, 4, True) == [10, 11, 12]
    less = M.remove_edges(star, star.edges.where("key1 = 11"))
    assert A.incident(less, start, "out", ("b",), A.within_range("key1", 11, 15)).count() == 3


def test_directions_self_loops_and_dangling(spark):
    g = graph(spark, [(x, "v", None) for x in "abc"], [("1", "friend", "a", "b", None), ("2", "friend", "a", "c", None), ("3", "hate", "a", "c", None), ("4", "hate", "c", "a", None), ("5", "hate", "c", "b", None), ("6", "self", "b", "b", None), ("7", "friend", "b", "gone", None)])
    at = lambda v, d, *ls: A.incident(g, g.vertices.where(F.col("id") == v), d, ls).count()
    assert at("a", "out", "friend", "hate") == 3 and at("a", "in") == 1 and at("b", "in", "friend", "hate") == 2
    assert at("b", "in", "none") == 0 and at("b", "both", "self") == 2
    start = g.vertices.where("id = 'b'")
    assert A.neighbours(g, start, "out", ("friend",)).count() == 0
    assert A.neighbours(g.with_(keep_dangling=True), start, "out", ("friend",)).count() == 1
    assert [r.id for r in A.dangling(g).collect()] == ["7"]
    assert g.with_(intact=False).V("b").out().count().to_list() == [1] and g.with_(intact=False, keep_dangling=True).V("b").out().count().to_list() == [2]
    more = M.add_edges(g, spark.createDataFrame([("8", "friend", "a", "lost")], "id string, label string, src string, dst string"))
    assert not more.intact and more.V("a").out("friend").count().to_list() == [2]
    assert A.endpoints(g, g.edges.where("id = '1'"), "both").count() == 2


def test_index_states():
    c = Catalog().create_index("vertex", "a", "k")
    with pytest.raises(errors.NotUnique):
        c.create_index("vertex", "a", "k")
    assert c.index("vertex", "a", "k") is None and c.index("vertex", "a", "k", "write")
    c = c.set_state("vertex", "a", "k", BUILDING).set_state("vertex", "a", "k", ACTIVE)
    with pytest.raises(errors.NotValid):
        c.set_state("vertex", "a", "k", CREATED)
    c = c.set_state("vertex", "a", "k", INACTIVE).set_state("vertex", "a", "k", DROPPED)
    assert c.create_index("vertex", "a", "k", populate=False).index("vertex", "a", "k").state == ACTIVE
    assert not c.delete_index("vertex", "a", "k").indices


def test_unique_index_on_add_and_update(spark):
    g = graph(spark, [("0", "a", 11), ("1", "a", 12)]).with_(catalog=Catalog().create_index("vertex", "a", "key1", True))
    with pytest.raises(errors.NotUnique):
        M.add_vertices(g, vertices(spark, [("2", "a", 11)]))
    with pytest.raises(errors.NotUnique):
        M.set_property(g, "vertex", "key1", spark.createDataFrame([("1", 11)], "id string, value int"))
    assert M.add_vertices(g, vertices(spark, [("2", "a", 13)])).vertices.count() == 3


def test_ids_are_unique_and_default(spark):
    g = graph(spark, [("0", "a", 1)])
    with pytest.raises(errors.NotUnique):
        M.add_vertices(g, vertices(spark, [("0", "b", 1)]))
    new = M.add_vertices(g, spark.createDataFrame([(5,)], "key1 int")).vertices.where("key1 = 5").first()
    assert new.label == "vertex" and len(new.id) == 36


def test_schema(spark):
    c = Catalog(use_schema=True).create_label("vertex", "a", "string", key1="int").create_label("vertex", "b", "string", key1="int").create_label("edge", "knows", "string", since="date")
    g = Graph(vertices(spark, [("1", "a", 1), ("2", "b", 1)]), spark.createDataFrame([], "id string, label string, src string, dst string, since date"), c)
    add = lambda rows, keys="key1 int": M.add_vertices(g, vertices(spark, rows, keys))
    for rows, keys in (([("9", "zzz", 1)], "key1 int"), ([("9", "a", 1)], "other int"), ([("9", "a", 1)], "key1 long")):
        with pytest.raises(errors.NotValid):
            add(rows, keys)
    assert add([("9", "a", 2)]).vertices.count() == 3
    edge = spark.createDataFrame([("e", "knows", "1", "2")], "id string, label string, src string, dst string")
    with pytest.raises(errors.NotValid):
        M.add_edges(g, edge)
    g2 = g.with_(catalog=c.connect("a", "knows", "b"))
    assert M.add_edges(g2, edge).edges.count() == 1
    with pytest.raises(errors.NotUnique):
        c.update_label("vertex", "a", key1="long")
    assert "key3" in c.update_label("vertex", "a", key3="string").label("vertex", "a").properties
    with pytest.raises(errors.NoSchema):
        Catalog().create_label("vertex", "a")
    assert c.tables(spark)["labels"].count() == 3


def test_counters(spark):
    g = graph(spark, [("0", "a", 1)]).with_(catalog=Catalog(use_schema=True).create_label("vertex", "a", "string", hits="counter"))
    deltas = spark.createDataFrame([("0", 11), ("0", 1), ("0", -2)], "id string, value int")
    assert M.increment(g, "vertex", "hits", deltas).vertices.first().hits == 10
    with pytest.raises(errors.NoSchema):
        M.increment(graph(spark, [("0", "a", 1)]), "vertex", "hits", deltas)


def test_remove_and_properties(spark, star):
    gone = M.remove_vertices(star, star.vertices.where("id = 'v7'"))
    assert gone.edges.count() == 6 and gone.vertices.count() == 7
    up = M.set_property(star, "vertex", "key1", spark.createDataFrame([("v1", 11)], "id string, value int"))
    assert L.by_value(up, "vertex", "a", "key1", 11).count() == 1
    assert L.by_value(M.remove_property(up, "vertex", "key1", up.vertices.where("id = 'v1'")), "vertex", "a", "key1", 11).count() == 0
    assert L.properties(up.vertices, "key1").count() == 1 and M.clear(star).vertices.count() == 0


def test_merge(spark):
    g = graph(spark, [("0", "a", 1)])
    out = M.merge_vertices(g, vertices(spark, [("9", "b", 1), ("2", "c", 7)]), ["key1"]).vertices.collect()
    assert sorted((r.id, r.label, r.key1) for r in out) == [("0", "b", 1), ("2", "c", 7)]
    e = spark.createDataFrame([("e", "l", "0", "0", 5), ("f", "m", "0", "0", 6)], "id string, label string, src string, dst string, key1 int")
    g = M.add_edges(g, e.where("id = 'e'"), check=False)
    out = M.merge_edges(g, e.withColumn("key1", F.col("key1") + 1)).edges.collect()
    assert sorted((r.id, r.key1) for r in out) == [("e", 6), ("f", 7)]


def test_mixed_types_order_by_tag(spark):
    df = spark.createDataFrame([(1, "x")], "i int, s string")
    key = lambda c, t: X.sort_key(F.col(c), t)
    assert df.select(key("s", "string") < key("i", "int")).first()[0]
    assert df.select(key("i", "int") < X.sort_key(F.lit(0).cast("bigint"), "bigint")).first()[0]
    assert not df.select(X.same(F.col("i"), "int", F.lit(1).cast("bigint"), "bigint")).first()[0]
    assert X.normal_id(90.7) == 90 and X.properties_of("a", 1, "b", None) == {"a": 1} and X.tag_of(True) == "boolean"


def test_layouts_and_files(spark, tmp_path):
    g = toys.modern(spark)
    wide = to_wide_layout(to_map_layout(g.vertices), {"name": "string", "age": "int", "lang": "string"})
    assert sorted(map(str, wide.collect())) == sorted(map(str, g.vertices.collect()))
    files.save(g, str(tmp_path / "g"), bucket_vertices=2)
    back = files.load(spark, str(tmp_path / "g"))
    assert sorted(back.V(1).out("knows").values("name").to_list()) == ["josh", "vadas"]
    files.write_json(g, str(tmp_path / "j"))
    again = files.read_json(spark, str(tmp_path / "j"), "name string, age int, lang string, weight double")
    assert again.vertices.count() == 6 and again.edges.where("weight = 1.0").count() == 2
    files.write_text(g.vertices.select("id", F.col("name").alias("value")), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t").count() == 6
    files.save_tables(g, "toy", 2)
    assert files.load_tables(spark, "toy").edges.count() == 6
    files.drop_tables(spark, "toy")
    assert files.vertex_values(g, "age").count() == 4 and "marko" in files.dump(g)


def test_empty_graph(spark):
    g = graph(spark, [])
    assert g.V().out().count().to_list() == [0] and g.V().values("key1").sum().to_list() == []
    assert A.degrees(g).count() == 0 and g.edges.columns[:4] == list(E_META)


# repeated keys in a batch


def test_repeated_ids_in_updates(spark):
    g = graph(spark, [("0", "a", 1), ("1", "a", 2)], [("e", "b", "0", "1", 5)])
    twice = spark.createDataFrame([("0", 7, 1), ("0", 8, 3), ("0", 9, 2), ("9", 1, 1)], "id string, value int, at int")
    for kind, ids in (("vertex", {"0": 8, "1": 2}), ("edge", {"e": 5})):
        out = M.set_property(g, kind, "key1", twice, order="at")
        table = out.vertices if kind == "vertex" else out.edges
        assert {r.id: r.key1 for r in table.collect()} == ids and table.count() == len(ids)
    same = spark.createDataFrame([("0", 7), ("0", 7)], "id string, value int")
    assert sorted(r.key1 for r in M.set_property(g, "vertex", "key1", same).vertices.collect()) == [2, 7]
    with pytest.raises(Exception, match="no order"):
        M.set_property(g, "vertex", "key1", twice.select("id", "value")).vertices.collect()


def test_repeated_keys_in_merges(spark):
    g = graph(spark, [("0", "a", 1), ("1", "a", 2)], [("e", "b", "0", "1", 5)])
    batch = spark.createDataFrame([("a", "0", 3, 1), ("a", "0", 4, 2), ("a", "n", 5, 1), ("a", "n", 6, 2)], "label string, id string, key1 int, at int")
    out = M.merge_vertices(g, batch, ["id"], order="at").vertices.collect()
    assert sorted((r.id, r.key1) for r in out) == [("0", 4), ("1", 2), ("n", 6)]
    with pytest.raises(Exception, match="no order"):
        M.merge_vertices(g, batch.drop("at"), ["id"]).vertices.collect()
    edges = spark.createDataFrame([("b", "0", "1", 7), ("b", "0", "1", 7), ("b", "1", "0", 8), ("b", "1", "0", 8)], "label string, src string, dst string, key1 int")
    assert sorted((r.src, r.key1) for r in M.merge_edges(g, edges).edges.collect()) == [("0", 7), ("1", 8)]
    done, there = M.create_absent(g, vertices(spark, [("0", "a", 9), ("5", "a", 9), ("5", "a", 9)]))
    assert sorted((r.id, r.key1) for r in done.vertices.collect()) == [("0", 1), ("1", 2), ("5", 9)] and [r.id for r in there.collect()] == ["0"]


def test_counters_must_be_declared(spark):
    c = Catalog(use_schema=True).create_label("vertex", "a", "string", hits="counter", key1="int").create_label("edge", "b", "string", hits="counter")
    old = F.lit("2001-01-01").cast("timestamp")
    g = graph(spark, [("0", "a", 1), ("1", "a", 2)], [("e", "b", "0", "1", 5)])
    g = g.with_(catalog=c, vertices=g.vertices.withColumn("updated_at", old))
    deltas = spark.createDataFrame([("0", 2), ("0", 3), ("e", 4)], "id string, value long")
    out = {r.id: r for r in M.increment(g, "vertex", "hits", deltas).vertices.collect()}
    assert out["0"].hits == 5 and out["1"].hits is None and out["0"].updated_at.year > 2001 and out["1"].updated_at.year == 2001
    assert M.increment(g, "edge", "hits", deltas).edges.first().hits == 4
    with pytest.raises(errors.NotValid):
        M.increment(g, "vertex", "key1", deltas)


def test_graphml_round_trip(spark, tmp_path):
    g = graph(spark, [("0", "a", 1), ("1", "b", None)], [("e", "knows", "0", "1", 5)])
    files.write_graphml(g, str(tmp_path / "g"))
    back = files.read_graphml(spark, f"{tmp_path}/g/*", {"key1": "int"})
    assert sorted(tuple(r) for r in back.vertices.select("id", "label", "key1").collect()) == [("0", "a", 1), ("1", "b", None)]
    assert [tuple(r) for r in back.edges.select("id", "label", "src", "dst", "key1").collect()] == [("e", "knows", "0", "1", 5)]
    by_hand = tmp_path / "hand.xml"
    by_hand.write_text("""<graphml><graph edgedefault="directed">
      <node id="1"><data key="labelV">person</data><data key="name">marko</data><data key="age">29</data></node>
      <node id="2"><data key="labelV">person</data><data key="name">vadas</data></node>
      <edge id="7" source="1" target="2"><data key="labelE">knows</data><data key="weight">0.5</data></edge></graph></graphml>""")
    own = files.read_graphml(spark, str(by_hand), {"name": "string", "age": "int", "weight": "double"})
    assert own.V().has("person", "name", "marko").outE("knows").values("weight").to_list() == [0.5]
    assert own.V("1").out("knows").values("name").to_list() == ["vadas"]
