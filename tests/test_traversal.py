"""Traversals on the toy graph, and analytics with known results."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica import errors
from lattica.functions import scalars as S
from lattica.model import Graph
from lattica.operators import adjacency as A
from lattica.plans import pregel as G
from lattica.plans import predicates as P
from lattica.plans.traversal import __
from lattica.sources import toys


@pytest.fixture(scope="module")
def g(spark):
    graph = toys.modern(spark)
    return graph.with_(vertices=graph.vertices.cache(), edges=graph.edges.cache())


def test_hops(g):
    assert sorted(g.V(1).out("knows").values("name").to_list()) == ["josh", "vadas"]
    t = g.V(1).outE("knows").has("weight", 1.0).as_("here").inV().has("name", "josh").select("here")
    assert [r.weight for r in t.to_list()] == [1.0]
    assert g.V().both().hasLabel("person").order(("age", "desc")).limit(5).values("name").to_list() == ["peter", "josh", "josh", "josh", "marko"]
    assert sorted(g.V(4).bothE().otherV().values("name").to_list()) == ["lop", "marko", "ripple"]
    assert g.E(7).bothV().count().to_list() == [2]


def test_paths(g):
    assert len(g.V().repeat(__.both().simplePath(), times=3).path().to_list()) == 18
    t = g.V(1).repeat(__.both().simplePath(), until=(F.col("p_name") == "peter") | (F.col("__loops") == 2)).has("name", "peter").path("name")
    assert t.to_list() == [["marko", "lop", "peter"]]
    assert g.V(1).out().out().tree().count() == 4
    assert g.V().both().both().cyclicPath().count().to_list()[0] > 0


def test_filters(g):
    names = lambda t: sorted(t.values("name").to_list())
    assert names(g.V().has("age", P.gt(30))) == ["josh", "peter"]
    assert names(g.V().has("age", P.neq(29))) == ["josh", "peter", "vadas"]
    assert names(g.V().hasNot("age")) == ["lop", "ripple"]
    assert names(g.V().where(__.out("created"))) == ["josh", "marko", "peter"]
    assert names(g.V().hasLabel("person").not_(__.out("created"))) == ["vadas"]
    assert names(g.V().or_(__.out("knows"), __.in_("created"))) == ["lop", "marko", "ripple"]
    assert names(g.V().and_(__.out("knows"), __.out("created"))) == ["marko"]
    assert names(g.V().has("name", P.containing("p").and_(P.not_starting_with("p")))) == ["lop", "ripple"]
    assert names(g.V().has("age", P.outside(28, 32))) == ["peter", "vadas"]
    assert g.V().properties("name", "age").hasKey("age").count().to_list() == [4]
    assert sorted(g.V().both().dedup(by="lang").values("lang").to_list()) == ["java"]


def test_values_and_maps(g):
    assert g.V(1).valueMap("name", "age").to_list() == [{"name": ["marko"], "age": ["29"]}]
    assert g.E(7).elementMap().to_list()[0]["src"] == "1"
    assert sorted(g.V().label().dedup().to_list()) == ["person", "software"]
    assert g.V().has("age", 29).values("age").math("_ * 2").to_list() == [58.0]
    assert g.V().values("age").fold().local("sum").to_list() == [123.0]
    assert g.V().values("age").fold().unfold().count().to_list() == [4]
    assert g.V().values("age").mean().to_list() == [30.75] and g.V().values("none").max().to_list() == []
    assert g.inject(3, 4).is_(P.gt(3)).to_list() == [4]
    assert [tuple(x) for x in g.V(1).values("name").fold().index().to_list()] == [("marko", 0)]


def test_branches(g):
    assert sorted(g.V(4).union(__.in_(), __.out()).values("name").to_list()) == ["lop", "marko", "ripple"]
    assert sorted(g.V(1, 2).coalesce(__.out("knows"), __.in_("knows")).values("name").to_list()) == ["josh", "marko", "vadas"]
    assert sorted(g.V(2, 1).optional(__.out("knows")).values("name").to_list()) == ["josh", "vadas", "vadas"]
    assert sorted(g.V().choose(__.out("created"), __.constant("maker"), __.constant("other")).groupCount().to_list()) == [("maker", 3), ("other", 3)]
    assert sorted(g.V().branch("label", {"person": __.values("name"), "software": __.values("lang")}).to_list()).count("java") == 2
    rows = g.V().match(("a", __.out("created"), "b"), ("b", __.in_("created"), "c")).df().where("a < c").collect()
    assert sorted((r.a, r.b, r.c) for r in rows) == [(1, 3, 4), (1, 3, 6), (4, 3, 6)]
    assert sorted(g.V(1).repeat(__.out(), times=2, emit=True).values("name").to_list()) == ["josh", "lop", "lop", "ripple", "vadas"]


def test_side_effects_and_mutations(g):
    assert g.V().aggregate("x", by="age").cap("x").count() == 4
    sub = g.E().hasLabel("created").subgraph()
    assert sub.vertices.count() == 5 and sub.edges.count() == 4
    assert g.V().has("name", "lop").drop().edges.count() == 3
    assert g.V().has("name", "lop").property("lang", "c").V().has("lang", "c").count().to_list() == [1]
    made = g.with_(edges=g.edges.withColumn("id", F.col("id").cast("string"))).V(1).addE("likes", __.out("created"), weight=0.9)
    assert made.edges.where("label = 'likes'").count() == 1
    assert g.V(1).withSack(1.0).outE().sack(lambda a, b: a * b, by="weight").inV().sack().count().to_list() == [3]
    assert g.V().as_("a").out("created").in_("created").as_("b").where("a", P.neq, "b").select("a", "b", by="name").df().count() == 6
    assert g.V().project(name="name", made=__.out("created").count()).df().where("made > 1").collect()[0].name == "josh"


def test_positions_and_aggregates_inside_children(g):
    assert sorted(g.V(1, 4).local(__.outE().order(("weight", "desc")).limit(1)).values("weight").to_list()) == [1.0, 1.0]
    assert sorted(g.V().where(__.out().count().is_(0)).values("name").to_list()) == ["lop", "ripple", "vadas"]
    assert sorted(g.V().where(__.out().count().is_(P.gte(2))).values("name").to_list()) == ["josh", "marko"]
    assert dict(map(tuple, g.V().groupCount(__.out().count()).to_list())) == {0: 3, 1: 1, 2: 1, 3: 1}
    assert g.V().order((__.both().count(), "desc")).limit(1).values("name").to_list()[0] in ("josh", "lop", "marko")
    assert sorted(g.V().hasLabel("person").map(__.out().order("name").values("name")).to_list()) == ["josh", "lop", "lop"]
    assert g.V().values("age").order().range(1, 3).to_list() == [29, 32] and g.V().tail(2, "age").count().to_list() == [2]
    assert sorted(g.V(1, 4).union(__.out().dedup().count()).to_list()) == [2, 3]
    assert g.V().sample(3).count().to_list() == [3] and g.V().coin(1.0).count().to_list() == [6]
    assert sorted(len(x) for x in g.V().union(__.out().fold()).to_list()) == [0, 0, 0, 1, 2, 3]


def test_scalars(spark):
    df = spark.createDataFrame([("  Abc ", [1, 2, 3], "2020-01-02 03:04:05")], "s string, l array<int>, t string")
    s, l, t = F.col("s"), F.col("l"), F.col("t")
    two = F.array(F.lit(2), F.lit(9))
    expected = {
        "trim": (S.trim(s), "Abc"), "left": (S.l_trim(s), "Abc "), "right": (S.r_trim(s), "  Abc"), "reverse": (S.reverse(S.trim(s)), "cbA"), "replace": (S.replace(s, "b", "x"), "  Axc "),
        "split": (S.split(S.trim(s), "b"), ["A", "c"]), "chars": (S.split(S.trim(s), ""), ["A", "b", "c"]), "sub": (S.substring(S.trim(s), -2), "bc"), "sub2": (S.substring(S.trim(s), 0, -1), "Ab"),
        "lower": (S.to_lower(S.trim(s)), "abc"), "format": (S.format_string("<%{a}>", {"a": S.trim(s)}), "<Abc>"), "diff": (S.date_diff(S.date_add(S.as_date(t), "hour", 2), S.as_date(t)), 7200),
        "inter": (S.intersect(l, two), [2]), "minus": (S.difference(l, two), [1, 3]), "either": (S.disjunct(l, two), [1, 3, 9]), "merge": (S.merge(l, two), [1, 2, 3, 9]), "combine": (S.combine(l, two), [1, 2, 3, 2, 9]),
        "join": (S.conjoin(l.cast("array<string>"), "-"), "1-2-3"), "all": (S.all_(l, lambda x: x > 0), True), "any": (S.any_(l, lambda x: x > 2), True), "none": (S.none_(l, lambda x: x > 3), True), "pairs": (F.size(S.product(l, two)), 6),
    }
    row = df.select(*(c.alias(k) for k, (c, _) in expected.items())).first()
    assert {k: row[k] for k in expected} == {k: v for k, (_, v) in expected.items()}


def results(df):
    return {r.id: r.value for r in df.collect()}


def test_known_analytics(spark):
    g = toys.weighted(spark, [(5, 1, 1), (1, 5, 1), (1, 2, 1), (2, 5, 1)])
    assert results(G.max_value(g)) == {1: 5, 2: 5, 5: 5}
    back = G.write_back(g, G.max_value(g), "max")
    assert {r["max"] for r in back.vertices.collect()} == {5}
    more = G.derive_edges(toys.modern(spark), "e2", toys.modern(spark).edges.select("src", "dst", "weight").withColumn("src", F.col("src")))
    assert more.edges.where("label = 'e2'").count() == 6
    g = toys.weighted(spark, [(1, 2, 1), (1, 3, 3), (2, 3, 1), (2, 4, 10), (3, 4, 2)])
    assert results(G.shortest_paths(g, 1, F.col("weight"))) == {1: 0, 2: 1, 3: 2, 4: 4}
    g = toys.weighted(spark, [(0, 1, 1), (0, 3, 3), (1, 0, 1), (1, 2, 2), (1, 3, 1), (2, 1, 2), (2, 4, 4), (3, 0, 3), (3, 1, 1), (3, 4, 4), (4, 3, 4), (4, 2, 4)])
    assert results(G.shortest_paths(g, 1, F.col("weight"))) == {0: 1, 1: 0, 2: 2, 3: 1, 4: 5}
    g = toys.weighted(spark, [(1, 2, 0.1), (1, 3, 0.5), (1, 4, 0.4), (2, 4, 0.7), (2, 5, 0.3), (3, 4, 0.2), (4, 5, 0.9)])
    assert results(A.reduce_edges(g, F.col("weight"))) == {1: 0.1, 2: 0.3, 3: 0.2, 4: 0.9}
    assert results(A.reduce_neighbours(g, F.col("id"))) == {2: 1, 3: 1, 4: 6, 5: 6}
    assert sorted(tuple(r) for r in A.neighbour_pairs(g, F.col("weight") > 0.5).collect()) == [(2, 4), (4, 5)]
    assert G.triangles(g).count() == 3 and results(G.bfs(g, 1))[5] == 2
    assert set(results(G.label_propagation(g, 3)).values()) <= {1, 2, 3, 4, 5}
    assert abs(sum(results(G.page_rank(g, 5)).values()) - 1) < 1e-9


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10**6))
def test_random_graphs_against_plain_python(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(9), rng.randrange(9), rng.randrange(1, 5)) for _ in range(rng.randrange(1, 14))]
    g = toys.weighted(spark, edges)
    two = sorted(b2 for a, b, _ in edges for a2, b2, _ in edges if a2 == b)
    assert sorted(r.id for r in g.V().out().out().ids().collect()) == two
    reach = {v: {v} for e in edges for v in e[:2]}
    for _ in range(9):
        for a, b, _w in edges:
            both = reach[a] | reach[b]
            for v in both:
                reach[v] = reach[v] | both
    assert results(G.connected_components(g)) == {v: min(s) for v, s in reach.items()}


def test_positions_in_children_count_per_start(spark):
    g = toys.modern(spark)
    per = lambda child: sorted(g.V().as_("a").local(child).select("a").ids().groupBy("id").count().select("id", "count").collect())
    out = {1: 3, 4: 2, 6: 1}
    assert [(r.id, r["count"]) for r in per(__.out().tail(1))] == [(k, 1) for k in out]
    assert [(r.id, r["count"]) for r in per(__.out().sample(2))] == [(k, min(2, n)) for k, n in out.items()]
    assert [(r.id, r["count"]) for r in per(__.out().skip(1))] == [(k, n - 1) for k, n in out.items() if n > 1]
    assert sorted(g.V().local(__.out("created").values("name").order().tail(1)).to_list()) == ["lop", "lop", "ripple"]
    groups = g.V(1, 4).local(__.out().groupCount("label")).to_list()
    assert sorted(tuple(sorted(x.items())) for x in groups) == [(("person", 2), ("software", 1)), (("software", 2),)]


def test_paths_by_property_keep_edges(spark):
    g = toys.modern(spark)
    assert sorted(g.V(1).outE("created").inV().path("name", "weight").to_list()) == [["marko", "0.4", "lop"]]
    assert sorted(g.V(1).outE("created").inV().path("name").to_list(), key=str) == [["marko", None, "lop"]]
    assert sorted(g.V(6).out().values("name").path("name").to_list()) == [["peter", "lop", "lop"]]


def test_long_chains_have_no_round_limit(spark):
    n = 70
    vs = spark.createDataFrame([(i, "v") for i in range(n)], "id long, label string")
    es = spark.createDataFrame([(i, "e", i, i + 1) for i in range(n - 1)], "id long, label string, src long, dst long")
    g = Graph(vs, es)
    assert g.V(0).repeat(__.out(), until=F.col("__id") == n - 1).ids().collect()[0][0] == n - 1
    with pytest.raises(errors.GraphError):
        g.V(0).repeat(__.out(), until=F.col("__id") == n - 1, max_loops=5).ids()


def test_steps_that_change_the_graph(spark):
    g = toys.modern(spark)
    assert g.V().count().to_list() == [6]
    assert toys.modern(spark).V().none_().count().to_list() == [0]
    named = Graph(g.vertices.withColumn("id", F.col("id").cast("string")), g.edges.withColumns({c: F.col(c).cast("string") for c in ("id", "src", "dst")}))
    t = named.V().hasLabel("software")
    assert t.addV("copy", name="twin").V().has("copy", "name", "twin").count().to_list() == [2]
    up = named.V().mergeV({"label": "person", "name": "marko"}, {"age": 1}, {"age": 77})
    assert up.V().has("name", "marko").values("age").to_list() == [77] and up.V().count().to_list() == [6]
    new = named.V().mergeV({"label": "person", "name": "stephen"}, {"age": 1}, {"age": 77})
    assert new.V().has("name", "stephen").values("age").to_list() == [1] and new.V().count().to_list() == [7]
    linked = named.V().mergeE("knows", "1", "2", weight=0.9)
    assert linked.V("1").outE("knows").has("weight", 0.9).count().to_list() == [1] and linked.E().count().to_list() == [6]
    assert g.V().values("age").reduce(F.product).to_list() == [29 * 27 * 32 * 35]
    t = g.V().aggregate("all").side_effect(__.out("created").aggregate("made")).hasLabel("software")
    assert t.count().to_list() == [2] and t.cap("made").count() == 4 and t.cap("all").count() == 6
    assert sorted(g.V().hasLabel("software").call("degree", direction="in").to_list()) == [1, 3]
    names = [n for n, _ in g.V().hasLabel("person").out("created").profile()]
    assert any("Join" in n for n in names)


def test_stream_of_edges_keeps_borders(spark, tmp_path):
    from lattica.streaming import changes

    schema = "event_id long, ts timestamp, user_id long, event_type string"
    rows = [(i, f"2024-01-01 00:{i:02}:00", 100 + i % 7, "ab"[i % 2]) for i in range(24)]
    for k in range(4):
        part = spark.createDataFrame(rows[6 * k : 6 * k + 6], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = changes.read_events(spark, str(tmp_path / "in"), schema, 1)
    changes.keep_next_edges(events, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "edges")).select("src", "dst").collect())
    want = sorted(tuple(r) for r in changes.next_user_edges(spark.read.schema(schema).parquet(str(tmp_path / "in"))).collect())
    plain = sorted((a[2], b[2]) for t in "ab" for own in [[r for r in rows if r[3] == t]] for a, b in zip(own, own[1:]))
    assert got == want == plain
