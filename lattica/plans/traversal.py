"""Traversals: a chain of steps that compiles to one DataFrame plan.

A traverser is a row.  `__id` (element) or `__value` is its current object; `__path`, tags
(`@name`), `__loops` and `__sack` exist only if a step of the traversal needs them.  Element
properties are joined in only when a step reads them, so a hop that goes on by ids alone
touches the edges and not the vertices.  Child traversals (`where`, `coalesce`, `by`, ...)
run once on the distinct current elements and are joined back, never per row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import GraphError
from ..model import Graph
from .predicates import P, eq

#: A loop's plan is checkpointed every so many rounds.
CUT_EVERY = 4

PATH_STEPS = {"path", "simplePath", "cyclicPath", "tree"}


@dataclass(frozen=True)
class State:
    graph: Graph
    df: DataFrame
    kind: str  # vertex, edge, value, property
    attached: bool = False  # property columns p_<key> are there
    path: bool = False
    tags: dict[str, str] = field(default_factory=dict)  # name -> kind
    stores: dict[str, DataFrame] = field(default_factory=dict)
    #: Inside a child traversal: the objects it started from, as (__root).
    roots: DataFrame | None = None

    @property
    def current(self) -> str:
        return "__id" if self.kind in ("vertex", "edge") else "__value"

    def carried(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("@") or c in ("__path", "__loops", "__sack", "__root", "__rank", "__from")]

    def table(self) -> DataFrame:
        return self.graph.vertices if self.kind == "vertex" else self.graph.edges

    def keys(self) -> list[str]:
        return self.graph.vertex_keys() if self.kind == "vertex" else self.graph.edge_keys()

    def attach(self) -> State:
        """With label, endpoints and properties of the current elements."""
        if self.attached or self.kind not in ("vertex", "edge"):
            return self
        meta = ["label"] if self.kind == "vertex" else ["label", "src", "dst"]
        rows = self.table().select(F.col("id").alias("__id"), *(F.col(c).alias(f"p_{c}") for c in meta), *(F.col(f"`{k}`").alias(f"p_{k}") for k in self.keys()))
        return replace(self, df=self.df.join(rows, "__id", "left" if self.graph.keep_dangling else "inner"), attached=True)

    def column(self, key: str) -> Column:
        name = f"p_{key}"
        return F.col(f"`{name}`") if name in self.df.columns else F.lit(None)

    def moved(self, df: DataFrame, kind: str, **more) -> State:
        """New current objects; the path grows if it is kept."""
        if self.path:
            df = df.withColumn("__path", F.concat("__path", F.array(_visited(kind))))
        return replace(self, df=df, kind=kind, **({"attached": False} | more))


Step = Callable[[State], State]


def _visited(kind: str) -> Column:
    """The current object as an item of the path; a vertex and an edge with one id differ."""
    return F.struct(F.lit(kind).alias("kind"), F.col("__id" if kind in ("vertex", "edge") else "__value").cast("string").alias("at"))


class Traversal:
    """A chain of steps.  Without graph it is anonymous, for use inside other steps."""

    def __init__(self, graph: Graph | None = None, steps: tuple[tuple[str, Step], ...] = ()):
        self.graph, self.steps = graph, steps

    def _then(self, name: str, step: Step) -> Traversal:
        return Traversal(self.graph, (*self.steps, (name, step)))

    def _needs_path(self) -> bool:
        return any(name.split(":")[0] in PATH_STEPS or name.endswith(":path") for name, _ in self.steps)

    def state(self) -> State:
        if self.graph is None:
            raise GraphError("an anonymous traversal has no graph")
        start = State(self.graph, None, "none", path=self._needs_path())
        return self.apply(start)

    def apply(self, state: State) -> State:
        for _, step in self.steps:
            state = step(state)
        return state

    # results

    def df(self) -> DataFrame:
        """Elements as rows of their table, values as rows (value)."""
        s = self.state()
        if s.kind in ("vertex", "edge"):
            s = s.attach()
            drop = [c for c in s.df.columns if not c.startswith("p_") and c != "__id"]
            out = s.df.drop(*drop)
            return out.select(F.col("__id").alias("id"), *(F.col(f"`{c}`").alias(c[2:]) for c in out.columns if c.startswith("p_")))
        if s.kind == "row":
            return s.df.select(*(c for c in s.df.columns if c not in s.carried()))
        return s.df.select(F.col("__value").alias("value"))

    def ids(self) -> DataFrame:
        s = self.state()
        return s.df.select(F.col(s.current).alias("id"))

    def to_list(self) -> list:
        rows = self.df().collect()
        return [r[0] if len(r) == 1 else r for r in rows]

    def cap(self, name: str) -> DataFrame:
        """Rows (value) that aggregate/store(name) gathered."""
        return self.state().stores[name]

    def explain(self) -> None:
        self.df().explain("formatted")

    def profile(self) -> list[tuple[str, int | None]]:
        """Runs the traversal and names the operators of the plan that ran, from the last to
        the first, with the rows that each gave where Spark counts them."""
        execution = self.df()._jdf.queryExecution()
        execution.toRdd().count()
        found, todo = [], [execution.executedPlan()]
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
                continue
            if kind.endswith("QueryStageExec"):
                todo.append(node.plan())
                continue
            rows = node.metrics().get("numOutputRows")
            found.append((node.nodeName(), rows.get().value() if rows.isDefined() else None))
            children = node.children()
            todo += [children.apply(k) for k in reversed(range(children.size()))]
        return found

    # sources

    def _source(self, kind: str, ids: tuple) -> Traversal:
        def step(s: State) -> State:
            from ..operators.lookup import by_ids

            table = by_ids(s.graph, kind, list(ids))
            meta = ["label"] if kind == "vertex" else ["label", "src", "dst"]
            keys = s.graph.vertex_keys() if kind == "vertex" else s.graph.edge_keys()
            df = table.select(F.col("id").alias("__id"), *(F.col(c).alias(f"p_{c}") for c in meta), *(F.col(f"`{k}`").alias(f"p_{k}") for k in keys))
            if s.path:
                df = df.withColumn("__path", F.array(_visited(kind)))
            return replace(s, df=df, kind=kind, attached=True)

        return self._then("V" if kind == "vertex" else "E", step)

    def V(self, *ids) -> Traversal:
        return self._source("vertex", ids)

    def E(self, *ids) -> Traversal:
        return self._source("edge", ids)

    def inject(self, *values) -> Traversal:
        def step(s: State) -> State:
            new = s.graph.spark.createDataFrame([(v,) for v in values], ["__value"])
            if s.df is None:
                if s.path:
                    new = new.withColumn("__path", F.array(_visited("value")))
                return replace(s, df=new, kind="value")
            return replace(s, df=s.df.select("__value").unionByName(new), kind="value")

        return self._then("inject", step)

    # hops

    def _hop(self, direction: str, labels: tuple, edge: bool) -> Traversal:
        def step(s: State) -> State:
            inc = s.graph.incidence(direction, *labels).select(F.col("v").alias("__v"), F.col("other").alias("__other"), F.col("edge").alias("__edge"))
            rest = [F.col(f"`{c}`") for c in s.carried() if c != "__from"]
            df = s.df.select("__id", *rest).join(inc, F.col("__id") == F.col("__v"))
            if edge:
                return s.moved(df.select(F.col("__edge").alias("__id"), F.col("__v").alias("__from"), *rest), "edge")
            df = df.select(F.col("__other").alias("__id"), *rest)
            if not s.graph.intact and not s.graph.keep_dangling:
                df = df.join(s.graph.vertices.select(F.col("id").alias("__id")), "__id", "left_semi")
            return s.moved(df, "vertex")

        return self._then("hop", step)

    def out(self, *labels) -> Traversal:
        return self._hop("out", labels, False)

    def in_(self, *labels) -> Traversal:
        return self._hop("in", labels, False)

    def both(self, *labels) -> Traversal:
        return self._hop("both", labels, False)

    def outE(self, *labels) -> Traversal:
        return self._hop("out", labels, True)

    def inE(self, *labels) -> Traversal:
        return self._hop("in", labels, True)

    def bothE(self, *labels) -> Traversal:
        return self._hop("both", labels, True)

    def _end(self, which: str) -> Traversal:
        def step(s: State) -> State:
            s = s.attach()
            rest = [F.col(f"`{c}`") for c in s.carried() if c != "__from"]
            src, dst = F.col("p_src"), F.col("p_dst")
            if which == "both":
                df = s.df.select(src.alias("__id"), *rest).unionByName(s.df.select(dst.alias("__id"), *rest))
            else:
                to = {"out": src, "in": dst, "other": F.when(F.col("__from") == src, dst).otherwise(src) if which == "other" else None}[which]
                df = s.df.select(to.alias("__id"), *rest)
            return s.moved(df, "vertex")

        return self._then("end", step)

    def outV(self) -> Traversal:
        return self._end("out")

    def inV(self) -> Traversal:
        return self._end("in")

    def bothV(self) -> Traversal:
        return self._end("both")

    def otherV(self) -> Traversal:
        return self._end("other")

    # filters

    def _where(self, name: str, test: Callable[[State], Column], attach: bool = True) -> Traversal:
        def step(s: State) -> State:
            s = s.attach() if attach else s
            return replace(s, df=s.df.where(test(s)))

        return self._then(name, step)

    def has(self, *args) -> Traversal:
        """has(key), has(key, value or P), has(label, key, value or P), has(key, child)"""
        if len(args) == 3:
            return self.hasLabel(args[0]).has(*args[1:])
        key = args[0]
        if len(args) == 1:
            return self._where("has", lambda s: s.column(key).isNotNull())
        if isinstance(args[1], Traversal):
            return self.where(Traversal().values(key)._join(args[1]))
        test = args[1] if isinstance(args[1], P) else eq(args[1])
        return self._where("has", lambda s: test(s.column(key)))

    def _join(self, other: Traversal) -> Traversal:
        return Traversal(self.graph, self.steps + other.steps)

    def hasNot(self, key: str) -> Traversal:
        return self._where("hasNot", lambda s: s.column(key).isNull())

    def hasLabel(self, *labels) -> Traversal:
        return self._where("hasLabel", lambda s: F.col("p_label").isin(*labels))

    def hasId(self, *ids) -> Traversal:
        return self._where("hasId", lambda s: F.col("__id").isin(*ids), attach=False)

    def hasKey(self, *keys) -> Traversal:
        return self._where("hasKey", lambda s: F.col("__key").isin(*keys), attach=False)

    def hasValue(self, *values) -> Traversal:
        return self._where("hasValue", lambda s: F.col("__value").isin(*values), attach=False)

    def is_(self, test) -> Traversal:
        test = test if isinstance(test, P) else eq(test)
        return self._where("is", lambda s: test(F.col("__value")), attach=False)

    def filter(self, test: Column | Traversal) -> Traversal:
        """A child traversal, or a column over p_<key>, __id, __value."""
        if isinstance(test, Traversal):
            return self.where(test)
        return self._where("filter", lambda s: test)

    def where(self, *args) -> Traversal:
        """where(child) keeps traversers for which the child yields something;
        where(tag, P-maker, other tag) compares tagged objects."""
        if isinstance(args[0], Traversal):
            return self._semi(args[0], "left_semi")
        tag, test, other = args
        return self._where("where", lambda s: test(F.col(f"`@{other}`")).test(F.col(f"`@{tag}`")), attach=False)

    def _semi(self, child: Traversal, how: str) -> Traversal:
        def step(s: State) -> State:
            hit = _child(s, child).df.select(F.col("__root").alias("__hit")).distinct()
            return replace(s, df=s.df.join(hit, F.col(s.current) == F.col("__hit"), how))

        return self._then("where", step)

    def not_(self, child: Traversal) -> Traversal:
        return self._semi(child, "left_anti")

    def and_(self, *children: Traversal) -> Traversal:
        out = self
        for c in children:
            out = out.where(c)
        return out

    def or_(self, *children: Traversal) -> Traversal:
        def step(s: State) -> State:
            hits = None
            for c in children:
                own = _child(s, c).df.select(F.col("__root").alias("__hit"))
                hits = own if hits is None else hits.union(own)
            return replace(s, df=s.df.join(hits.distinct(), F.col(s.current) == F.col("__hit"), "left_semi"))

        return self._then("or", step)

    def dedup(self, *tags: str, by: str | Traversal | None = None) -> Traversal:
        def step(s: State) -> State:
            if tags:
                return replace(s, df=s.df.dropDuplicates([f"@{t}" for t in tags]))
            own = ["__root"] if "__root" in s.df.columns else []
            if by is not None:
                s, key = _by(s, by)
                return replace(s, df=s.df.withColumn("__by", key).where("__by IS NOT NULL").dropDuplicates([*own, "__by"]).drop("__by"))
            return replace(s, df=s.df.dropDuplicates([*own, s.current]))

        return self._then("dedup", step)

    def simplePath(self) -> Traversal:
        return self._where("simplePath", lambda s: F.size(F.array_distinct("__path")) == F.size("__path"), attach=False)

    def cyclicPath(self) -> Traversal:
        return self._where("cyclicPath", lambda s: F.size(F.array_distinct("__path")) < F.size("__path"), attach=False)

    def _slice(self, name: str, low: int, high: int | None) -> Traversal:
        """Positions [low, high); within a child traversal of each object it started from."""
        def step(s: State) -> State:
            if "__root" not in s.df.columns:
                df = s.df.offset(low) if low else s.df
                return replace(s, df=df if high is None else df.limit(high - low))
            n = F.row_number().over(W.partitionBy("__root").orderBy(F.col("__rank" if "__rank" in s.df.columns else s.current)))
            df = s.df.withColumn("__n", n).where(F.col("__n") > low)
            return replace(s, df=(df if high is None else df.where(F.col("__n") <= high)).drop("__n"))

        return self._then(name, step)

    def limit(self, n: int) -> Traversal:
        return self._slice("limit", 0, n)

    def skip(self, n: int) -> Traversal:
        return self._slice("skip", n, None)

    def range(self, low: int, high: int) -> Traversal:
        return self._slice("range", low, high)

    def _first(self, name: str, n: int, order: Callable[[State], tuple[State, list[Column]]]) -> Traversal:
        """The first n in an order; within a child traversal of each object it started from."""
        def step(s: State) -> State:
            s, columns = order(s)
            if "__root" not in s.df.columns:
                return replace(s, df=s.df.orderBy(*columns).limit(n))
            rank = F.row_number().over(W.partitionBy("__root").orderBy(*columns))
            return replace(s, df=s.df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n"))

        return self._then(name, step)

    def tail(self, n: int, *keys: str) -> Traversal:
        """The last n in order of the keys (without keys in the order that order() gave, or of
        the current objects)."""
        def order(s: State) -> tuple[State, list[Column]]:
            s = s.attach() if keys else s
            columns = [s.column(k) for k in keys] or [F.col("__rank" if "__rank" in s.df.columns else s.current)]
            return s, [c.desc() for c in columns]

        return self._first("tail", n, order)

    def sample(self, n: int, seed: int = 0) -> Traversal:
        return self._first("sample", n, lambda s: (s, [F.xxhash64(s.current, F.lit(seed)), F.rand(seed)]))

    def coin(self, p: float, seed: int = 0) -> Traversal:
        return self._then("coin", lambda s: replace(s, df=s.df.where(F.rand(seed) < p)))

    def order(self, *by) -> Traversal:
        """by: keys or child traversals, or (one of these, 'asc' | 'desc' | 'shuffle'); none:
        the current object.  Ties are broken by the object, so that pages are stable."""
        def step(s: State) -> State:
            columns = []
            for b in by or (None,):
                key, way = b if isinstance(b, tuple) else (b, "asc")
                s, c = (s, F.col(s.current)) if key is None else _by(s, key)
                columns.append(F.rand() if way == "shuffle" else c.desc_nulls_last() if way == "desc" else c.asc_nulls_last())
            columns.append(F.col(s.current))
            if "__root" in s.df.columns:  # the place of each result is kept for positional steps
                return replace(s, df=s.df.withColumn("__rank", F.row_number().over(W.partitionBy("__root").orderBy(*columns))))
            return replace(s, df=s.df.orderBy(*columns))

        return self._then("order", step)

    # projections

    def _to_value(self, name: str, make: Callable[[State], Column], keep_null: bool = False, attach: bool = True) -> Traversal:
        def step(s: State) -> State:
            s = s.attach() if attach else s
            df = s.df.select(make(s).alias("__value"), *(F.col(f"`{c}`") for c in s.carried()))
            return s.moved(df if keep_null else df.where("__value IS NOT NULL"), "value")

        return self._then(name, step)

    def values(self, *keys: str) -> Traversal:
        if len(keys) == 1:
            return self._to_value("values", lambda s: s.column(keys[0]))

        def step(s: State) -> State:
            s = s.attach()
            own = keys or tuple(s.keys())
            df = s.df.select(F.explode(F.array(*(s.column(k).cast("string") for k in own))).alias("__value"), *(F.col(f"`{c}`") for c in s.carried()))
            return s.moved(df.where("__value IS NOT NULL"), "value")

        return self._then("values", step)

    def properties(self, *keys: str) -> Traversal:
        """Rows (__key, __value) of the properties there are."""
        def step(s: State) -> State:
            s = s.attach()
            own = keys or tuple(s.keys())
            pairs = F.array(*(F.struct(F.lit(k).alias("k"), s.column(k).cast("string").alias("v")) for k in own))
            df = s.df.select(F.explode(pairs).alias("__p"), *(F.col(f"`{c}`") for c in s.carried()))
            return replace(s, df=df.select(F.col("__p.k").alias("__key"), F.col("__p.v").alias("__value"), *(F.col(f"`{c}`") for c in s.carried())).where("__value IS NOT NULL"), kind="property", attached=False)

        return self._then("properties", step)

    def key(self) -> Traversal:
        return self._to_value("key", lambda s: F.col("__key"), attach=False)

    def value(self) -> Traversal:
        return self._to_value("value", lambda s: F.col("__value"), attach=False)

    def id(self) -> Traversal:
        return self._to_value("id", lambda s: F.col("__id"), attach=False)

    def label(self) -> Traversal:
        return self._to_value("label", lambda s: F.col("p_label"))

    def _map(self, s: State, keys: tuple, wrap: bool, meta: bool) -> Column:
        own = list(keys) or s.keys()
        pairs = [F.struct(F.lit(k).alias("key"), s.column(k).cast("string").alias("value")) for k in own]
        if meta:
            names = ["id", "label"] + (["src", "dst"] if s.kind == "edge" else [])
            pairs = [F.struct(F.lit(k).alias("key"), (F.col("__id") if k == "id" else F.col(f"p_{k}")).cast("string").alias("value")) for k in names] + pairs
        held = F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())
        if wrap:
            held = F.transform(held, lambda x: F.struct(x["key"].alias("key"), F.array(x["value"]).alias("value")))
        return F.map_from_entries(held)

    def valueMap(self, *keys: str) -> Traversal:
        return self._to_value("valueMap", lambda s: self._map(s, keys, True, False))

    def propertyMap(self, *keys: str) -> Traversal:
        return self._to_value("propertyMap", lambda s: self._map(s, keys, True, False))

    def elementMap(self, *keys: str) -> Traversal:
        return self._to_value("elementMap", lambda s: self._map(s, keys, False, True))

    def constant(self, value) -> Traversal:
        return self._to_value("constant", lambda s: F.lit(value), attach=False)

    def identity(self) -> Traversal:
        return self._then("identity", lambda s: s)

    #: Steps run as one plan, so there is nothing to wait for.
    barrier = identity

    def none_(self) -> Traversal:
        """No traverser goes on."""
        return self._then("none", lambda s: replace(s, df=s.df.where(F.lit(False))))

    def side_effect(self, child: Traversal) -> Traversal:
        """What the child gathers with aggregate() stays; the traversers go on unchanged."""
        return self._then("sideEffect", lambda s: replace(s, stores=s.stores | child.apply(s).stores))

    sideEffect = side_effect

    def call(self, name: str, **arguments) -> Traversal:
        """A named algorithm over the graph gives each vertex a value (none: no traverser)."""
        def step(s: State) -> State:
            from ..operators import adjacency
            from . import pregel

            services = {"degree": lambda g, **k: adjacency.degrees(g, **k).withColumnRenamed("degree", "value"), "page_rank": pregel.page_rank, "components": pregel.connected_components, "label_propagation": pregel.label_propagation, "triangles": pregel.triangle_count, "shortest_paths": pregel.shortest_paths}
            if name not in services:
                raise GraphError(f"there is no service {name}")
            found = services[name](s.graph, **arguments).select(F.col("id").alias("__v"), F.col("value").alias("__value")).where("__value IS NOT NULL")
            df = s.df.join(found, F.col("__id") == F.col("__v")).select("__value", *(F.col(f"`{c}`") for c in s.carried() if c != "__from"))
            return s.moved(df, "value")

        return self._then("call", step)

    def map(self, make: Callable[[Column], Column] | Traversal) -> Traversal:
        """A column expression of the current value (string, date, list and own functions),
        or the first result, in their order, of a child traversal."""
        if isinstance(make, Traversal):
            return self.union(make.limit(1))
        return self._to_value("map", lambda s: make(F.col(s.current)), attach=False)

    def math(self, expression: str) -> Traversal:
        """Arithmetic on `_` (the current value) and tags, as a double."""
        def make(s: State) -> Column:
            text = expression
            for t in sorted(s.tags, key=len, reverse=True):
                text = text.replace(t, f"`@{t}`")
            return F.expr(text.replace("_", "__value") if "`@" not in text else text).cast("double")

        return self._to_value("math", make, attach=False)

    def index(self) -> Traversal:
        """(value, position) of the elements of a list."""
        def step(s: State) -> State:
            df = s.df.select(F.posexplode("__value").alias("__at", "__item"), *(F.col(f"`{c}`") for c in s.carried()))
            return replace(s, df=df.select(F.struct(F.col("__item").alias("item"), F.col("__at").alias("index")).alias("__value"), *(F.col(f"`{c}`") for c in s.carried())), kind="value")

        return self._then("index", step)

    def as_(self, name: str) -> Traversal:
        def step(s: State) -> State:
            return replace(s, df=s.df.withColumn(f"@{name}", F.col(s.current)), tags=s.tags | {name: s.kind})

        return self._then("as", step)

    def select(self, *names: str, by: str | None = None) -> Traversal:
        """One tag becomes the current object; several become a row with these columns,
        by: a property of each (of ids otherwise)."""
        def step(s: State) -> State:
            if len(names) == 1:
                kind = s.tags[names[0]]
                to = "__id" if kind in ("vertex", "edge") else "__value"
                df = s.df.select(F.col(f"`@{names[0]}`").alias(to), *(F.col(f"`{c}`") for c in s.carried() if c != "__from"))
                got = s.moved(df, kind)
                return got
            df = s.df
            for n in names:
                if by is not None and s.tags[n] in ("vertex", "edge"):
                    rows = (s.graph.vertices if s.tags[n] == "vertex" else s.graph.edges).select(F.col("id").alias(f"@{n}"), F.col(by).alias(n))
                    df = df.join(rows, f"@{n}")
                else:
                    df = df.withColumn(n, F.col(f"`@{n}`"))
            return replace(s, df=df.select(*names, *(F.col(f"`{c}`") for c in s.carried())), kind="row", attached=False)

        return self._then("select", step)

    def project(self, **columns: str | Traversal) -> Traversal:
        """A row with a column each: a property, or the first result of a child."""
        def step(s: State) -> State:
            s = s.attach()
            df = s.df
            for name, by in columns.items():
                if isinstance(by, Traversal):
                    child = _child(s, by)
                    first = child.df.groupBy("__root").agg(F.min(child.current).alias(name))
                    df = df.join(first.withColumnRenamed("__root", "__r"), F.col(s.current) == F.col("__r"), "left").drop("__r")
                else:
                    df = df.withColumn(name, F.col("__id") if by == "id" else s.column(by))
            return replace(s, df=df.select(*columns, *(F.col(f"`{c}`") for c in s.carried())), kind="row", attached=False)

        return self._then("project", step)

    def path(self, *by: str) -> Traversal:
        """The list of visited ids and values; with by, of properties of the visited elements
        (several take turns), null where an element lacks it.  Values stay as they are."""
        def step(s: State) -> State:
            if not by:
                return replace(s, df=s.df.select(F.transform("__path", lambda x: x["at"]).alias("__value"), *(F.col(f"`{c}`") for c in s.carried() if c == "__root")), kind="value", attached=False)
            own = [c for c in s.carried() if c == "__root"]
            rows = s.df.select("__path", *own, F.monotonically_increasing_id().alias("__row"))
            items = rows.select("__row", *own, F.posexplode("__path").alias("__at", "__item")).select("__row", *own, "__at", F.col("__item.kind").alias("__kind"), F.col("__item.at").alias("__step"), F.pmod("__at", F.lit(len(by))).alias("__turn"))
            named = None
            for kind, table in (("vertex", s.graph.vertices), ("edge", s.graph.edges)):
                for k, key in enumerate(by):
                    if key in table.columns:
                        part = table.select(F.lit(kind).alias("__kind"), F.col("id").cast("string").alias("__step"), F.lit(k).alias("__turn"), F.col(f"`{key}`").cast("string").alias("__by"))
                        named = part if named is None else named.union(part)
            items = items.withColumn("__by", F.lit(None).cast("string")) if named is None else items.join(named, ["__kind", "__step", "__turn"], "left")
            item = F.when(F.col("__kind").isin("vertex", "edge"), F.col("__by")).otherwise(F.col("__step"))
            lists = items.groupBy("__row", *own).agg(F.sort_array(F.collect_list(F.struct("__at", item.alias("__by")))).alias("__l"))
            return replace(s, df=lists.select(F.transform("__l", lambda x: x["__by"]).alias("__value"), *own), kind="value", attached=False)

        return self._then("path", step)

    def tree(self) -> DataFrame:
        """Rows (path, n): every distinct prefix of the paths, the nodes of the tree."""
        t = self._then("tree", lambda s: s)
        steps = t.state().df.select(F.transform("__path", lambda x: x["at"]).alias("path"))
        rows = steps.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path"))
        return rows.groupBy("path").agg(F.count("*").alias("n"))

    def loops(self) -> Traversal:
        return self._to_value("loops", lambda s: F.col("__loops"), attach=False)

    # aggregates

    def _agg(self, name: str, make: Callable[[str], Column], empty: bool = False) -> Traversal:
        def step(s: State) -> State:
            by = [F.col("__root")] if "__root" in s.df.columns else []
            agg = s.df.groupBy(*by).agg(make(s.current).alias("__value"))
            if not empty:
                agg = agg.where("__value IS NOT NULL")
            elif by and s.roots is not None:  # objects without any result count as well
                none = F.lit(0).cast("long") if name == "count" else F.array().cast(dict(agg.dtypes)["__value"])
                agg = s.roots.join(agg, "__root", "left").withColumn("__value", F.coalesce("__value", none))
            return replace(s, df=agg, kind="value", attached=False, path=False, tags={})

        return self._then(name, step)

    def count(self) -> Traversal:
        return self._agg("count", lambda c: F.count("*"), empty=True)

    def sum(self) -> Traversal:
        """No traversers: no result (as for min, max and mean)."""
        return self._agg("sum", F.sum)

    def min(self) -> Traversal:
        return self._agg("min", F.min)

    def max(self) -> Traversal:
        return self._agg("max", F.max)

    def mean(self) -> Traversal:
        return self._agg("mean", F.avg)

    def reduce(self, how: Callable[[str], Column]) -> Traversal:
        """Any aggregate function of the current objects, such as functions.product."""
        return self._agg("reduce", how)

    def fold(self) -> Traversal:
        """All objects in one list, which one task holds; aggregates do without it."""
        return self._agg("fold", F.collect_list, empty=True)

    def unfold(self) -> Traversal:
        def step(s: State) -> State:
            return replace(s, df=s.df.select(F.explode("__value").alias("__value"), *(F.col(f"`{c}`") for c in s.carried())))

        return self._then("unfold", step)

    def local(self, how: str | Traversal) -> Traversal:
        """count, sum, min, max or mean of the list that is the current value; or a child
        traversal whose positions, orders and aggregates count per traverser."""
        if isinstance(how, Traversal):
            return self.union(how)
        c = F.col("__value")
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
        make = {"count": F.size(c), "sum": total, "min": F.array_min(c), "max": F.array_max(c), "mean": total / F.size(c)}[how]
        return self._to_value("local", lambda s: make, attach=False)

    def group(self, by=None, value: str | None = None, how: Callable = F.collect_list) -> Traversal:
        """Rows (key, value): `how` over a property (default the object) by key; traversers
        without key are dropped.  Values are combined before the shuffle if `how` can (sums,
        counts, extremes); the default gathers a key's objects in one row."""
        def step(s: State) -> State:
            s, key = (s, F.col(s.current)) if by is None else _by(s, by)
            s, v = (s, F.col(s.current)) if value is None else _by(s, value)
            root = ["__root"] if "__root" in s.df.columns else []
            rows = s.df.select(*root, key.alias("key"), v.alias("__v")).where("key IS NOT NULL")
            found = rows.groupBy(*root, "key").agg(how("__v").alias("value"))
            if root:  # within a child traversal one map for each object it started from
                found = found.groupBy("__root").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("__value"))
            return replace(s, df=found, kind="value" if root else "row", attached=False, path=False, tags={})

        return self._then("group", step)

    def groupCount(self, by=None) -> Traversal:
        return self.group(by, how=F.count)

    # branches

    def _expand(self, s: State, child: Traversal, how: str = "inner") -> State:
        """The child's results joined back to the traversers they come from."""
        got = _child(s, child)
        cur = [F.col(got.current), *([F.col("__key")] if got.kind == "property" else [])]
        if got.path:
            cur.append(F.col("__path").alias("__more"))
        right = got.df.select(F.col("__root").alias("__r"), *cur)
        rest = [c for c in s.carried() if c not in ("__path", "__from")]
        left = s.df.select(F.col(s.current).alias("__l"), *(F.col(f"`{c}`") for c in rest), *(["__path"] if s.path else []))
        df = left.join(right, F.col("__l") == F.col("__r"), how).drop("__l", "__r")
        if s.path:
            df = df.withColumn("__path", F.concat("__path", "__more")).drop("__more")
        return replace(s, df=df, kind=got.kind, attached=False)

    def union(self, *children: Traversal) -> Traversal:
        def step(s: State) -> State:
            parts = [self._expand(s, c) for c in children]
            return _union(s, parts)

        return self._then("union" + _paths(children), step)

    def flatMap(self, child: Traversal) -> Traversal:
        return self.union(child)

    def coalesce(self, *children: Traversal) -> Traversal:
        """For each traverser the results of the first child that has any."""
        def step(s: State) -> State:
            parts, left = [], s
            for c in children:
                parts.append(self._expand(left, c))
                hit = _child(left, c).df.select(F.col("__root").alias("__hit")).distinct()
                left = replace(left, df=left.df.join(hit, F.col(left.current) == F.col("__hit"), "left_anti"))
            return _union(s, parts)

        return self._then("coalesce" + _paths(children), step)

    def optional(self, child: Traversal) -> Traversal:
        def step(s: State) -> State:
            hit = _child(s, child).df.select(F.col("__root").alias("__hit")).distinct()
            left = replace(s, df=s.df.join(hit, F.col(s.current) == F.col("__hit"), "left_anti"))
            return _union(s, [self._expand(s, child), left])

        return self._then("optional" + _paths((child,)), step)

    def choose(self, test: Column | Traversal, yes: Traversal, no: Traversal | None = None) -> Traversal:
        def step(s: State) -> State:
            s = s.attach()
            if isinstance(test, Traversal):
                hit = _child(s, test).df.select(F.col("__root").alias("__hit")).distinct()
                split = lambda how: replace(s, df=s.df.join(hit, F.col(s.current) == F.col("__hit"), how))
                a, b = split("left_semi"), split("left_anti")
            else:
                a, b = replace(s, df=s.df.where(test)), replace(s, df=s.df.where(~F.coalesce(test, F.lit(False))))
            return _union(s, [self._expand(a, yes), self._expand(b, no) if no else b])

        return self._then("choose" + _paths((yes, no)), step)

    def branch(self, by: str, options: dict[Any, Traversal]) -> Traversal:
        """The child for the value of a property; other traversers are dropped."""
        def step(s: State) -> State:
            s = s.attach()
            parts = [self._expand(replace(s, df=s.df.where((F.col("p_label") if by == "label" else s.column(by)) == v)), c) for v, c in options.items()]
            return _union(s, parts)

        return self._then("branch" + _paths(tuple(options.values())), step)

    def repeat(self, child: Traversal, times: int | None = None, until: Traversal | Column | None = None, emit: bool | Traversal = False, first: str = "do", max_loops: int | None = None) -> Traversal:
        """repeat(child): `times` rounds, or until a child traversal yields (a column holds);
        first: 'do' tests after a round, 'while' before it; emit: also what each round gives.
        Rounds with a fixed number are one unrolled plan; open ones stop when nothing is left,
        however many rounds that takes, or fail after `max_loops` rounds."""
        def step(s: State) -> State:
            done: list[State] = []

            def settled(now: State) -> State:
                if until is None:
                    return now
                if isinstance(until, Traversal):
                    hit = _child(now, until).df.select(F.col("__root").alias("__hit")).distinct()
                    split = lambda how: replace(now, df=now.df.join(hit, F.col(now.current) == F.col("__hit"), how))
                    done.append(split("left_semi"))
                    return split("left_anti")
                at = now.attach()
                done.append(replace(at, df=at.df.where(until)))
                return replace(at, df=at.df.where(~F.coalesce(until, F.lit(False))))

            now = replace(s, df=s.df.withColumn("__loops", F.lit(0)))
            rounds = times if times is not None else max_loops
            for k in range(rounds) if rounds is not None else count():
                if first == "while":
                    now = settled(now)
                now = child.apply(now)
                now = replace(now, df=now.df.withColumn("__loops", F.lit(k + 1)))
                if emit is not False:
                    done.append(child_filter(now, emit))
                if first == "do":
                    now = settled(now)
                if times is None:
                    if (k + 1) % CUT_EVERY == 0:
                        now = replace(now, df=_cut(now.df))
                    if not now.df.limit(1).count():
                        break
            else:
                if times is None:
                    raise GraphError("repeat() did not end")
                if emit is False or until is not None:
                    done.append(now)
            return _union(now, done) if done else now

        inner = [child, *([until] if isinstance(until, Traversal) else [])]
        return self._then("repeat" + _paths(tuple(inner)), step)

    # side effects and the rest

    def aggregate(self, name: str, by: str | None = None) -> Traversal:
        def step(s: State) -> State:
            at = s.attach() if by else s
            c = at.column(by) if by else F.col(s.current)
            return replace(at, stores=at.stores | {name: at.df.select(c.alias("value")).where("value IS NOT NULL")})

        return self._then("aggregate", step)

    store = aggregate

    def subgraph(self) -> Graph:
        """The edges that came through, and their endpoints."""
        s = self.state()
        ids = s.df.select(F.col("__id").alias("id")).distinct()
        edges = s.graph.edges.join(ids, "id", "left_semi")
        ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
        return s.graph.with_(vertices=s.graph.vertices.join(ends, "id", "left_semi"), edges=edges)

    def sack(self, combine: Callable[[Column, Column], Column] | None = None, by: str | None = None, start: float = 0.0) -> Traversal:
        """Without arguments the sack becomes the value; else it is combined with a property."""
        if combine is None:
            return self._to_value("sack", lambda s: F.col("__sack"), attach=False)

        def step(s: State) -> State:
            s = s.attach()
            old = F.col("__sack") if "__sack" in s.df.columns else F.lit(start)
            return replace(s, df=s.df.withColumn("__sack", combine(old, s.column(by))))

        return self._then("sack", step)

    def withSack(self, value: float) -> Traversal:
        return self._then("withSack", lambda s: replace(s, df=s.df.withColumn("__sack", F.lit(value))))

    def match(self, *patterns: tuple[str, Traversal, str]) -> Traversal:
        """Patterns (a, traversal, b): binding joins on shared names; gives rows of tags."""
        def step(s: State) -> State:
            out, bound = s.df.select(F.col(s.current).alias(patterns[0][0])).distinct(), {patterns[0][0]}
            kinds = {patterns[0][0]: s.kind}
            for a, t, b in patterns:
                if a not in bound:
                    raise GraphError(f"{a} is not bound yet")
                ids = out.select(F.col(a).alias("__id" if kinds[a] in ("vertex", "edge") else "__value")).distinct()
                got = _child(replace(s, df=ids, kind=kinds[a], attached=False, path=False, tags={}), t)
                pairs = got.df.select(F.col("__root").alias(a), F.col(got.current).alias("__b" if b in bound else b))
                out = out.join(pairs, a)
                if b in bound:
                    out = out.where(F.col("__b") == F.col(b)).drop("__b")
                bound.add(b)
                kinds[b] = got.kind
            return replace(s, df=out, kind="row", attached=False, path=False, tags={})

        return self._then("match", step)

    def drop(self) -> Graph:
        from ..operators import mutate

        s = self.state()
        ids = s.df.select(F.col("__id").alias("id"))
        return mutate.remove_vertices(s.graph, ids) if s.kind == "vertex" else mutate.remove_edges(s.graph, ids)

    def property(self, key: str, value) -> Graph:
        from ..operators import mutate

        s = self.state()
        value = value if isinstance(value, Column) else F.lit(value)
        return mutate.set_property(s.graph, s.kind, key, s.df.select(F.col("__id").alias("id"), value.alias("value")).distinct())

    def addV(self, label: str = "vertex", **properties) -> Graph:
        """A new vertex, or one for each traverser; ids are random unless given."""
        from ..operators import mutate

        rows = self.state().df if self.steps else self.graph.spark.range(1)
        return mutate.add_vertices(self.graph, rows.select(F.lit(label).alias("label"), *(F.lit(v).alias(k) for k, v in properties.items())))

    def mergeV(self, match: dict[str, Any], on_create: dict[str, Any] | None = None, on_match: dict[str, Any] | None = None) -> Graph:
        """Sets `on_match` on the vertices that agree with `match`; without any, adds one."""
        from ..operators import mutate

        batch = self.graph.spark.range(1).select(*(F.lit(v).alias(k) for k, v in {**match, **(on_create or {})}.items()))
        return mutate.merge_vertices(self.graph, batch, list(match), {k: F.lit(v) for k, v in (on_match or {}).items()})

    def mergeE(self, label: str, src, dst, **properties) -> Graph:
        """Sets the properties of the edges of this label between two vertices, or adds one."""
        from ..operators import mutate

        values = {"label": label, "src": src, "dst": dst, **properties}
        return mutate.merge_edges(self.graph, self.graph.spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())))

    def addE(self, label: str, to: Traversal, **properties) -> Graph:
        """An edge from each vertex to each result of the child; ids are random."""
        from ..operators import mutate

        s = self.state()
        got = _child(s, to)
        pairs = s.df.select(F.col("__id").alias("__root")).join(got.df.select("__root", F.col("__id").alias("dst")), "__root")
        batch = pairs.select(F.lit(label).alias("label"), F.col("__root").alias("src"), "dst", *(F.lit(v).alias(k) for k, v in properties.items()))
        return mutate.add_edges(s.graph, batch)


def _by(s: State, by: str | Column | Traversal) -> tuple[State, Column]:
    """The state, and the column that a by-modulator stands for: a property, `label`, `id`,
    an expression, or the first result of a child traversal (null if it has none)."""
    if isinstance(by, Column):
        return s.attach(), by
    if isinstance(by, Traversal):
        got = _child(s, by)
        name = f"__by{sum(c.startswith('__by') for c in s.df.columns)}"
        first = got.df.groupBy(F.col("__root").alias("__r")).agg(F.min(got.current).alias(name))
        return replace(s, df=s.df.join(first, F.col(s.current) == F.col("__r"), "left").drop("__r")), F.col(name)
    s = s.attach()
    return s, F.col("__id") if by == "id" else F.col("p_label") if by == "label" else s.column(by)


def _paths(children) -> str:
    return ":path" if any(c is not None and c._needs_path() for c in children) else ""


def _cut(df: DataFrame) -> DataFrame:
    from ..storage import cut

    return cut(df)


def _child(s: State, child: Traversal) -> State:
    """Runs an anonymous traversal on the distinct current objects, which stay as __root."""
    ids = s.df.select(F.col(s.current)).distinct().withColumn("__root", F.col(s.current))
    if "__loops" in s.df.columns:
        ids = s.df.select(F.col(s.current), "__loops").distinct().withColumn("__root", F.col(s.current))
    roots = ids.select("__root").distinct()
    inner = replace(s, df=ids, attached=False, tags={}, roots=roots, path=s.path or child._needs_path())
    if inner.path:
        inner = replace(inner, df=inner.df.withColumn("__path", F.array().cast("array<string>")))
    return child.apply(inner)


def child_filter(s: State, test: bool | Traversal) -> State:
    if test is True:
        return s
    hit = _child(s, test).df.select(F.col("__root").alias("__hit")).distinct()
    return replace(s, df=s.df.join(hit, F.col(s.current) == F.col("__hit"), "left_semi"))


def _union(s: State, parts: list[State]) -> State:
    kinds = {p.kind for p in parts}
    if len(kinds) > 1:
        parts = [replace(p, df=p.df.withColumn("__value", F.col(p.current).cast("string")), kind="value") for p in parts]
    kind = parts[0].kind
    columns = ["__id" if kind in ("vertex", "edge") else "__value"]
    common = [c for c in parts[0].carried() if all(c in p.df.columns for p in parts)]
    df = parts[0].df.select(*columns, *(F.col(f"`{c}`") for c in common))
    for p in parts[1:]:
        df = df.unionByName(p.df.select(*columns, *(F.col(f"`{c}`") for c in common)))
    return replace(s, df=df, kind=kind, attached=False)


class _Anonymous:
    """`__.out('x')` starts a child traversal."""

    def __getattr__(self, name: str):
        return getattr(Traversal(), name)


__ = _Anonymous()
