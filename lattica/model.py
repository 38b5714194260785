"""The property graph: two lazy DataFrames and a catalog.

`vertices(id, label, <properties>)` and `edges(id, label, src, dst, <properties>)`; a missing
property is null.  A Graph is an immutable value: every change gives a new Graph, whose
plans are extended and not executed.  Properties may also live in one map column
(`to_map_layout`), which suits schemaless data with many sparse keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.catalog import Catalog

V_META = ("id", "label")
E_META = ("id", "label", "src", "dst")
STAMPS = ("created_at", "updated_at")


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    catalog: Catalog = field(default_factory=Catalog)
    #: Keep neighbours whose vertex row is missing (left join) or drop them (inner join).
    keep_dangling: bool = False
    #: Every endpoint is known to exist, so hops need not look; unchecked edges clear it.
    intact: bool = True

    @property
    def spark(self):
        return self.vertices.sparkSession

    def with_(self, **changes) -> Graph:
        return replace(self, **changes)

    def vertex_keys(self) -> list[str]:
        return [c for c in self.vertices.columns if c not in (*V_META, *STAMPS)]

    def edge_keys(self) -> list[str]:
        return [c for c in self.edges.columns if c not in (*E_META, *STAMPS)]

    def incidence(self, direction: str = "both", *labels: str) -> DataFrame:
        """Rows (v, dir, other, edge, label, <edge properties>): an edge once per endpoint.
        Only the branch that is asked for is read; a self-loop has a row in both."""
        e = self.edges.where(F.col("label").isin(*labels)) if labels else self.edges
        rest = [F.col("id").alias("edge"), "label", *(F.col(f"`{c}`") for c in self.edge_keys())]
        out = e.select(F.col("src").alias("v"), F.lit("OUT").alias("dir"), F.col("dst").alias("other"), *rest)
        into = e.select(F.col("dst").alias("v"), F.lit("IN").alias("dir"), F.col("src").alias("other"), *rest)
        return {"out": out, "in": into, "both": out.unionByName(into)}[direction.lower()]

    def alive(self, ttl_seconds: int | None, now: Column | None = None, kind: str = "vertices") -> Graph:
        """The graph without elements last updated longer ago than the time to live."""
        if ttl_seconds is None:
            return self
        now = F.current_timestamp() if now is None else now
        rows = getattr(self, kind)
        return self.with_(**{kind: rows.where(F.col("updated_at") > now - F.make_interval(secs=F.lit(float(ttl_seconds))))})

    def persist(self) -> Graph:
        return self.with_(vertices=self.vertices.persist(), edges=self.edges.persist())

    def V(self, *ids):
        from .plans.traversal import Traversal

        return Traversal(self).V(*ids)

    def inject(self, *values):
        from .plans.traversal import Traversal

        return Traversal(self).inject(*values)

    def E(self, *ids):
        from .plans.traversal import Traversal

        return Traversal(self).E(*ids)


def to_map_layout(elements: DataFrame, meta: tuple[str, ...] = V_META) -> DataFrame:
    """Wide property columns -> one column `props` of key and text value, nulls left out."""
    keys = [c for c in elements.columns if c not in (*meta, *STAMPS)]
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"`{k}`").cast("string").alias("value")) for k in keys))
    held = F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))
    return elements.select(*meta, *(c for c in STAMPS if c in elements.columns), held.alias("props"))


def to_wide_layout(elements: DataFrame, types: dict[str, str]) -> DataFrame:
    """The inverse, for declared keys and types."""
    rest = [c for c in elements.columns if c != "props"]
    return elements.select(*rest, *(F.col("props")[k].cast(t).alias(k) for k, t in types.items()))
