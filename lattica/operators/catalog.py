"""Schema and index metadata: labels, connections, index states, and batch validation."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from time import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoSchema, NotFound, NotUnique, NotValid

CREATED, BUILDING, ACTIVE, INACTIVE, DROPPED = "CREATED", "BUILDING", "ACTIVE", "INACTIVE", "DROPPED"
ANY, COUNTER = "any", "counter"
#: States to which an index may not go, by the state in which it is.
FORBIDDEN = {
    CREATED: set(),
    BUILDING: {CREATED},
    ACTIVE: {CREATED},
    INACTIVE: {CREATED, BUILDING, ACTIVE},
    DROPPED: {BUILDING, ACTIVE, INACTIVE, DROPPED},
}
#: States in which an index serves an operation.
VISIBLE = {"read": {ACTIVE}, "write": {CREATED, BUILDING, ACTIVE}, "remove": {CREATED, BUILDING, ACTIVE, INACTIVE}}


@dataclass(frozen=True)
class Index:
    kind: str
    label: str
    key: str
    unique: bool = False
    state: str = CREATED
    created_at: float = 0.0
    updated_at: float = 0.0


@dataclass(frozen=True)
class Label:
    kind: str
    name: str
    id_type: str
    properties: dict[str, str]
    created_at: float = 0.0
    updated_at: float = 0.0


@dataclass(frozen=True)
class Catalog:
    use_schema: bool = False
    indices: dict[tuple[str, str, str], Index] = field(default_factory=dict)
    labels: dict[tuple[str, str], Label] = field(default_factory=dict)
    connections: frozenset[tuple[str, str, str]] = frozenset()

    # indices

    def create_index(self, kind: str, label: str, key: str, unique: bool = False, populate: bool = True) -> Catalog:
        """A dropped index may be made again; without populating it is active at once."""
        old = self.indices.get((kind, label, key))
        if old and old.state != DROPPED:
            raise NotUnique(f"index on {kind} {label}.{key} exists")
        if self.use_schema:
            declared = self.label(kind, label).properties
            if key not in declared or declared[key] == COUNTER:
                raise NotValid(f"{label}.{key} can't be indexed")
        now = time()
        state = CREATED if populate else ACTIVE
        return replace(self, indices=self.indices | {(kind, label, key): Index(kind, label, key, unique, state, now, now)})

    def set_state(self, kind: str, label: str, key: str, state: str) -> Catalog:
        old = self.indices.get((kind, label, key))
        if old is None:
            raise NotFound(f"no index on {kind} {label}.{key}")
        if state in FORBIDDEN[old.state]:
            raise NotValid(f"index on {label}.{key} can't go from {old.state} to {state}")
        return replace(self, indices=self.indices | {(kind, label, key): replace(old, state=state, updated_at=time())})

    def index(self, kind: str, label: str, key: str, operation: str = "read") -> Index | None:
        found = self.indices.get((kind, label, key))
        return found if found and found.state in VISIBLE[operation] else None

    def list_indices(self, kind: str | None = None, operation: str | None = None) -> list[Index]:
        return [x for x in self.indices.values() if kind in (None, x.kind) and (operation is None or x.state in VISIBLE[operation])]

    def delete_index(self, kind: str, label: str, key: str) -> Catalog:
        return replace(self, indices={k: v for k, v in self.indices.items() if k != (kind, label, key)})

    # labels

    def _schema(self) -> None:
        if not self.use_schema:
            raise NoSchema("this graph has no schema")

    def create_label(self, kind: str, name: str, id_type: str = ANY, **properties: str) -> Catalog:
        self._schema()
        if (kind, name) in self.labels:
            raise NotUnique(f"label {name} exists")
        now = time()
        return replace(self, labels=self.labels | {(kind, name): Label(kind, name, id_type, properties, now, now)})

    def update_label(self, kind: str, name: str, **properties: str) -> Catalog:
        """Properties can be added, never changed or taken away."""
        old = self.label(kind, name)
        for key in properties:
            if key in old.properties:
                raise NotUnique(f"{name}.{key} is declared")
        return replace(self, labels=self.labels | {(kind, name): replace(old, properties=old.properties | properties, updated_at=time())})

    def label(self, kind: str, name: str) -> Label:
        self._schema()
        if (kind, name) not in self.labels:
            raise NotValid(f"no {kind} label {name}")
        return self.labels[kind, name]

    def connect(self, out_label: str, edge_label: str, in_label: str) -> Catalog:
        self._schema()
        self.label("vertex", in_label), self.label("edge", edge_label), self.label("vertex", out_label)
        if (out_label, edge_label, in_label) in self.connections:
            raise NotUnique("labels are connected")
        return replace(self, connections=self.connections | {(out_label, edge_label, in_label)})

    def delete_label(self, kind: str, name: str) -> Catalog:
        return replace(self, labels={k: v for k, v in self.labels.items() if k != (kind, name)})

    def disconnect(self, out_label: str, edge_label: str, in_label: str) -> Catalog:
        return replace(self, connections=self.connections - {(out_label, edge_label, in_label)})

    def tables(self, spark) -> dict[str, DataFrame]:
        """The catalog as three small DataFrames."""
        index = [(x.kind, x.label, x.key, x.unique, x.state, x.created_at, x.updated_at) for x in self.indices.values()]
        label = [(x.kind, x.name, x.id_type, x.properties, x.created_at, x.updated_at) for x in self.labels.values()]
        return {
            "indices": spark.createDataFrame(index, "type string, label string, property_key string, is_unique boolean, state string, created_at double, updated_at double"),
            "labels": spark.createDataFrame(label, "type string, label string, id_type string, properties map<string,string>, created_at double, updated_at double"),
            "connections": spark.createDataFrame(sorted(self.connections), "out_label string, edge_label string, in_label string"),
        }

    # batch validation

    def check_types(self, kind: str, rows: DataFrame, meta: tuple[str, ...]) -> None:
        """Column types of a batch against the declared types of its labels.  Reads the
        distinct labels of the batch and which of its columns each of them fills."""
        self._schema()
        keys = [c for c in rows.columns if c not in meta]
        used = rows.groupBy("label").agg(F.count("*").alias("__n"), *(F.count(F.col(f"`{k}`")).alias(k) for k in keys)).collect()
        types = dict(rows.dtypes)
        for r in used:
            label = self.label(kind, r["label"])
            if label.id_type not in (ANY, types["id"]):
                raise NotValid(f"id of {label.name} is {types['id']}, not {label.id_type}")
            for k in keys:
                if not r[k]:
                    continue
                want = label.properties.get(k)
                if want is None:
                    raise NotValid(f"{label.name} has no property {k}")
                if want != ANY and types[k] != ("bigint" if want == COUNTER else want):
                    raise NotValid(f"{label.name}.{k} is {types[k]}, not {want}")

    def check_connections(self, edges: DataFrame, vertices: DataFrame) -> None:
        """Endpoint labels of a batch of edges: in label, edge label, out label, connection."""
        self._schema()
        src, dst = (vertices.select(F.col("id").alias(k), F.col("label").alias(f"{k}_label")) for k in ("src", "dst"))
        triples = edges.join(src, "src", "left").join(dst, "dst", "left").groupBy("src_label", "label", "dst_label").count().collect()
        for t in triples:
            if t.src_label is None or t.dst_label is None:
                raise NotFound("an endpoint does not exist")
            self.label("vertex", t.dst_label), self.label("edge", t.label), self.label("vertex", t.src_label)
            if (t.src_label, t.label, t.dst_label) not in self.connections:
                raise NotValid(f"{t.src_label} -{t.label}-> {t.dst_label} is not permitted")
