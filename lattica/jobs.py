"""Batch jobs on a saved graph: populate or drop an index.

python -m lattica.jobs populate --graph PATH --type vertex --label a --key k [--unique] --out PATH
python -m lattica.jobs drop --graph PATH --type vertex --label a --key k --out PATH

The catalog lies beside the graph (`<graph>/catalog`); a job moves the index through its
states and writes the catalog only when it succeeded, so a failed job can be run again."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .errors import NotFound
from .operators import lookup as L
from .operators.catalog import Catalog, Index, Label
from .sources import files


def save_catalog(spark: SparkSession, catalog: Catalog, path: str) -> None:
    for name, table in catalog.tables(spark).items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_catalog(spark: SparkSession, path: str, use_schema: bool = False) -> Catalog:
    read = lambda name: spark.read.parquet(f"{path}/{name}").collect()
    indices = [Index(r.type, r.label, r.property_key, r.is_unique, r.state, r.created_at, r.updated_at) for r in read("indices")]
    labels = [Label(r.type, r.label, r.id_type, r.properties, r.created_at, r.updated_at) for r in read("labels")]
    return Catalog(use_schema, {(x.kind, x.label, x.key): x for x in indices}, {(x.kind, x.name): x for x in labels}, frozenset((r.out_label, r.edge_label, r.in_label) for r in read("connections")))


def populate(spark: SparkSession, graph: str, kind: str, label: str, key: str, out: str, unique: bool = False) -> int:
    """Makes the index if it is not there; returns its rows."""
    catalog = load_catalog(spark, f"{graph}/catalog")
    if (kind, label, key) not in catalog.indices or catalog.indices[kind, label, key].state == "DROPPED":
        catalog = catalog.create_index(kind, label, key, unique)
    done, index = L.build_index(files.load(spark, graph, catalog=catalog), kind, label, key, out)
    save_catalog(spark, done.catalog, f"{graph}/catalog")
    return index.count()


def drop(spark: SparkSession, graph: str, kind: str, label: str, key: str, out: str) -> None:
    catalog = load_catalog(spark, f"{graph}/catalog")
    if (kind, label, key) not in catalog.indices:
        raise NotFound(f"no index on {kind} {label}.{key}")
    done = L.drop_index(files.load(spark, graph, catalog=catalog), kind, label, key)
    place = spark._jvm.org.apache.hadoop.fs.Path(out)  # any file system that Spark reads
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    save_catalog(spark, done.catalog, f"{graph}/catalog")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("job", choices=["populate", "drop"])
    for name in ("graph", "label", "key", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--type", choices=["vertex", "edge"], default="vertex")
    p.add_argument("--unique", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.job == "populate":
        print(populate(spark, a.graph, a.type, a.label, a.key, a.out, a.unique))
    else:
        drop(spark, a.graph, a.type, a.label, a.key, a.out)


if __name__ == "__main__":
    main()
