"""Index jobs on saved graphs, and streams."""

import pytest

from lattica import jobs
from lattica.errors import NotUnique
from lattica.operators.catalog import Catalog
from lattica.sources import files, toys
from lattica.streaming import changes

from .conftest import DATA


def test_populate_and_drop(spark, tmp_path):
    g, path = toys.modern(spark), str(tmp_path / "g")
    files.save(g, path)
    jobs.save_catalog(spark, Catalog(), f"{path}/catalog")
    assert jobs.populate(spark, path, "vertex", "person", "age", str(tmp_path / "i")) == 4
    assert jobs.load_catalog(spark, f"{path}/catalog").index("vertex", "person", "age").state == "ACTIVE"
    assert jobs.populate(spark, path, "edge", "created", "weight", str(tmp_path / "e")) == 4
    with pytest.raises(NotUnique):
        jobs.populate(spark, path, "vertex", "software", "lang", str(tmp_path / "u"), unique=True)
    assert ("vertex", "software", "lang") not in jobs.load_catalog(spark, f"{path}/catalog").indices
    jobs.drop(spark, path, "vertex", "person", "age", str(tmp_path / "i"))
    assert not (tmp_path / "i").exists() and jobs.load_catalog(spark, f"{path}/catalog").index("vertex", "person", "age") is None


def test_streams_equal_batches(spark, tmp_path):
    static = spark.read.parquet(f"{DATA}/events.parquet")
    src = tmp_path / "src"
    static.repartition(3).write.parquet(str(src))
    ddl = ", ".join(f"{c} {t}" for c, t in static.dtypes)
    stream = changes.read_events(spark, str(src), ddl)
    q = changes.keep_counters(stream, str(tmp_path / "c"), str(tmp_path / "k"))
    q.awaitTermination(120)
    got = {r.id: r.value for r in changes.counters(spark, str(tmp_path / "c")).collect()}
    assert got == {r.user_id: r["count"] for r in static.groupBy("user_id").count().collect()}
    out = changes.windowed_counts(stream, "1 day", "3650 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert spark.table("w").agg({"n": "sum"}).first()[0] == static.count()
    assert changes.next_user_edges(static).count() == static.count() - static.select("event_type").distinct().count()
