"""The pipeline's stages, each on its own input."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lattica.llm import common, decontaminate, mixing

from ..conftest import DATA
from .test_ops import ODD, SCHEMA, UP, brute_groups, near_rows

NAMES = ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing", "sharding"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_stages_and_columns(spark, docs):
    assert [n for n, _ in P.STAGES] == NAMES
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_language_keeps_whatever_has_one(spark, docs):
    out = P.language(spark, docs, DATA)
    gone = docs.join(out.select("doc_id"), "doc_id", "left_anti").collect()
    assert len(gone) <= 0.01 * docs.count()
    odd = spark.createDataFrame([(500, "12 34 ... !!", "en", "s", 1), (501, None, "en", "s", 1), (502, "", "de", "s", 1)], SCHEMA)
    left = {r.doc_id for r in P.language(spark, docs.unionByName(odd), DATA).select("doc_id").collect()}
    assert not left & {500, 501, 502}


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = near_rows(60)
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = sorted(r.doc_id for r in P.near_dedup(spark, table, DATA).collect())
    assert got == sorted(i for i, (_, c) in brute_groups(rows, 5).items() if c == i)


def test_near_dedup_of_repeated_rows(spark):
    text, other = " ".join(f"w{k}" for k in range(50)), " ".join(f"o{k}" for k in range(50))
    rows = [(1, text), (1, text), (2, text), (3, other), (3, other), (4, "x y"), (4, "z"), (None, text), (None, text)]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = collections.Counter((r.doc_id, r.text) for r in P.near_dedup(spark, table, DATA).collect())
    assert got == {(1, text): 1, (3, other): 1, (4, "x y"): 1, (4, "z"): 1, (None, text): 2}


def test_decontamination_removes_exactly_the_hit(spark, docs):
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
    windows = set()
    for t in items:
        w = words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    clean = {r.doc_id for r in docs.collect() if not any(tuple(w[k : k + n]) in windows for w in [words(r.text)] for n in sizes for k in range(len(w) - n + 1))}
    assert {r.doc_id for r in P.clean(spark, docs, DATA).collect()} == clean
    assert decontaminate.WINDOW == 10


def test_mixing_repeats_as_often_as_taken(spark, docs):
    got = collections.Counter(r.doc_id for r in P.mix(spark, docs, DATA).collect())
    rows = mixing.mix(mixing.quality(mixing.sized(docs), common.table(spark, DATA, "labels"))).collect()
    assert got == collections.Counter({r["__id"]: -(-r["__taken"] // r["__size"]) for r in rows if r["__taken"] > 0})


def test_mixing_of_repeated_rows(spark):
    rows = [(i % 40 if i % 3 else None, " ".join(["w"] * (1 + i % 4)), "en", "ab"[i % 2], 1) for i in range(160)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = collections.Counter((r.doc_id, r.text, r.source) for r in P.mix(spark, table, DATA).collect())
    mixed = mixing.mix(mixing.quality(mixing.sized(table), common.table(spark, DATA, "labels"))).collect()
    want = collections.Counter()
    for r in mixed:
        want[r["__id"], " ".join(["w"] * r["__size"]), r["__source"]] += -(-r["__taken"] // r["__size"])
    assert got == want


def test_clashing_columns_are_carried(spark, docs):
    names = ("__lang", "__score", "__n_words", "__n_hit", "__id", "__k", "__s", "__gone", "__copy", "id", "gone", "n", "size", "shard")
    table = docs.limit(60).withColumns({c: F.lit(c) for c in names})
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, table, DATA)
        assert out.columns == table.columns and all(r[c] == c for r in out.limit(5).collect() for c in names)
    assert P.shard(spark, table, DATA).count() == 60


def test_odd_rows_and_whole_run(spark, docs, tmp_path):
    odd = spark.createDataFrame(ODD, SCHEMA)
    for table in (odd, odd.limit(0)):
        for _, stage in P.STAGES:
            stage(spark, table, DATA).count()
    out = P.run(spark, DATA)
    n = out.agg(F.count("*"), F.sum("slot")).first()
    per = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert n[0] == sum(per) and n[1] == sum(x * (x - 1) // 2 for x in per)
