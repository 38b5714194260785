"""Operator 5, sharding by global prefix sums of byte sizes.

Only (id, size, checksum) rows move: they are range-partitioned by id and written with
their partition number, each partition's totals are prefix-summed (as many rows as
partitions), and a running sum inside each partition gives every document its place in
the global order.  A document belongs to the shard in which the middle of its byte range
falls, so shards are contiguous in id order and differ by less than the largest document.
The law is `bytes`; equal texts are not kept together, for contiguity in id order decides.

Edge cases: a null text has size 1 and checksum 0; null ids come first; repeated rows are
separate documents (equal rows are interchangeable); an empty table gives an empty result;
fewer documents than shards leave some shards empty.  Columns are renamed internally, so
clashing extra columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

SHARDS = 16


def shard_plan(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Rows (__id, __size, __crc, __shard, __slot), one per document."""
    spark = docs.sparkSession
    sized = docs.select(F.col(id).alias("__id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("__size"), F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0).cast("long")).alias("__crc"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = C.shared_table(sized.repartitionByRange(parts, "__id", "__crc").withColumn("__part", F.spark_partition_id()))
    totals = placed.groupBy("__part").agg(F.sum("__size").alias("__bytes"), F.count("*").alias("__rows"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__base"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rank0"), F.sum("__bytes").over(W.partitionBy()).alias("__total"))
    inner = W.partitionBy("__part").orderBy(F.col("__id").asc_nulls_first(), "__crc", "__size")
    running = placed.select("*", F.sum("__size").over(inner.rowsBetween(W.unboundedPreceding, 0)).alias("__run"), F.row_number().over(inner).alias("__n"))
    # one row per partition: bounded by the number of partitions, which is a setting
    middle = F.expr(f"((2 * (__base + __run) - __size) * {shards}) div (2 * __total)")
    ranked = running.join(F.broadcast(offsets), "__part").select("__id", "__size", "__crc", F.least(middle, F.lit(shards - 1)).cast("int").alias("__shard"), (F.col("__rank0") + F.col("__n")).alias("__rank"))
    first = ranked.groupBy("__shard").agg(F.min("__rank").alias("__first"))
    return ranked.join(F.broadcast(first), "__shard").select("__id", "__size", "__crc", "__shard", (F.col("__rank") - F.col("__first")).alias("__slot"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = shard_plan(C.table(spark, sf_dir, "documents"))
    return plan.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 of a text's UTF-8 bytes in DuckDB, with the table of the reflected polynomial.
_CODES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))"
_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
SQL = f"""
WITH t AS (SELECT {_TABLE} AS crc),
s AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
       CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, {_CODES}), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM documents, t),
r AS (SELECT *, sum(size) OVER o AS run, sum(size) OVER () AS total FROM s WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, CAST(least((2 * run - size) * {SHARDS} // (2 * total), {SHARDS - 1}) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM h
"""
