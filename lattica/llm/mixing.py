r"""Operator 6, mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all
words; a target stops at twice its source's size and what is cut off is shared again by
weight.  That water level has a closed form over the sources sorted by cap / weight.  Each
document draws an exponential key -ln(u) / w, where u is a hash of seed and id and w the
document's quality weight; small keys come first.  A source first takes every document in
whole epochs (target // size), then documents in key order until the rest of the budget is
spent; the document on the boundary is taken in part (its first words).

The prefix sums over a source are split: keys fall into buckets that keep their order,
bucket totals are summed along the source, and each bucket sums its own rows.  A bucket
has about the square root of the source's rows, so a source with a third of all rows is
spread over many tasks.

Edge cases: null or empty text has size 0 and takes 0 words; a null source is a source of
its own; a source without words has target 0; repeated ids draw the same key and are told
apart by size (equal rows are interchangeable); null ids draw by their text; an empty table
gives an empty result; all columns are renamed inside, so extra columns never clash.
The water level is found over one row a source, in one task: sources are names, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Least rows of a bucket of keys.
BUCKET_ROWS = 500
#: Quality weight of documents labelled good, labelled bad, and without label.
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}
WORD = r"[^\x20\x09-\x0D]+"


def lot(id: Column, text: Column) -> Column:
    """What a document draws by: its id, or its text if it has none."""
    return F.coalesce(id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def unit(lot: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that only seed and lot decide."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), lot).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """__source, __words -> also __target; one row per source."""
    order = W.orderBy(F.col("__source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    capped = sources.withColumn("__w", weight).withColumn("__cap", (F.col("__words") * cap).cast("double"))
    fill = W.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    upto = fill.rowsBetween(W.unboundedPreceding, -1)
    rest = fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("__words").over(W.partitionBy()) * share - F.coalesce(F.sum("__cap").over(upto), F.lit(0.0))) / F.sum("__w").over(rest)
    # a source is full when the level at its turn reaches its cap; the first that is not sets the level
    turn = capped.withColumn("__level", level).withColumn("__full", F.col("__level") >= F.col("__cap") / F.col("__w"))
    final = F.max(F.when(~F.col("__full"), F.col("__level"))).over(W.partitionBy())
    return turn.withColumn("__target", F.when(F.col("__full"), F.col("__cap")).otherwise(F.least("__cap", F.col("__w") * final)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (__id, __source, __size, __lot); texts are left behind."""
    return docs.select(F.col(id).alias("__id"), F.col(source).alias("__source"), word_count(F.col(text)).alias("__size"), lot(F.col(id), F.col(text)).alias("__lot"))


def quality(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """`rows` with __quality, the weight of the label of their id."""
    own = labels.groupBy(F.col("doc_id").alias("__l")).agg(F.max("quality").alias("__label"))
    weight = F.lit(QUALITY[None])
    for k in (0, 1):
        weight = F.when(F.col("__label") == k, F.lit(QUALITY[k])).otherwise(weight)
    return rows.join(own, F.col("__id") == F.col("__l"), "left").select("__id", "__source", "__size", "__lot", weight.alias("__quality"))


def mix(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows (__id, __source, __size, __lot, __quality) -> (__id, __source, __size, __lot, __words,
    __target, __taken), one per document."""
    sized = C.shared_table(rows.withColumn("__key", -F.log(unit(F.col("__lot"), seed)) / F.col("__quality")))
    sources = sized.groupBy("__source").agg(F.sum("__size").alias("__words"), F.count("*").alias("__rows"))
    per_source = targets(sources).select("__source", "__words", "__target", F.greatest(F.lit(1), F.ceil(F.col("__rows") / F.greatest(F.lit(float(BUCKET_ROWS)), F.sqrt(F.col("__rows").cast("double"))))).alias("__buckets"), F.when(F.col("__words") > 0, F.floor(F.col("__target") / F.col("__words"))).otherwise(0).alias("__epochs"))
    per_source = C.shared_table(per_source.withColumn("__rest", F.floor(F.col("__target") - F.col("__epochs") * F.col("__words"))))
    joined = sized.join(per_source.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    dealt = joined.withColumn("__bucket", F.least(F.floor((1 - F.exp(-F.col("__key"))) * F.col("__buckets")), F.col("__buckets") - 1))
    totals = dealt.groupBy("__source", "__bucket").agg(F.sum("__size").alias("__sum"))
    before = W.partitionBy("__source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(F.col("__source").alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inner = W.partitionBy("__source", "__bucket").orderBy("__key", "__id", "__size").rowsBetween(W.unboundedPreceding, 0)
    run = dealt.withColumn("__run", F.sum("__size").over(inner))
    placed = run.join(bases, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    extra = F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__rest") - (F.col("__base") + F.col("__run") - F.col("__size"))))
    return placed.select("__id", "__source", "__size", "__lot", "__words", "__target", (F.col("__epochs") * F.col("__size") + extra).cast("long").alias("__taken"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(quality(sized(C.table(spark, sf_dir, "documents")), C.table(spark, sf_dir, "labels")))
    return mixed.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__words").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


SQL = r"""
WITH l AS (SELECT doc_id AS l_id, max(quality) AS q FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        -ln((CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)
          / CASE q WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END AS k
      FROM documents LEFT JOIN l ON doc_id = l_id),
s AS (SELECT source, sum(size) AS words FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w, (2 * words)::DOUBLE AS cap FROM s),
t AS (SELECT *, (1.5 * sum(words) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, level >= cap / w AS is_full, max(CASE WHEN level < cap / w THEN level END) OVER () AS final FROM t),
g AS (SELECT source, words, CASE WHEN is_full THEN cap ELSE least(cap, w * final) END AS target FROM f),
e AS (SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END AS epochs FROM g),
r AS (SELECT d.doc_id, d.size, e.words, e.target, e.epochs, floor(e.target - e.epochs * e.words) AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, CAST(words AS BIGINT) AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - (run - size))) AS BIGINT) AS taken
FROM r
"""
