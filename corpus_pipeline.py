"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and
returns a DataFrame; all but the last return the columns of `documents`.  Other tables of
`sf_dir` serve as reference data: `benchmark` for decontamination, `labels` for quality
weights.  Rows that a stage drops: no letter at all, or no language with a
probability of 0.35 (1); all but the smallest id of a group of near-duplicates, which are
documents whose sets of 5-word shingles have a similarity of 0.8 or more, or links of such
(2); documents that hold any window of the benchmark (3); documents of which the mix takes
no word (4, which also repeats those that it takes more than once).  The last stage adds
size, shard and slot.

Odd rows: a null or empty text has no language and goes in stage 1; given to a later stage
alone, it is near nothing, clean, of size 0 (the mix takes none of it) and of one byte.  A
null language or source is a value like others; rows with a null id are near nothing and
stay.  Equal rows are one document in stage 2 and share what the mix takes of them in stage
4; rows that share only the id stay or go together in stage 2.  Ties go to the smallest id.
Very long texts are worked on whole.  Empty tables give empty results.  Columns other than
doc_id, text, lang and source are carried along under their names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import common, decontaminate, langid, mixing, neardup, shards

#: Least probability of the predicted language; texts of a word or two are often near 0.5
#: and stay, what no language claims goes.
LEAST_SCORE = 0.35
#: Words of a shingle of the near-duplicate stage.
SHINGLE_WORDS = 5
#: No SQL expresses a trained network or a randomised join; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; a text without letters has none."""
    p = common.fresh(docs.columns)
    found = langid.predict(docs, langid.train(docs), prefix=p)
    return _columns(found.where((F.col(f"{p}lang") != "und") & (F.col(f"{p}score") >= LEAST_SCORE)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    p = common.fresh(docs.columns)
    found = neardup.near_duplicates(docs.select("doc_id", "text"), words=SHINGLE_WORDS).where("__id IS NOT NULL")
    marks = found.groupBy(F.col("__id").alias(f"{p}id")).agg(F.max(F.col("__id") != F.col("__component")).alias("gone"), F.count("*").alias("n")).where("gone OR n > 1")
    marks = common.shared_table(marks)
    own = docs["doc_id"] == F.col(f"{p}id")
    left = docs.join(marks.where("gone").select(f"{p}id"), own, "left_anti")
    twice = marks.where("NOT gone").select(f"{p}id")
    if not twice.limit(1).count():
        return left
    return left.join(twice, own, "left_anti").union(left.join(twice, own, "left_semi").dropDuplicates(["doc_id", "text"]))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one taken in part is there as a whole."""
    p = common.fresh(docs.columns)
    # rows that are alike in lot, source and size share the copies that they get together
    key = lambda lot, source, size: F.concat_ws("|", lot, size, F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    mixed = mixing.mix(mixing.quality(mixing.sized(docs), common.table(spark, sf_dir, "labels"))).where("__size > 0")
    times = F.ceil(F.col("__taken") / F.col("__size"))
    shares = mixed.groupBy(key(F.col("__lot"), F.col("__source"), F.col("__size")).alias(f"{p}k")).agg(F.sum(times).alias(f"{p}sum"), F.count("*").alias(f"{p}n")).where(F.col(f"{p}sum") > 0)
    keyed = docs.withColumn(f"{p}k", key(mixing.lot(F.col("doc_id"), F.col("text")), F.col("source"), mixing.word_count(F.col("text"))))
    turn = F.row_number().over(Window.partitionBy(f"{p}k").orderBy(F.xxhash64("text")))
    joined = keyed.join(shares, f"{p}k").withColumn(f"{p}turn", turn)
    copies = F.floor(F.col(f"{p}sum") / F.col(f"{p}n")) + (F.col(f"{p}turn") <= F.col(f"{p}sum") % F.col(f"{p}n")).cast("long")
    return _columns(joined.withColumn(f"{p}c", copies).where(F.col(f"{p}c") > 0).withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{p}c")))), docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, shard and slot of every document that is left."""
    plan = shards.shard_plan(docs)
    return plan.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", clean),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.shared_table(docs)
    return docs
