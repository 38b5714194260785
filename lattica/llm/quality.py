r"""Operator 8, quality rules with risk-controlled thresholds (DataFrame functions only).

Every document gets measures of its whole text; a rule rejects documents whose measure
exceeds a cutoff.  Cutoffs come from labelled holdouts: within a stratum (language) and
for each rule, every cutoff of a grid is tested against the null hypothesis that it
rejects more than `ALPHA / rules` of the documents labelled good.  The p-value is the exact
binomial tail P(Bin(n, alpha) <= k) for k false rejections among n good documents, and a
cutoff is certified when it is at most `DELTA / number of tests` (Bonferroni over strata,
rules and cutoffs).  The strictest certified cutoff holds; without one the rule rejects
nothing in that stratum.  So with probability 1 - DELTA no stratum loses more than ALPHA
of its good documents to the rules.

Repeated words are found inside the row: the 64-bit hashes of the 3-word windows are sorted
with their positions, neighbours with equal hashes and equal words mark repeated windows,
and sorted marked positions give the number of words covered, in n log n for any text.

Edge cases: null or empty text has no words and fails the base rules; a null language is a
stratum of its own; documents without label, or with contradicting labels (the lowest
counts), only receive cutoffs; ties at a cutoff are kept (a rule rejects strictly above);
empty tables give empty results; without labels nothing is rejected beyond the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

ALPHA = 0.05
DELTA = 0.05
MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
#: Measure of each rule and the grid of its cutoffs (strict to loose).
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4]),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.45]),
    "length": ("word_chars / greatest(n_words, 1)", [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
}


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Rows (__id, __stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words).  Each array gets a column of its own, so nothing is evaluated twice."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("__id"), F.col(stratum).alias("__stratum"), t.alias("__t"))
    rows = rows.withColumn("__w", F.array_remove(F.split("__t", r"[\x20\x09-\x0D]+"), "")).withColumn("__l", F.expr(r"filter(split(__t, '\n'), x -> length(translate(x, ' \t\u000B\u000C\r', '')) > 0)"))
    rows = rows.withColumn("__n", F.size("__w"))
    rows = rows.select(
        "__id", "__stratum", "__w", F.col("__n").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "__w")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        "__n",
    )
    rows = rows.withColumn("__g", F.when(F.col("__n") >= 4, F.expr("sort_array(transform(sequence(0, __n - 3), i -> struct(xxhash64(__w[i], __w[i + 1], __w[i + 2]) AS h, i AS i)))")))
    same = "(x.h = get(__g, {k}).h AND __w[x.i] = __w[get(__g, {k}).i] AND __w[x.i + 1] = __w[get(__g, {k}).i + 1] AND __w[x.i + 2] = __w[get(__g, {k}).i + 2])"
    rows = rows.withColumn("__m", F.expr(f"sort_array(filter(transform(__g, (x, k) -> if({same.format(k='k - 1')} OR {same.format(k='k + 1')}, x.i, NULL)), i -> i IS NOT NULL))")).drop("__g", "__n", "__w")
    covered = F.expr("aggregate(transform(__m, (x, k) -> least(3, coalesce(get(__m, k + 1) - x, 3))), 0L, (a, x) -> a + x)")
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__m")


def values() -> list[Column]:
    return [F.expr(f"CAST({e} AS DOUBLE)").alias(f"v_{name}") for name, (e, _) in RULES.items()]


def log_gamma(x: str) -> str:
    """ln Gamma(x) for x >= 1 as SQL: Stirling's series after a shift by 8."""
    y = f"({x} + 8)"
    shift = " + ".join(f"ln({x} + {i})" for i in range(8))
    return f"(({y} - 0.5) * ln({y}) - {y} + 0.9189385332046727 + 1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - ({shift}))"


def binomial_tail(n: str, k: str, p: float) -> Column:
    """P(Bin(n, p) <= k) for k < n * p (else 1, which certifies nothing): terms are added from
    k downwards.  The term j below k is at most exp(-j * (j - 1) / (2 * n * p)) times that at k,
    so what lies more than 10 * sqrt(n * p) + 10 below changes no bit of the sum."""
    n, k = f"CAST({n} AS DOUBLE)", f"CAST({k} AS DOUBLE)"
    top = f"exp({log_gamma(f'({n} + 1)')} - {log_gamma(f'({k} + 1)')} - {log_gamma(f'({n} - {k} + 1)')} + {k} * ln({p}D) + ({n} - {k}) * ln(1 - {p}D))"
    step = f"named_struct('t', a.t * ({k} - j + 1) * (1 - {p}D) / (({n} - {k} + j) * {p}D), 's', a.s + a.t)"
    total = f"aggregate(sequence(1, CAST(least({k} + 1, 10 * sqrt({n} * {p}D) + 10) AS INT)), named_struct('t', {top}, 's', 0D), (a, j) -> {step}, a -> a.s)"
    return F.expr(f"CASE WHEN {k} >= {n} * {p}D THEN 1D ELSE least(1D, {total}) END")


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Rows (__stratum, c_<rule>...): the strictest certified cutoff of each rule, or null."""
    good = labels.groupBy(F.col("doc_id").alias("__l")).agg(F.min("quality").alias("__q")).where("__q = 1").select("__l")
    held = measured.select("__id", "__stratum", *values()).join(good, F.col("__id") == F.col("__l"))
    tests = [(r, c) for r, (_, grid) in RULES.items() for c in grid]
    counts = held.groupBy("__stratum").agg(F.count("*").alias("__good"), *(F.sum((F.col(f"v_{r}") > c).cast("long")).alias(f"k{i}") for i, (r, c) in enumerate(tests)))
    level = F.lit(delta) / (len(tests) * F.count("*").over(W.partitionBy()))
    share = alpha / len(RULES)
    long = counts.withColumn("__level", level).select("__stratum", "__good", "__level", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cut"), F.col(f"k{i}").alias("k")) for i, (r, c) in enumerate(tests)))).alias("x"))
    sure = long.select("__stratum", "__level", "x.rule", "x.cut", binomial_tail("__good", "x.k", share).alias("p")).where("p <= __level")
    return sure.groupBy("__stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cut"))).alias(f"c_{r}") for r in RULES))


def judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """`measured` with base_failed and kept."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(f"v_{r}") > F.col(f"c_{r}"), F.lit(False))
    # one row per language with labels; Spark picks the join, so no broadcast is forced
    joined = measured.select("*", *values()).join(cuts.withColumnRenamed("__stratum", "__s"), F.col("__stratum").eqNullSafe(F.col("__s")), "left")
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & ~over)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = C.shared_table(measures(C.table(spark, sf_dir, "documents")))
    rows = judged(measured, cutoffs(measured, C.table(spark, sf_dir, "labels")))
    return rows.select(F.col("__id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    tests = [(r, c) for r, (_, grid) in RULES.items() for c in grid]
    share = ALPHA / len(RULES)
    value = {r: "CAST(" + e.replace("greatest(", "greatest(1, ").replace(", 1)", ")").replace(" / ", " / CAST(") + " AS DOUBLE) AS DOUBLE)" for r, (e, _) in RULES.items()}
    counts = ", ".join(f"sum(CASE WHEN v_{r} > {c} THEN 1 ELSE 0 END) AS k{i}" for i, (r, c) in enumerate(tests))
    rows = " UNION ALL ".join(f"SELECT lang, good, strata, '{r}' AS rule, CAST({c} AS DOUBLE) AS cut, k{i} AS k FROM n" for i, (r, c) in enumerate(tests))
    tail = f"CASE WHEN k >= good * {share} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k + 1 AS BIGINT)), lambda i: exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({share}) + (good - i) * ln(1 - {share})))) END"
    over = " OR ".join(f"coalesce(v_{r} > c_{r}, false)" for r in RULES)
    return rf"""
WITH a AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
       list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS i FROM a)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT a.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
       CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
       CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM a LEFT JOIN c ON a.doc_id = c.doc_id),
v AS (SELECT *, {", ".join(f"{e} AS v_{r}" for r, e in value.items())} FROM m),
q AS (SELECT doc_id AS l_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
n AS (SELECT lang, count(*) AS good, count(*) OVER () AS strata, {counts} FROM v JOIN q ON doc_id = l_id GROUP BY lang),
h AS (SELECT lang, rule, cut, {tail} AS p, {DELTA} / ({len(tests)} * strata) AS lev FROM ({rows})),
k AS (SELECT lang AS c_lang, {", ".join(f"min(CASE WHEN rule = '{r}' THEN cut END) AS c_{r}" for r in RULES)} FROM h WHERE p <= lev GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM v) LEFT JOIN k ON lang IS NOT DISTINCT FROM c_lang
"""


SQL = _sql()
