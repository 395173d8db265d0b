"""Quality rules with risk-controlled cutoffs, on DataFrame functions only.

A rule rejects a document whose score is over a cutoff.  The labelled good
texts that pass the base rules are the holdout, each text counted once however
many copies it has: nothing but the choice of cutoffs depends on them.
A cutoff is admissible in a stratum (a language) if the exact binomial test
rules out that it rejects more than alpha / rules of the good texts there:
P(Bin(n, alpha / rules) <= k) <= delta / tests for k of n rejected, with all
strata, rules and cutoffs counted as tests (Bonferroni).  So with probability
1 - delta, no stratum loses more than alpha of its good texts, whichever
admissible cutoffs are taken.  Of these the one with the most bad less good
labelled texts rejected is taken, the highest among equals; without an
admissible cutoff that rejects more bad than good ones, the rule rejects none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, spool

ALPHA, DELTA = 0.05, 0.05
#: Scores in thousandths, and the cutoffs tried for each (fixed values).
SCORES = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "lines": "1000 * n_dup_lines div greatest(n_words, 1)",
}
CUTOFFS = {
    "symbols": [10, 20, 40, 80, 120, 160, 200, 300, 400, 600],
    "repeats": [50, 100, 150, 200, 250, 300, 350, 400, 450, 500],
    "lines": [2, 4, 8, 12, 16, 24, 32, 64, 128, 256],
}
#: Strata that are broadcast at most; with more, the cutoffs are joined by shuffle.
BROADCAST_STRATA = 10_000


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text (see rules)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    core = F.btrim(text, F.lit(SPACES))
    df = docs.withColumn("_words", F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, r"[\x20\x09-\x0D]+")))
    grams = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: F.struct(F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn("_grams", F.when(F.size("_words") >= 4, F.sort_array(grams)).otherwise(F.array().cast("array<struct<h:long,i:int>>")))
    # windows equal to a neighbour in sorted order are found twice or more; their places, in text order, cover words
    same = lambda x, j: (F.get("_grams", j - 1)["h"] == x["h"]) | (F.get("_grams", j + 1)["h"] == x["h"])
    df = df.withColumn("_twice", F.sort_array(F.transform(F.filter("_grams", lambda x, j: F.coalesce(same(x, j), _either(x, j))), lambda x: x["i"])))
    zero = F.struct(F.lit(-1).alias("upto"), F.lit(0).cast("long").alias("n"))
    cover = F.aggregate("_twice", zero, lambda a, i: F.struct((i + 2).alias("upto"), (a["n"] + F.least(F.lit(3), i + 2 - a["upto"])).alias("n")), lambda a: a["n"])
    df = df.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    return df.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(text, SPACES)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        cover.alias("n_repeat_words"),
    )


def _either(x: Column, j: Column) -> Column:
    """At the ends of the array one neighbour is null."""
    return F.coalesce(F.get("_grams", j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_grams", j + 1)["h"] == x["h"], F.lit(False))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly, term by term in logarithms; 1 where k is not below the mean n p."""
    first = F.struct((n * F.lit(math.log1p(-p))).alias("log"), F.exp(n * F.lit(math.log1p(-p))).alias("sum"))
    odds = F.lit(math.log(p) - math.log1p(-p))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(terms, first, step, lambda a: a["sum"]))


def cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) of the admissible cutoffs taken; scored has doc_id, stratum, text_hash and a column for each score."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.max("quality") >= 1).alias("good"))
    # equal texts are one draw
    once = scored.join(known, "doc_id").groupBy("stratum", "text_hash").agg(F.max("good").alias("good"), *(F.max(r).alias(r) for r in SCORES))
    held = once.select("stratum", "good", F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("score"), F.array(*map(F.lit, CUTOFFS[r])).alias("tried")) for r in SCORES))))
    # by the number of cutoffs that a score exceeds: a few rows for each stratum and rule, however many labels there are
    over = F.size(F.filter("tried", lambda t: F.col("score") > t))
    counts = held.groupBy("stratum", "rule", over.alias("over")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    tried = F.create_map(*(x for r, c in CUTOFFS.items() for x in (F.lit(r), F.array(*map(F.lit, c)))))
    every = counts.groupBy("stratum", "rule").agg(F.collect_list(F.struct("over", "good", "bad")).alias("cells"), F.sum("good").alias("n"))
    every = every.select("stratum", "rule", "n", "cells", F.posexplode(tried[F.col("rule")]).alias("at", "cutoff"))
    total = lambda c: F.aggregate(F.filter("cells", lambda x: x["over"] > F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x[c])
    every = every.select("stratum", "rule", "cutoff", "n", total("good").alias("k"), total("bad").alias("bad"))
    tests = every.select("stratum").distinct().crossJoin(F.broadcast(every.groupBy().agg(F.count("*").alias("tests"))))
    share = alpha / len(SCORES)
    fine = every.join(tests, every["stratum"].eqNullSafe(tests["stratum"])).drop(tests["stratum"])
    fine = fine.where((F.col("bad") > F.col("k")) & (binomial_tail(F.col("n"), F.col("k"), share) <= F.lit(delta) / F.col("tests")))
    best = fine.groupBy("stratum", "rule").agg(F.max(F.struct((F.col("bad") - F.col("k")).alias("gain"), "cutoff")).alias("best"))
    return best.select("stratum", "rule", F.col("best.cutoff").alias("cutoff"))


def rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Base rules and risk-controlled rules for each row of docs.

    Returns doc_id, n_words (runs other than 0x20 and 0x09-0x0D), word_chars
    (code points in words), n_symbols (of #*$%&|<>), n_dup_lines (lines with a
    word, equal to an earlier line), n_repeat_words (words in 3-word windows
    found twice or more in the text), base_failed (under 50 words, or over half
    of the words repeat) and kept.  Null and empty texts have no words.  A null
    stratum is one stratum.  A document labelled more than once is good if any
    label is; labels without a document or a quality count for nothing, and
    without labels the method's rules reject none.  Rows that repeat are each
    returned, and count once in the holdout, as do copies of a text.  Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.lit("="), F.col(stratum_col).cast("string")).alias("stratum"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("body"))
    base = base.withColumn("stratum", F.coalesce("stratum", F.lit("")))  # null is no language, and not the empty one
    base = features(base, "body").drop("body")
    base = base.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    for rule, score in SCORES.items():
        base = base.withColumn(rule, F.expr(score))
    base = spool(base, "quality")
    chosen = spool(cutoffs(base.where("not base_failed"), labels, alpha, delta), "quality-cutoffs")
    by = chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in SCORES))
    if by.count() <= BROADCAST_STRATA:
        by = F.broadcast(by)
    out = base.join(by, "stratum", "left")
    bad = F.lit(False)
    for r in SCORES:
        bad = bad | F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"))


def sql(alpha: float = ALPHA, delta: float = DELTA) -> str:
    """The same over the tables documents and labels, for DuckDB."""
    tried = ", ".join(f"('{r}', {c})" for r, cs in CUTOFFS.items() for c in cs)
    scores = " UNION ALL ".join(f"SELECT doc_id, stratum, text_hash, '{r}' AS rule, {SCORES[r].replace(' div ', ' // ')} AS score FROM f WHERE NOT base_failed" for r in SCORES)
    return rf"""
WITH t AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS stratum, coalesce(text, '') AS text, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 0) + 1)) AS i FROM t))),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE n > 1) GROUP BY doc_id),
b AS (SELECT t.doc_id, stratum, sha256(text) AS text_hash, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
s AS ({scores}),
k AS (SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, rule, text_hash, max(score) AS score, bool_or(good) AS good FROM s JOIN k USING (doc_id) GROUP BY stratum, rule, text_hash),
e AS (SELECT stratum, h.rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND score > cutoff) AS k, count(*) FILTER (NOT good AND score > cutoff) AS bad FROM h JOIN (VALUES {tried}) AS c(rule, cutoff) ON h.rule = c.rule GROUP BY ALL),
p AS (SELECT *, (SELECT count(*) FROM e) AS tests, CASE WHEN k >= n * {alpha / len(SCORES)!r} THEN 1.0 ELSE list_sum([exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({alpha / len(SCORES)!r}) + (n - i) * ln({1 - alpha / len(SCORES)!r})) FOR i IN range(0, k + 1)]) END AS tail FROM e),
o AS (SELECT stratum, rule, cutoff FROM p WHERE bad > k AND tail <= {delta!r} / tests QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - k DESC, cutoff DESC) = 1),
x AS (SELECT DISTINCT doc_id FROM s JOIN o USING (stratum, rule) WHERE score > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM x) AS kept FROM f
"""
