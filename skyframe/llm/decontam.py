"""Benchmark decontamination by winnowing, on DataFrame functions only.

A window of `window` words has window - k + 1 grams of k words; its smallest
gram hash is its fingerprint.  Equal windows have equal fingerprints, so every
shared span of `window` words is found: the fingerprints of documents and items
are joined, and from the places in the documents where a joined fingerprint
stands the hits are extended to the windows around it, compared word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, small, spool

WINDOW, GRAM = 10, 5
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case; none for null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), BREAKS), "")


def _starts(n: Column, length: int) -> Column:
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, length: int) -> Column:
    """Hash of each run of `length` elements."""
    return F.transform(_starts(F.size(words), length), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(length))))


def _tagged(n: int):
    return lambda h: F.xxhash64(h, F.lit(n))


def _run(words: str, n: int):
    return lambda i: F.struct(i.alias("first"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("win"))


def _winnowed(df: DataFrame, words: str, window: int, k: int, short: list[int]) -> DataFrame:
    """df with prints: the distinct fingerprints of its windows and the hashes of its runs of the lengths in short."""
    df = df.withColumn("hw", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", _hashes(F.col("hw"), k))
    span = window - k + 1
    low = F.transform(_starts(F.size("grams"), span), lambda i: F.least(*(F.get("grams", i + j) for j in range(span))))
    runs = [F.transform(_hashes(F.col("hw"), n), _tagged(n)) for n in short]
    return df.withColumn("prints", F.array_distinct(F.concat(low, *runs))).drop("hw", "grams")


def _each_print(df: DataFrame) -> DataFrame:
    """The prints, a row each; outer for the same reason as in _windows."""
    return df.select(F.explode_outer("prints").alias("print")).where("print is not null")


def _around(df: DataFrame, words: str, window: int, k: int, short: list[int], prints: str) -> DataFrame:
    """df with the starts of the runs of `window` words that hold a gram with one of the prints (s0), and of the runs of the lengths in short that have one (s1 ...)."""
    df = df.withColumn("hw", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", _hashes(F.col("hw"), k)).withColumn("n", F.size(words))
    here = F.filter(_starts(F.size("grams"), 1), lambda i: F.array_contains(prints, F.get("grams", i)))
    spans = F.transform(here, lambda i: F.sequence(F.greatest(F.lit(0), i - (window - k)), F.least(i, F.col("n") - window)))
    df = df.withColumn("s0", F.when(F.col("n") >= window, F.array_distinct(F.flatten(spans))).otherwise(F.array().cast("array<int>")))
    for at, n in enumerate(short, 1):
        df = df.withColumn(f"r{at}", F.transform(_hashes(F.col("hw"), n), _tagged(n)))
        df = df.withColumn(f"s{at}", F.filter(_starts(F.size(f"r{at}"), 1), _one_of(f"r{at}", prints)))
    return df


def _one_of(runs: str, prints: str):
    return lambda i: F.array_contains(prints, F.get(runs, i))


def _windows(df: DataFrame, words: str, starts: dict[int, Column], keep: list[str]) -> DataFrame:
    """(keep, first, n, win): the runs of each length at its starts, joined by a space."""
    every = [F.transform(at, _run(words, n)) for n, at in starts.items()]
    # outer: an inner generator's inferred filter would be pushed below words and evaluate them again for each element
    return df.select(*keep, F.inline_outer(reduce(F.concat, every))).where("win is not null")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", with_hash: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs.

    A window is `window` consecutive words of an item; an item of fewer words,
    but not none, is one window.  A document word inside any occurrence of a
    window is hit.  items_sha256 is of the ids of the items with occurring
    windows, sorted as strings and joined by commas.  Null and empty texts have
    no words; items without words or with a null id have no windows.  Repeated
    items and rows change nothing but that each row of docs is returned; null
    ids are kept.  Other columns are ignored.  with_hash: also text_hash, which
    tells rows with one id and different texts apart.
    """
    bench = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where("item is not null and size(words) > 0")
    bench = spool(bench, "bench")
    short = sorted(r[0] for r in bench.where(F.size("words") < window).select(F.size("words")).distinct().collect())
    whole = bench.where(F.size("words") >= window)
    prints = _each_print(_winnowed(whole, "words", window, gram, []))
    for n in short:
        prints = prints.union(_each_print(_winnowed(bench.where(F.size("words") == n), "words", window, gram, [n])))
    prints = spool(prints.distinct().withColumn("known", F.lit(True)), "bench-prints")
    wins = _windows(whole, "words", {window: _starts(F.size("words"), window)}, ["item"]).select("item", "win").union(bench.where(F.size("words") < window).select("item", F.array_join("words", " ").alias("win")))
    wins = spool(wins.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items")), "bench-windows")

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    read = base.select("doc_id", "text_hash", F.monotonically_increasing_id().alias("row"), words_of(F.col("body")).alias("words"))
    marked = _winnowed(read, "words", window, gram, short).select("doc_id", "text_hash", "row", F.size("words").cast("long").alias("n_words"), F.explode_outer("prints").alias("print"))
    # a document's prints lie in one task, so the partial set leaves one row of it to shuffle
    rows = marked.join(small(prints), "print", "left").groupBy("row", "doc_id", "text_hash", "n_words").agg(F.collect_set(F.when(F.col("known"), F.col("print"))).alias("hits"))
    rows = spool(rows.drop("row"), "decontam")

    found = rows.where("size(hits) > 0").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), "hits").dropDuplicates(["hit_id", "hit_hash"])
    some = base.select("doc_id", "text_hash", "body").join(small(found), F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")))
    some = _around(some.select("doc_id", "text_hash", "hits", words_of(F.col("body")).alias("words")), "words", window, gram, short, "hits")
    starts = {window: F.col("s0")} | {n: F.col(f"s{at}") for at, n in enumerate(short, 1)}
    near = _windows(some, "words", starts, ["doc_id", "text_hash"]).join(small(wins), "win")
    spans = F.array_sort(F.collect_set(F.struct("first", (F.col("first") + F.col("n")).alias("last"))))
    hits = near.groupBy("doc_id", "text_hash").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    count = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["upto"], s["last"]).alias("upto"), (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"], a["upto"]))).alias("n")), lambda a: a["n"])
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), count.alias("n_hit"), "items")
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("items", F.array().cast("array<string>"))
    extra = ["text_hash"] if with_hash else []
    return out.select("doc_id", *extra, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
b AS (SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(list_slice(w, i, i + least(len(w), 10) - 1), 'string_agg', ' ') AS win FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS i FROM d, lens)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (win, n)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""
