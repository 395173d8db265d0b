"""The corpus pipeline: language, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads.
Null, empty and wordless texts are rejected by the language stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import bpe, decontam, langid, nearcopies, pii
from skyframe.llm.common import doc_key, fresh, small, spool, trim_driver, trim_heaps

#: A language is accepted if its calibrated probability is at least this.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no learned language with a probability of SURE, go."""
    return langid.identify(docs).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text with the smallest id of each group of near copies (5-word Jaccard of 0.8 at least) stays; of rows equal in id and text, one.

    A null id is the smallest.  Of different texts with that id in one group, any one stays, the same each time.
    What goes is decided on ids and hashes; texts are shuffled only if more rows go than a broadcast may hold.
    """
    trim_driver(spark)
    trim_heaps(spark)
    at, text = fresh(docs, "at"), fresh(docs, "node")
    groups = spool(nearcopies.near_copies(docs), "groups")
    stay = groups.groupBy("root").agg(F.min(F.struct("doc_key", "node")).alias("s"))
    judged = groups.join(stay, "root").withColumn("stays", F.col("s") == F.struct("doc_key", "node"))
    judged = spool(judged.select(F.col("doc_key").alias(at), F.col("node").alias(text), "n", "stays"), "judged")
    keyed = docs.withColumns({at: doc_key(), text: nearcopies.node()})
    kept = keyed.join(small(judged.where("not stays").select(at, text)), [at, text], "left_anti")
    again = judged.where("stays and n > 1").select(at, text)
    if again.isEmpty():
        return kept.select(*docs.columns)
    again = small(again)
    once = kept.join(again, [at, text], "left_semi").dropDuplicates([at, text])
    return kept.join(again, [at, text], "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go; rows with one id are told apart by their texts."""
    trim_driver(spark)
    at, text = fresh(docs, "bad"), fresh(docs, "hash")
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_hash=True).where("contaminated")
    bad = spool(found.select(F.col("doc_id").alias(at), F.col("text_hash").alias(text)).distinct(), "contaminated")
    return docs.join(small(bad), F.col("doc_id").eqNullSafe(F.col(at)) & (F.xxhash64("text") == F.col(text)), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes pseudonyms; n_chars follows."""
    out = pii.pseudonymise(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), their digest, and whether decoding gives the text back."""
    import public_tokenizers

    trim_driver(spark)
    trim_heaps(spark)
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]
#: SQL has neither the classifier, nor the fingerprints, nor the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
