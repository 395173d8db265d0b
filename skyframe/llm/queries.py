"""The thin contract queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rules

    return rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytespans import drop_repeated_bytes

    return drop_repeated_bytes(table(spark, sf_dir, "documents"), keep_text=False)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak import classify

    return classify(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=False)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordspans import drop_repeated_words

    return drop_repeated_words(table(spark, sf_dir, "documents"), keep_text=False)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents")).drop("lang", "source", "n_chars")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from . import bytespans, decontam, quality, wordspans

    return {"op1_quality_rules": quality.sql(), "op3_decontamination": decontam.SQL, "op4_suffix_array": bytespans.SQL, "op8_substrings": wordspans.SQL}
