"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprint, langid, license, ngram_join, packing, quality, secrets, tokens, urlfilter
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return f.select("doc_id", "n_chars", "edited_sha256", fingerprint.text_form(F.col("sketch")).alias("fingerprint"), fingerprint.text_form(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "kept_in_edited")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold("id", 5) != 0)
    s = quality.score(docs, model)
    return s.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(), path_col="source")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(table(spark, sf_dir, "documents"), license.known_digests(spark))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = langid.identify(docs, langid.train(docs, fold("doc_id", 4) != 2))
    return s.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens.token_counts(table(spark, sf_dir, "documents"))
    return t.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.train())
    return u.select("page_id", "host", "path", "rule", "verdict", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and callable(v)]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_licenses": license.oracle()}
