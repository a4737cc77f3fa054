"""A training corpus from raw documents: five stages, each a table of documents to the next.

Each stage is written as Parquet and read again, so a lost executor costs one stage's work at
most.  Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontam, langid, ngram_join, packing, secrets
from loomgraph.llm.common import checked, fold, materialise, scope

#: Documents of an Arrow batch at most, so that a batch of long texts stays small in both processes.
BATCH_ROWS, SETTING = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage):
    """A stage whose Python batches hold at most BATCH_ROWS documents.

    Spark reads that setting when the result is computed, so a stage that is called by itself
    leaves it (never above what it was) for its caller; run() puts it back.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(SETTING)) <= BATCH_ROWS:
            spark.conf.set(SETTING, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts of no likely language.

    The model learns from the rows with a language whose id's fold is not 2; rows are judged one by
    one, so repeated rows and null ids go the way of their text.
    """
    return langid.keep_known(docs, langid.train(docs, fold("doc_id", 4) != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies: that of the smallest id, then of the smallest
    digest of the text; of rows that repeat both, the least in order of all columns.

    Rows are told apart by id and text, so all clean texts of one id, or of none, stay.  Null and
    empty texts and texts without words but their own are classes of their own and stay.
    """
    rows = ngram_join.similarity_rows(docs)
    of = lambda side: docs["doc_id"].eqNullSafe(side["doc_id"]) & (ngram_join.text_digest(docs["text"]) == side["digest"])
    # rows of one id and text are all heads or none: one table has those that go and the heads that repeat
    told = rows.where(~F.col("head") | F.col("digest").isNotNull()).groupBy("doc_id", "digest", "head").agg(F.count("*").alias("n"))
    told = materialise(told.where("NOT head OR n > 1").select("doc_id", "digest", "head"), "told")
    again = told.where("head")
    kept = docs.join(checked(told), of(told), "left_anti")
    if again.isEmpty():
        return kept
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = docs.join(checked(again), of(again), "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("one"))
    return kept.unionByName(one.select("doc_id", "text", "one.*").select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a copy, whole or edited, of a benchmark item, whatever their
    id; null and empty texts hold none."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; no row is dropped.  Null and empty texts stay as they are."""
    found = secrets.redact(docs, secrets.train(), path_col="source")
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences, row by row; null texts count as empty."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", small_batches(language_id)),
    ("near_duplicates", small_batches(near_duplicates)),
    ("decontamination", small_batches(decontamination)),
    ("secret_scan", small_batches(secret_scan)),
    ("packing", small_batches(packing_stage)),
]

#: Models, signatures and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of ``sf_dir``."""
    docs, before, was = spark.read.parquet(f"{sf_dir}/documents.parquet"), [], spark.conf.getAll.get(SETTING)
    try:
        for name, stage in STAGES[:-1]:
            now: list[str] = []
            with scope(spark, before):  # what a stage wrote for itself, and its input, go when its output stands
                docs = materialise(stage(spark, docs, sf_dir), name, now)
            before = now
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        spark.conf.unset(SETTING) if was is None else spark.conf.set(SETTING, was)
