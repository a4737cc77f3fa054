"""Ranking by keywords, edit distance, vectors and intents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.storage import checked

from .relational import top_in


def _begins(k: Column):
    """Whether a word begins with a keyword or a keyword with the word."""
    return lambda w: F.startswith(w, k) | F.startswith(k, w)


def prompt_score(name: Column, file: Column, module: Column, prompt: str, words: list[str]) -> Column:
    """Relevance of a function: its name in the prompt, keywords in name, file, words and module."""
    n, f, m = F.lower(name), F.lower(file), F.lower(module)
    own = F.transform(S.words_of(name), F.lower)
    score = F.when(F.contains(F.lit(prompt.lower()), n) & (F.char_length(n) > 3), 0.9).otherwise(0.0)
    for k in words:
        kw = F.lit(k)
        score = score + F.when(F.contains(n, kw), 0.3).otherwise(0.0) + F.when(F.contains(f, kw), 0.15).otherwise(0.0)
        score = score + F.when(F.exists(own, _begins(kw)), 0.2).otherwise(0.0)
        score = score + F.when(F.contains(m, kw), 0.25).otherwise(0.0)
    return score


def similarity(name: Column, term: str) -> Column:
    """1 - distance / longer length, plus 0.3 where one contains the other."""
    n, t = F.lower(name), F.lit(term.lower())
    return 1 - F.levenshtein(t, n) / F.greatest(F.char_length(t), F.char_length(n)) + F.when(F.contains(n, t) | F.contains(t, n), 0.3).otherwise(0.0)


def keyword_score(name: Column, file: Column, words: list[str]) -> Column:
    """0.9 where the name is a keyword, else 0.45 where name or file contains one."""
    n, f, exact, part = F.lower(name), F.lower(file), F.lit(False), F.lit(False)
    for k in words:
        exact, part = exact | (n == k), part | F.contains(n, F.lit(k)) | F.contains(f, F.lit(k))
    return F.when(exact, 0.9).when(part, 0.45).otherwise(0.0)


def damped_score(functions: DataFrame, prompt: str, words: list[str]) -> DataFrame:
    """Functions (id, name, file) with a score in which common and short keywords count less."""
    n, f = F.lower("name"), F.lower("file")
    stats = functions.agg(F.count("*").alias("_all"), *[F.count_if(F.contains(n, F.lit(k))).alias(f"_k{i}") for i, k in enumerate(words)])
    t = functions.crossJoin(F.broadcast(stats))  # one row
    own = F.transform(S.words_of(F.col("name")), F.lower)
    score = F.when(F.contains(F.lit(prompt.lower()), n) & (F.char_length(n) > 3), 0.9).otherwise(0.0)
    hits, first = F.lit(0), F.lit(None).cast("double")
    for i, k in reversed(list(enumerate(words))):
        damp = F.when(F.col(f"_k{i}") > F.col("_all") * 0.4, 0.3).otherwise(1.0)
        weight = damp * (0.5 if len(k) <= 4 else 1.0)
        score = score + F.when(F.contains(n, F.lit(k)), 0.3 * weight).otherwise(0.0) + F.when(F.contains(f, F.lit(k)), 0.15 * weight).otherwise(0.0)
        camel = F.exists(own, _begins(F.lit(k)))
        hits = hits + F.when(camel, 1).otherwise(0)
        first = F.when(camel, damp).otherwise(first)
    score = score + F.when(hits >= 2, 0.4).when(hits == 1, 0.2 * first).otherwise(0.0)
    return t.withColumn("score", F.round(F.least(score, F.lit(1.0)), 6)).where("score > 0.3").select("id", "name", "score")


def dot(a: Column, b: Column) -> Column:
    """Cosine of unit vectors, clamped to [-1, 1]."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)))


def nearest(items: DataFrame, vector: str, query: DataFrame, k: int, key: str) -> DataFrame:
    """The k rows most alike one query vector (a one-row table), by rounded cosine then key."""
    t = items.crossJoin(F.broadcast(query.select(F.col(vector).alias("_q"))))  # one row
    return t.select(key, F.round(dot(F.col(vector), F.col("_q")), 3).alias("score")).orderBy(F.desc("score"), key).limit(k)


def domain_scores(words: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """(group, domain, score): words (group, word) that contain a keyword of a domain."""
    spark = words.sparkSession
    table = spark.createDataFrame([(d, k) for d, ks in domains.items() for k in ks], "domain string, keyword string")
    return words.join(F.broadcast(table), F.contains("word", F.col("keyword"))).groupBy("group", "domain").agg(F.count("*").alias("score"))


def domain_names(words: DataFrame, domains: DataFrame) -> DataFrame:
    """(group, name): groups (group, word) named by the domains (ord, domain, keyword) that their
    words hold most keywords of; two strong ones, the second at least half as strong as the
    first and both above 1, are joined."""
    hit = words.join(checked(domains), F.contains("word", F.col("keyword"))).groupBy("group", "domain", "ord").agg(F.count("*").alias("score"))
    top = top_in(hit, ["group"], [F.desc("score"), F.col("ord")], 2)
    two = top.groupBy("group").agg(F.max(F.when(F.col("rank") == 1, F.col("domain"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("domain"))).alias("b"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("x"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("y"))
    both = (F.col("y") > 1) & (F.col("y") >= F.col("x") * 0.5)
    return two.select("group", F.when(both, F.concat("a", F.lit(" & "), "b")).otherwise(F.col("a")).alias("name"))


def class_score(classes: DataFrame, prompt: str, words: list[str]) -> DataFrame:
    """Classes (id, name) that a prompt is about: (id, name, score)."""
    n, own = F.lower("name"), F.transform(S.words_of(F.col("name")), F.lower)
    score = F.when(F.contains(F.lit(prompt.lower()), n) & (F.char_length(n) > 3), 0.95).otherwise(0.0)
    for k in words:
        score = score + F.when(F.contains(n, F.lit(k)), 0.3).otherwise(0.0) + F.when(F.exists(own, _begins(F.lit(k))), 0.2).otherwise(0.0)
    return classes.withColumn("score", F.round(score, 6)).where("score > 0.3").select("id", "name", F.least("score", F.lit(1.0)).alias("score"))


def embedding_text(name: Column, purpose: Column, params: Column, return_type: Column) -> Column:
    """What of a function is embedded: name, purpose, parameter names and a telling result type."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    ret = F.when(~F.coalesce(return_type, F.lit("")).isin("", "void", "any"), F.concat(F.lit("returns "), return_type))
    return F.concat_ws(" ", name, some(purpose), some(F.array_join(F.transform(params, lambda p: p["name"]), " ")), ret)


def embed(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(id, embedding): unit vectors of texts (id, text) by an encoder, in batches of ``batch``.

    The encoder is a picklable function from texts to vectors; it is loaded where it runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                x = np.asarray(encode(part.column(1).to_pylist()), np.float32).reshape(part.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["id", "embedding"])

    return texts.select("id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "id string, embedding array<float>")


def hashed_encoder(width: int = 256) -> Callable[[list[str]], list[list[float]]]:
    """An encoder without a model: character trigrams of the words, hashed; a stand-in for a real one."""

    def encode(texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), width), np.float32)
        for row, text in zip(out, texts):
            low = f" {text.lower()} "
            for i in range(len(low) - 2):
                h = zlib.crc32(low[i : i + 3].encode())
                row[h % width] += 1 if h >> 31 else -1
        return out.tolist()

    return encode
