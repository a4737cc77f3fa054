"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (FTRL-proximal) under an elastic net, then calibrated
with one temperature on rows that training did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, column, share, slices

#: Hashed feature space and the n-gram lengths in it.
BITS, ORDERS = 16, (1, 2, 3)
#: Labelled rows of each language that the fit uses in expectation (the documented sample bound).
SAMPLE_PER_LANGUAGE = 800
CHUNK = 1 << 20
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))
_BLANK = np.uint32(32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature indices and counts of the whole text, or None where it has no letter.

    Text is lower-cased and every run of other characters than letters becomes one blank.  Long
    texts are read in overlapping chunks, so memory does not grow with them.
    """
    if not text:
        return None
    codes = code_points(text.lower())
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters the first stays, as a blank
    if not letter.all():
        codes = np.where(letter, codes, _BLANK)[keep]
    codes = np.concatenate([[_BLANK], codes, [_BLANK]]).astype(np.uint32, copy=False)
    if len(codes) <= CHUNK:
        return _runs(_hashes(codes, len(codes)))
    total = np.zeros(1 << BITS, np.int64)
    for start in range(0, len(codes), CHUNK):
        own = min(CHUNK, len(codes) - start)
        total += np.bincount(_hashes(codes[start : start + CHUNK + max(ORDERS) - 1], own), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def _hashes(part: np.ndarray, own: int) -> np.ndarray:
    """16-bit hashes of the n-grams that start at the first ``own`` characters."""
    found, rolled = [], np.zeros(len(part), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if n > len(part):
            break
        rolled = rolled[: len(part) - n + 1] * _MIX[1]
        rolled += part[n - 1 :]
        rolled += np.uint32(n)
        if n in ORDERS:
            h = rolled[:own] ^ (rolled[:own] >> np.uint32(15))
            h *= _MIX[0]
            found.append((h >> np.uint32(32 - BITS)).astype(np.uint16))
    return np.concatenate(found)


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and counts; 16-bit numbers are sorted by radix."""
    h = np.sort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first].astype(np.int64), np.diff(first, append=len(h))


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, probability); ('und', 0) for null, letterless text or an empty model."""
        found = ngram_counts(text)
        if found is None or not self.langs:
            return "und", 0.0
        p = softmax((self.vector(*found) @ self.weights[found[0]] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over sparse rows (indices, values): weights (features x k) and bias."""
    d = 1 << BITS
    z, n = np.zeros((d + 1, k)), np.zeros((d + 1, k))
    rng = np.random.default_rng(seed)

    def weights(zi, ni):
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, d), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
    w = weights(z, n)
    return w[:d].astype(np.float32), w[d]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learns from rows where ``learn`` holds and text and language are not null.

    Document frequencies cover every such row.  The regression is fitted on a sample by hash of
    the id: ``per_language`` rows of each language in expectation, a fifth of them for calibration.
    """
    rows = docs.where(learn & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for b in slices(batches, "text"):
            for text in column(b, "text").to_pylist():
                if (found := ngram_counts(text)) is not None:
                    df[found[0]] += 1
                    n += 1
        df[1 << BITS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["feature", "n"])

    # at most 2^BITS + 1 rows reach the driver
    seen = rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << BITS) + 1)
    df[seen["feature"].to_numpy(int)] = seen["n"].to_numpy(float)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([], idf)
    langs = sorted(sizes)
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(per_language / sizes[k]))])
    sample = rows.where(share("id", "langid") < rate[F.col("lang")]).withColumn("u", share("id", "calibrate"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [(k, u, f) for k, u, t in zip(column(b, "lang").to_pylist(), column(b, "u").to_pylist(), column(b, "text").to_pylist()) if (f := ngram_counts(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2][0].astype("<i4").tobytes() for g in got], pa.binary()), pa.array([g[2][1].astype("<i4").tobytes() for g in got], pa.binary())], names=["lang", "u", "at", "n"])

    got = sorted(map(tuple, sample.select("lang", "u", "text").mapInArrow(features, "lang string, u double, at binary, n binary").collect()))
    model = LanguageModel(langs, idf)
    x = [(at, model.vector(at, n)) for at, n in ((np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4")) for r in got)]
    y, held = np.array([langs.index(r[0]) for r in got], int), np.array([r[1] < 0.2 for r in got], bool)
    fit = [i for i in range(len(x)) if not held[i]] or list(range(len(x)))
    model.weights, model.bias = fit_ftrl([x[i] for i in fit], y[fit] if len(y) else y, len(langs))
    logits = np.array([v @ model.weights[at] + model.bias for (at, v), h in zip(x, held) if h]).reshape(-1, len(langs))
    model.temperature = fit_temperature(logits, y[held])
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred and its calibrated probability as score, from the whole text only.

    Null, empty and letterless texts are ``und`` with score 0.  Repeated rows are scored alike,
    other columns are ignored, an empty table gives an empty one.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [model.predict(t) for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.35) -> DataFrame:
    """The rows, with all columns, whose text has a language of probability ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            good = [p[0] != "und" and p[1] >= least for p in map(model.predict, column(b, text_col).to_pylist())]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
