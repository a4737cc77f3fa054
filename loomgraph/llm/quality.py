"""Quality classifier: gated-attention multiple-instance learning over a document's passages.

A document is a bag of passages.  Each passage is encoded, a gated attention layer weighs the
passages, and the weighted sum is scored.  All layers are learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, column, share, slices

#: Words of a passage, and classes of characters whose bigrams describe it.
PASSAGE, CLASSES = 64, 12
EXTRA = 4
WIDTH = CLASSES * CLASSES + EXTRA
HIDDEN, ATTENTION = 24, 12
#: Labelled documents that the fit uses in expectation, each with all its passages.
SAMPLE = 4000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Character class of each code point: letters by case, digits, white space, punctuation."""
    table = np.full(0x110000, 11, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            table[i] = 1 if c.isupper() else 0
        elif c.isdigit():
            table[i] = 2
        elif c.isspace():
            table[i] = 4 if c == "\n" else 3
    for k, chars in ((5, "."), (6, ","), (7, "!?"), (8, "'\"-:;()"), (9, "|*#%&$@~^_=+<>/\\{}[]")):
        for c in chars:
            table[ord(c)] = k
    table[0x80:][table[0x80:] == 11] = 10
    return table


def passages(text: str | None) -> np.ndarray:
    """Features of every passage of the whole text (one row each); no row for text without a word."""
    codes = code_points(text or "")
    kind = _classes()[codes]
    blank = (kind == 3) | (kind == 4)
    start = ~blank
    start[1:] &= blank[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros((0, WIDTH), np.float32)
    n = (len(at) + PASSAGE - 1) // PASSAGE
    where = np.zeros(len(codes), np.int32)  # the passage of each character
    where[at[PASSAGE::PASSAGE]] = 1
    where = np.cumsum(where, dtype=np.int32)
    k = CLASSES * CLASSES
    pair = kind[:-1].astype(np.int32) * CLASSES + kind[1:]
    counts = np.bincount(where[:-1] * k + pair, minlength=n * k).reshape(n, k).astype(np.float32) if len(pair) else np.zeros((n, k), np.float32)
    length = np.maximum(counts.sum(1), 1)
    spot = (np.arange(len(codes)) - at[np.maximum(np.cumsum(start) - 1, 0)]).astype(np.uint64)  # place in its word
    mixed = np.where(blank, np.uint64(0), (codes.astype(np.uint64) + np.uint64(1)) * (spot * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xC2B2AE3D27D4EB4F)))
    word = np.add.reduceat(mixed, at)
    bag = np.arange(len(at)) // PASSAGE
    words = np.bincount(bag, minlength=n)
    key = np.sort((bag.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
    fresh = np.append(True, key[1:] != key[:-1])
    distinct = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.bincount(bag[1:], weights=word[1:] == word[:-1], minlength=n)
    chars = np.bincount(where, weights=~blank, minlength=n)
    extra = np.stack([distinct / words, again / words, chars / words / 10, np.log1p(words) / 4], 1)
    return np.concatenate([np.sqrt(counts / length[:, None]), extra], 1).astype(np.float32)


@dataclass
class QualityModel:
    """Weights; ``parts`` is None for a model without labels, which scores everything 0.5."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray] | None
    empty: float = 0.0

    def score(self, text: str | None) -> float:
        if self.parts is None:
            return 0.5
        x = passages(text)
        if not len(x):
            return self.empty
        p, _ = forward(self.parts, (x - self.mean) / self.scale, np.array([0]))
        return float(p[0])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forward(w: dict, x: np.ndarray, starts: np.ndarray):
    """Scores of bags (rows of ``x`` from each start on) and what the gradient needs."""
    sizes = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), sizes)
    h = np.tanh(x @ w["E"] + w["e"])
    t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    a = (t * s) @ w["w"]
    a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    a = a / np.add.reduceat(a, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return _sigmoid(z @ w["c"] + w["b"][0]), (h, t, s, a, z, bag)


def fit(bags: list[np.ndarray], y: np.ndarray, *, steps: int = 160, rate: float = 0.02, l2: float = 1e-4, seed: int = 3) -> QualityModel:
    """Full-batch Adam on the weighted log loss; classes weigh alike up to a factor of four."""
    rng = np.random.default_rng(seed)
    empty_y = [v for b, v in zip(bags, y) if not len(b)]
    keep = [i for i, b in enumerate(bags) if len(b)]
    if not keep:
        return QualityModel(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), None)
    y = np.asarray(y, np.float32)[keep]
    x = np.concatenate([bags[i] for i in keep])
    starts = np.cumsum([0, *(len(bags[i]) for i in keep[:-1])])
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = ((x - mean) / scale).astype(np.float32)
    w = {"E": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "e": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, ATTENTION**-0.5, ATTENTION), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    share1 = float(np.clip(y.mean(), 0.2, 0.8))
    weight = np.where(y > 0, 0.5 / share1, 0.5 / (1 - share1)).astype(np.float32)
    weight /= weight.sum()
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for step in range(1, steps + 1):
        p, (h, t, s, a, z, bag) = forward(w, x, starts)
        d = weight * (p - y)
        g = {"c": z.T @ d, "b": d.sum(keepdims=True)}
        dz = d[:, None] * w["c"]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(1)
        da = a * (da - np.add.reduceat(a * da, starts)[bag])
        gate = da[:, None] * w["w"]
        g["w"] = (t * s).T @ da
        dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
        g["V"], g["U"] = h.T @ dt, h.T @ ds
        dh = (dh + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
        g["E"], g["e"] = x.T @ dh, dh.sum(0)
        for k in w:
            grad = g[k] + (l2 * w[k] if w[k].ndim == 2 else 0)
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.99 * v[k] + 0.01 * grad * grad
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return QualityModel(mean.astype(np.float32), scale.astype(np.float32), w, float(np.mean(empty_y)) if empty_y else 0.0)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Learns from labelled documents for which ``learn`` (over the column ``id``) holds.

    Several labels of a document are averaged and rounded; null labels are ignored.  The fit uses
    ``sample`` documents in expectation, chosen by hash of the id, each with all its passages.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y")).where(learn)
    n = marks.count()
    marks = marks.where(share("id", "quality") < F.lit(sample / max(n, 1)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = [passages(t).astype("<f4").tobytes() for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "y"), pa.array(x, pa.binary())], names=["id", "y", "x"])

    got = sorted(map(tuple, rows.select("id", "y", "text").mapInArrow(features, f"id {rows.schema['id'].dataType.simpleString()}, y int, x binary").collect()))
    return fit([np.frombuffer(r[2], "<f4").reshape(-1, WIDTH) for r in got], np.array([r[1] for r in got]))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score in [0, 1], higher where label 1 is likelier, from the whole text only.

    Null, empty and blank texts have no passage; they get the mean label of such training texts,
    or 0.  Without any label every score is 0.5.  Repeated rows are scored alike, other columns
    are ignored, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = [model.score(t) for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array(s, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
