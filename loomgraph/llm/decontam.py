"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman scores them.

1. A document that holds an n-gram of an item, however common, is a candidate for the item.
2. Windows around the seeds are as wide as an alignment that reaches the threshold can be.
3. Those that lack the words to reach it are passed over; the others are aligned with the item
   locally, word by word.  The score is that of the best alignment over that of an exact copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import column, materialise, slices

NGRAM, THRESHOLD = 3, 0.5
#: Characters of benchmark text that every task holds at once in expectation; a larger table is
#: dealt in parts, each of which passes over the corpus (a longer single item is held whole).
BENCHMARK_PART = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"[^\W_]+")
_M = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Benchmark:
    """Items as word numbers, the n-grams of all items in order of their hashes, and the items of each."""

    ids: list
    items: list[np.ndarray]
    words: dict[str, int]
    grams: np.ndarray
    n: int
    owner: np.ndarray  # item and place in it of all item n-grams, in the order of grams
    place: np.ndarray
    bounds: np.ndarray  # the n-gram of index g has the rows bounds[g] to bounds[g + 1] of these

    @classmethod
    def of(cls, rows: list[tuple], n: int) -> Benchmark:
        words: dict[str, int] = {}
        ids, items = [], []
        for key, text in rows:
            w = _WORD.findall((text or "").lower())
            if w:
                ids.append(key)
                items.append(np.array([words.setdefault(x, len(words) + 1) for x in w], np.int64))
        grams = [cls.hashes(i, n) for i in items]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        known, spot = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, int)
        order = np.lexsort((place, owner, spot))
        return cls(ids, items, words, known, n, owner[order], place[order], np.searchsorted(spot[order], np.arange(len(known) + 1)))

    @staticmethod
    def hashes(numbers: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n-grams of word numbers; a shorter sequence is one n-gram."""
        k = min(n, len(numbers))
        h = np.full(max(len(numbers) - k + 1, 0), k, np.uint64)
        for i in range(k):
            h = h * _M + numbers[i : len(numbers) - k + 1 + i].astype(np.uint64)
            h ^= h >> np.uint64(31)
        return h

    def numbers(self, text: str) -> np.ndarray:
        """The word numbers of a text; words that no item has are 0."""
        get = self.words.get
        w = _WORD.findall(text.lower())
        return np.fromiter((get(x, 0) for x in w), np.int64, len(w))

    def seeds(self, numbers: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(place, index of n-gram) of every item n-gram in a text."""
        at, which = [], []
        for k in lengths:
            if len(numbers) < k or not len(self.grams):
                continue
            known = numbers > 0
            run = known[: len(numbers) - k + 1].copy()
            for i in range(1, k):
                run &= known[i : len(numbers) - k + 1 + i]
            place = np.flatnonzero(run)
            if not len(place):
                continue
            h = np.full(len(place), k, np.uint64)
            for i in range(k):
                h = h * _M + numbers[place + i].astype(np.uint64)
                h ^= h >> np.uint64(31)
            spot = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
            hit = self.grams[spot] == h
            at.append(place[hit])
            which.append(spot[hit])
        return (np.concatenate(at), np.concatenate(which)) if at else (np.zeros(0, int), np.zeros(0, int))

    @property
    def lengths(self) -> tuple[int, ...]:
        """The n-gram lengths in use: n, and those of items that are shorter."""
        return tuple(sorted({min(self.n, len(i)) for i in self.items}))


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment; start and end are places in ``text``.

    Row by row over the item; gaps within a row are resolved by a running maximum.
    """
    m = len(text)
    if not m or not len(item):
        return 0, 0, 0
    ramp = -GAP * np.arange(m + 1)
    row, best, end = np.zeros(m + 1, np.int64), 0, 0
    origin = np.arange(m + 1)  # where the best alignment that ends here starts
    start = 0
    for x in item:
        step = np.where(text == x, MATCH, MISMATCH)
        new, came = np.zeros(m + 1, np.int64), np.arange(m + 1)
        diagonal = row[:-1] + step
        up = row[1:] + GAP
        new[1:] = np.maximum(np.maximum(diagonal, up), 0)
        came[1:] = np.where(new[1:] == 0, came[1:], np.where(diagonal >= up, origin[:-1], origin[1:]))
        lifted = new + ramp
        top = np.maximum.accumulate(lifted)
        left = np.maximum.accumulate(np.where(lifted == top, np.arange(m + 1), 0))
        value = np.maximum(top - ramp, 0)
        came = np.where(value > new, came[left], came)
        row, origin = value, came
        k = int(row.argmax())
        if row[k] > best:
            best, end, start = int(row[k]), k, int(origin[k])
    return best, start, end


def _parts(items: DataFrame, id_col: str, text_col: str, n: int, part: int) -> Iterator[Benchmark]:
    """The items in parts of about ``part`` characters, one after another; none for no item."""
    size = items.agg(F.sum(F.char_length(text_col))).first()[0] or 0
    parts = max(1, -(-size // part))
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    for k in range(parts if size else 0):
        got = rows.where(F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.col("text"))), F.lit(parts)) == k).distinct().collect() if parts > 1 else rows.distinct().collect()
        yield Benchmark.of(sorted(map(tuple, got), key=lambda r: (r[0] is None, r)), n)


def possible(bench: Benchmark, numbers: np.ndarray, at: np.ndarray, which: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, places of seeds in the text, their places in the item) for each item that has an
    n-gram of the text and enough of whose words the text has for ``threshold``."""
    if not len(at):
        return
    count = bench.bounds[which + 1] - bench.bounds[which]
    rows = np.repeat(bench.bounds[which] - np.cumsum(count) + count, count) + np.arange(count.sum())
    owner, text_at, item_at = bench.owner[rows], np.repeat(at, count), bench.place[rows]
    order = np.argsort(owner, kind="stable")
    owner, text_at, item_at = owner[order], text_at[order], item_at[order]
    cut = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
    held = np.zeros(len(bench.words) + 1, bool) if len(cut) > 64 else None
    if held is not None:
        held[numbers] = True
    words = np.unique(numbers)
    for lo, hi in zip(cut[:-1], cut[1:]):
        k = int(owner[lo])
        item = bench.items[k]
        n = held[item].sum() if held is not None else (words[np.minimum(np.searchsorted(words, item), len(words) - 1)] == item).sum()
        if n >= threshold * len(item):
            yield k, text_at[lo:hi], item_at[lo:hi]


def best_alignment(item: np.ndarray, numbers: np.ndarray, at: np.ndarray, place: np.ndarray, threshold: float) -> tuple[float, int, int]:
    """The best alignment of an item in windows around seeds: (score, start, end), or a score of 0
    where none reaches ``threshold``.

    M matches and X other words score 2 M - X, so an alignment that reaches it has M of at least
    ``threshold`` times the item's words, and puts at most 2 (1 - threshold) times as many words
    between those of the item: no window is narrower, and one with fewer words of the item is
    passed over.
    """
    size = len(item)
    need, slack = threshold * size, int(2 * max(1 - threshold, 0) * size) + 1
    reach = size + 2 * slack  # the words around a seed that any such alignment of it can take
    starts = np.unique(at - place)
    best = (0.0, 0, 0)
    i = 0
    while i < len(starts):
        j = i
        while j + 1 < len(starts) and starts[j + 1] - starts[j] <= reach:
            j += 1
        lo, hi = max(0, int(starts[i]) - slack), min(len(numbers), int(starts[j]) + size + slack)
        # a long run of seeds is aligned in overlapping windows, each longer than any alignment
        for at0 in range(lo, max(lo + 1, hi), 8 * reach):
            part = numbers[at0 : min(hi, at0 + 10 * reach)]
            if np.isin(item, part).sum() < need or np.isin(part, item).sum() < need:
                continue
            score, s, e = smith_waterman(item, part)
            if score / (MATCH * size) > best[0]:
                best = (score / (MATCH * size), at0 + s, at0 + e)
        i = j + 1
    return best


def leaks_of(bench: Benchmark, text: str | None, threshold: float) -> dict:
    """{item id: (score, start, end)} of the items that a text holds; of several items with one id
    the best counts, of equal scores that which comes first in the text."""
    out: dict = {}
    numbers = bench.numbers(text) if text else np.zeros(0, np.int64)
    at, which = bench.seeds(numbers, bench.lengths)
    for k, text_at, item_at in possible(bench, numbers, at, which, threshold):
        score, s, e = best_alignment(bench.items[k], numbers, text_at, item_at, threshold)
        if score >= threshold:
            key = bench.ids[k]
            out[key] = min(out.get(key, (score, s, e)), (score, s, e), key=lambda x: (-x[0], x[1:]))
    return out


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, part: int = BENCHMARK_PART) -> DataFrame:
    """(id, item_id, score, start_word, end_word) for each row of ``docs`` and each item whose best
    local alignment scores at least ``threshold`` of an exact copy.

    Words are runs of letters and digits, lower-cased; start and end count words of the document.
    Each row is a document of its own: rows that repeat, or have a null id, are reported each.  Ids
    are of any type, those of items may be null; of items with one id the best counts.  Null and
    empty texts and items without words never match.  Texts of any length are read whole.  Of
    equal scores that which starts first is reported.  Either table may be empty.  The corpus is
    read once for every ``part`` characters of the benchmark; nothing is shuffled.  A document is
    aligned with every item that it shares an n-gram of ``ngram`` words with, whatever the
    frequency of the n-gram; alignments without one are not looked for.  Columns of docs but the
    two are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = rows.schema["id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    form = f"id {kinds[0]}, item_id {kinds[1]}, score double, start_word long, end_word long"
    out = rows.limit(0).selectExpr("id", f"cast(null as {kinds[1]}) item_id", "0d score", "0l start_word", "0l end_word")

    def aligned(bench: Benchmark) -> DataFrame:
        def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                at, found = [], []
                for i, text in enumerate(column(b, "text").to_pylist()):
                    for key, (score, s, e) in leaks_of(bench, text, threshold).items():
                        at.append(i)
                        found.append((key, score, s, e))
                cols = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([column(b, "id").take(pa.array(at, pa.int64())), pa.array(cols[0], item_type), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.float64(), pa.int64(), pa.int64())))], names=["id", "item_id", "score", "start_word", "end_word"])

        return rows.mapInArrow(align, form)

    item_type = to_arrow_type(items.schema[item_id].dataType)
    for k, bench in enumerate(_parts(items, item_id, item_text, ngram, part)):
        # the parts before are written, so the driver holds one at a time
        out = aligned(bench) if not k else materialise(out, "leaks").unionByName(aligned(bench))
    return out.withColumnRenamed("id", id_col)


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, part: int = BENCHMARK_PART) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text holds no item by find_leaks(); row by
    row, so null and repeated ids need no care.  Nothing is shuffled."""

    def cleaned(docs: DataFrame, bench: Benchmark) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col):
                yield b.filter(pa.array([not leaks_of(bench, t, threshold) for t in column(b, text_col).to_pylist()], pa.bool_()))

        return docs.mapInArrow(keep, docs.schema)

    for k, bench in enumerate(_parts(items, item_id, item_text, ngram, part)):
        docs = cleaned(materialise(docs, "clean") if k else docs, bench)
    return docs
