"""Packing: fixed-length sequences whose documents are lexical neighbours.

Documents are tokenised once.  Pieces are dealt in shards of bounded size by lexical locality:
in the order of weighted MinHash keys, under which pieces that share much of their rare terms lie
together; a key with more pieces than a shard holds is split.  Shards hold a BM25 inverted index of
their documents (document frequencies and lengths are those of the whole corpus).  Within a shard each
sequence starts with a seed document; its best unused neighbours fill the window greedily, the
last one is cut and its rest seeds the next sequence.  What is left at the end of a shard becomes
sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import BATCH_BYTES, column, materialise, slices
from .tokens import load, tokenizer_path

LENGTH, END = 2048, 1
#: Tokens of a shard (in expectation) and of the pieces that long documents are dealt in.
SHARD_TOKENS, PIECE_TOKENS = 1_000_000, 32_768
#: Pieces of a shard (in expectation) whose keys are read to find the bounds of shards.
SHARD_SAMPLE = 50
#: Characters from which a text's ids are taken as a buffer.
LONG = 1 << 18
#: BM25's constants.
K1, B = 1.2, 0.75
#: Terms that at least one in COMMON pieces has are scored for all seeds by one product of matrices, in shards
#: of at most DENSE pieces; the result is the same.
COMMON, DENSE = 16, 2048


class Encoder:
    """The ids that the tokenizers library gives for a file, faster where that is safe.

    For byte-level BPE without normaliser whose ids are numbered in the order of the merges, merging
    by smallest id is the library's algorithm.  Such files are also loaded into a byte-pair encoder
    that works on ranks, from the same vocabulary.  It takes the texts in Latin-1, where both
    engines' character classes agree for certain; others, and texts with special strings, go to
    the library itself, as do all texts of other files.
    """

    def __init__(self, path: str):
        self.tok = load(path)
        self.special = [str(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(json.loads(self.tok.to_str()))

    @staticmethod
    def _ranked(spec: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        vocab, merges = model.get("vocab"), model.get("merges")
        usual = model.get("type") == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not usual or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout") or model.get("ignore_merges"):
            return None
        if any(vocab.get("".join(m if isinstance(m, list) else m.split(" "))) != 256 + i for i, m in enumerate(merges)):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        added = {t["content"] for t in spec.get("added_tokens", [])}
        return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks={bytes(byte[c] for c in k): i for k, i in vocab.items() if k not in added}, special_tokens={})

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        quick = [self.ranked is not None and (not t or _latin(t) and not any(x in t for x in self.special)) for t in texts]
        rest = iter(self.tok.encode_batch_fast([t or "" for t, q in zip(texts, quick) if not q], add_special_tokens=False))
        return [self._ids(t) if q else _little(next(rest).ids) for t, q in zip(texts, quick)]

    def _ids(self, text: str | None) -> bytes:
        """The ids by ranks; those of a long text are never numbers of Python, which take 16 times as much."""
        if text and len(text) > LONG:
            return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return _little(self.ranked.encode_ordinary(text) if text else [])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _latin(t: str) -> bool:
    if t.isascii():
        return True
    try:
        t.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _little(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def tokenised(docs: DataFrame, path: str | None, tokenizer: str, id_col: str, text_col: str, piece_tokens: int, batch_bytes: int) -> DataFrame:
    """(id, start, doc_tokens, ids) for each piece of a document, and for each task a row with
    null ids for each term: (term, documents that have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or tokenizer_path(tokenizer)
        frequency = np.zeros(load(file).get_vocab_size() + 2, np.int64)
        size = np.dtype("<u2") if len(frequency) <= 1 << 16 else np.dtype("<u4")
        for b in slices(batches, "text", batch_bytes):
            keys, starts, totals, ids, docs_ = column(b, "id").to_pylist(), [], [], [], []
            for key, raw in zip(keys, encoder(file)(column(b, "text").to_pylist())):
                x = np.append(np.frombuffer(raw, "<u4"), np.uint32(END)).astype(size)
                seen = np.unique(x) if len(x) < 4096 else np.flatnonzero(np.bincount(x, minlength=1))
                frequency[seen] += 1
                for at in range(0, len(x), piece_tokens):
                    docs_.append(key)
                    starts.append(at)
                    totals.append(len(x))
                    ids.append(x[at : at + piece_tokens].tobytes())
            yield _rows(docs_, starts, totals, ids, size.itemsize)
        at = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), pa.array(at, pa.int64()), pa.array(frequency[at], pa.int64()), pa.nulls(len(at), pa.binary()), pa.array(np.zeros(len(at)), pa.int32())], names=_NAMES)

    def _rows(a, b, c, d, width):
        return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary()), pa.array([width] * len(a), pa.int32())], names=_NAMES)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = to_arrow_type(rows.schema["id"].dataType)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start long, doc_tokens long, ids binary, width int")


_NAMES = ["id", "start", "doc_tokens", "ids", "width"]


class Keys:
    """Places of pieces in an order in which lexical neighbours lie together.

    Three weighted MinHashes: the term of the least exponential variate of rate idf.  Two pieces
    agree in one with the weighted Jaccard similarity of their terms.  The first two and a digest
    of the third lead; ten bits of the piece's own hash split pieces that agree in all.  53 bits.
    """

    def __init__(self, frequency: np.ndarray, idf: np.ndarray):
        u = np.random.default_rng(20240607).random((3, len(idf)))
        self.wait = (-np.log(u) / np.maximum(idf, 1e-6)).astype(np.float32)
        self.wait[:, frequency < 2] = np.inf  # no other document has these

    def __call__(self, ids: np.ndarray, own: int) -> int:
        a, b, c = (int(ids[w[ids].argmin()]) for w in self.wait)
        return (a & 0x1FFFF) << 36 | (b & 0x1FFFF) << 19 | (c * 0x9E3779B1 >> 16 & 0x1FF) << 10 | own & 0x3FF


def shard_bounds(keys: np.ndarray, weights: np.ndarray, shards: int) -> np.ndarray:
    """The least keys of all shards but the first, from sampled keys: shards of about equal weight."""
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum(weights[order])
    if not len(ends):
        return np.zeros(0, np.int64)
    at = np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards)
    return np.unique(keys[order][np.minimum(at, len(keys) - 1)])


class Index:
    """BM25 inverted index of the pieces of a shard; every distinct term of a seed queries it.

    Postings of common terms are kept as a matrix, so that their part of all scores is one product.
    """

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean: float):
        n = self.n = len(ids)
        wide = np.uint32 if len(idf) * n < 1 << 32 else np.uint64  # the narrower sorts faster
        owner = np.repeat(np.arange(n, dtype=wide), [len(x) for x in ids])
        key = np.sort(np.concatenate(ids).astype(wide) * wide(n) + owner)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        tf = np.diff(np.append(first, len(key)))
        term, doc = (a.astype(np.int64) for a in np.divmod(key[first], wide(n)))
        norm = K1 * (1 - B + B * np.array([len(x) for x in ids]) / max(mean, 1))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        held = np.bincount(term)[term]
        common = (held * COMMON >= n) & (held > 1) & (n <= DENSE)
        rare = (held > 1) & ~common  # a term of one piece finds no other
        self.dense = self._product(term[common], doc[common], weight[common]) if common.any() else None
        self.term, self.doc, self.weight = term[rare], doc[rare], weight[rare]
        order = np.argsort(self.doc, kind="stable")
        mine = np.cumsum(np.bincount(self.doc, minlength=n))[:-1]
        # the postings of each rare term of each piece
        self.lo = np.split(np.searchsorted(self.term, self.term[order], side="left"), mine)
        self.hi = np.split(np.searchsorted(self.term, self.term[order], side="right"), mine)

    def _product(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> np.ndarray:
        _, at = np.unique(term, return_inverse=True)
        out, start = np.zeros((self.n, self.n), np.float32), 0
        width = max(1, (1 << 21) // self.n)  # terms of a block
        for first in range(0, int(at[-1]) + 1, width):
            stop = int(np.searchsorted(at, first + width))
            block = np.zeros((self.n, width), np.float32)
            block[doc[start:stop], at[start:stop] - first] = weight[start:stop]
            for row in range(0, self.n, 256):  # what stands beside the result stays small
                out[row : row + 256] += (block[row : row + 256] > 0).astype(np.float32) @ block.T
            start = stop
        return out

    def scores(self, i: int) -> np.ndarray:
        """The scores of all pieces for the distinct terms of piece ``i`` that another piece has; 0 for itself."""
        score = np.zeros(self.n) if self.dense is None else self.dense[i].astype(np.float64)
        spans = [slice(a, b) for a, b in zip(self.lo[i], self.hi[i])]
        if spans:
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), weights=np.concatenate([self.weight[s] for s in spans]), minlength=self.n)
        score[i] = 0
        return score

    def neighbours(self, i: int) -> np.ndarray:
        """The other pieces that share a term with piece ``i``, best first; of equal ones the first."""
        score = self.scores(i)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(sizes: np.ndarray, neighbours, length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(piece, begin, count, sequence, offset): every token of every piece once, in full sequences.

    ``neighbours(i)`` gives candidates for seed ``i``, best first.  The last tokens make sequences
    whose lengths are powers of two.
    """
    n, total = len(sizes), int(sizes.sum())
    used, out, at = np.zeros(n, bool), [], 0
    seq, offset, room, rest, i = 0, 0, 0, total, -1
    begin, left, seed_next = 0, 0, 0
    ranked: list[int] = []

    def size_of_next() -> int:
        return length if rest >= length else 1 << (rest.bit_length() - 1)

    room = size_of_next() if total else 0
    while rest:
        if not left:  # the next piece: a neighbour of the seed, else the next unused one
            i = -1
            while ranked:
                j = ranked.pop()
                if not used[j]:
                    i = j
                    break
            if i < 0:
                while used[seed_next]:
                    seed_next += 1
                i = seed_next
                ranked = neighbours(i)[::-1].tolist()
            used[i] = True
            begin, left = 0, int(sizes[i])
            if not offset:
                ranked = neighbours(i)[::-1].tolist()
        take = min(left, room)
        out.append((i, begin, take, seq, offset))
        begin, left, offset, room, rest = begin + take, left - take, offset + take, room - take, rest - take
        if not room and rest:
            seq, offset, room = seq + 1, 0, size_of_next()
            if left:  # the cut piece seeds the next sequence
                ranked = neighbours(i)[::-1].tolist()
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", path: str | None = None, length: int = LENGTH, shard_tokens: int = SHARD_TOKENS, piece_tokens: int = PIECE_TOKENS, batch_bytes: int = BATCH_BYTES // 2) -> DataFrame:
    """One row for each piece of a document in a sequence: id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, then id 1; null and empty texts have that id alone.
    Each id lies in exactly one piece; sequences hold ``length`` ids, or a smaller power of two at
    the end of a shard, and are gapless.  Repeated rows are packed each; document ids are of any
    ordered type and may be null or repeat; of equal scores the piece comes first that does in
    order of id, start and tokens; extra columns are ignored; an empty table gives an empty one.  Shards are ranges of
    keys of lexical locality (see Keys) with about equal numbers of tokens; neighbours in other
    shards are not found (the README has the measured share).
    """
    table = materialise(tokenised(docs, path, tokenizer, id_col, text_col, piece_tokens, batch_bytes), "ids")
    pieces, kind = table.where(F.col("ids").isNotNull()), table.schema["id"].dataType.simpleString()
    n, total = pieces.agg(F.count_if(F.col("start") == 0), F.coalesce(F.sum(F.octet_length("ids") / F.col("width")), F.lit(0))).first()
    terms = table.where(F.col("ids").isNull()).groupBy("start").agg(F.sum("doc_tokens").alias("n")).collect()  # at most the vocabulary
    frequency = np.zeros(max([int(r["start"]) for r in terms], default=0) + 1)
    for r in terms:
        frequency[r["start"]] = r["n"]
    idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    mean, shards = float(total) / max(n, 1), max(1, round(float(total) / shard_tokens))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        width, shard = t.column("width")[0].as_py(), t.column("shard")[0].as_py()
        ids = [np.frombuffer(x, f"<u{width}") for x in t.column("ids").to_pylist()]
        index = Index(ids, idf, mean)
        rows = pack_shard(np.array([len(x) for x in ids]), index.neighbours, length)
        at, begin, count, seq, offset = (np.array(c, np.int64) for c in zip(*rows))
        crc = [zlib.crc32(ids[i][b : b + c].astype("<u4").tobytes()) for i, b, c, _, _ in rows]
        take = lambda c: t.column(c).combine_chunks().take(pa.array(at))
        return pa.table([take("id"), pa.array(take("start").to_numpy() + begin), pa.array(count), pa.array(crc, pa.int64()), take("doc_tokens"), pa.array(seq + (int(shard) << 32)), pa.array(offset)], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    def places(b: pa.RecordBatch, keys: Keys) -> np.ndarray:
        width = column(b, "width")[0].as_py()
        return np.array([keys(np.frombuffer(x, f"<u{width}"), own) for x, own in zip(column(b, "ids").to_pylist(), column(b, "own").to_pylist())], np.int64)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(frequency, idf)
        for b in slices(batches, "ids"):
            yield pa.RecordBatch.from_arrays([pa.array(places(b, keys)), column(b, "weight")], names=["key", "weight"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(frequency, idf)
        for b in slices(batches, "ids"):
            shard = np.searchsorted(bounds, places(b, keys), side="right")
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in _NAMES), pa.array(shard, pa.int64())], names=[*_NAMES, "shard"])

    if shards > 1:
        pieces = pieces.withColumn("own", F.xxhash64("id", "start"))
        # a piece is sampled by its share of the tokens; one with more than an expectation of 1 weighs more
        expected = F.octet_length("ids") / F.col("width") * (SHARD_SAMPLE / shard_tokens)
        drawn = pieces.withColumn("weight", F.greatest(expected, F.lit(1.0))).where(F.pmod(F.xxhash64(F.lit("shard"), "own"), F.lit(1 << 30)) / float(1 << 30) < expected)
        sample = drawn.select("ids", "width", "own", "weight").mapInArrow(sampled, "key long, weight double").toArrow()
        bounds = shard_bounds(sample.column("key").to_numpy(), sample.column("weight").to_numpy(), shards)
        dealt = pieces.mapInArrow(deal, f"id {kind}, start long, doc_tokens long, ids binary, width int, shard long")
    else:
        dealt = pieces.withColumn("shard", F.lit(0).cast("long"))
    return dealt.groupBy("shard").applyInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
