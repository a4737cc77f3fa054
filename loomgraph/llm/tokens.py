"""Token counts: lengths only, encoded in Arrow batches that are balanced by bytes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, column, slices

#: Bytes, about, that each of the two generations of a worker's cache of pieces holds at most; what
#: an entry takes beside its characters; and the characters of a piece that is kept.
CACHE, ENTRY, LONGEST = 48 << 20, 160, 48
#: Marks that, at the end of a piece and after a letter or digit, are always pre-tokens themselves.
MARKS = frozenset(".,;:!?")
#: Places in texts without blanks where no token spans: between a wide mark and a letter of such scripts.
_WIDE = re.compile("(?<=[\u3001\u3002\uff0c\uff01\uff1f\uff1b\uff1a])(?=[\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3])")


class PieceCache:
    """What is known of pieces; when full, the entries not used since the last time are forgotten."""

    def __init__(self, limit: int = CACHE):
        self.limit, self.known, self.old, self.held = limit, {}, {}, 0

    def lacking(self, pieces: set[str]) -> list[str]:
        """Those of the pieces that have to be computed; the others are known afterwards."""
        new = pieces.difference(self.known)
        if not new:
            return []
        size = ENTRY * len(new) + 2 * sum(map(len, new))
        if self.held + size > self.limit:
            self.old, self.known, self.held, new = self.known, {}, 0, pieces
            size = ENTRY * len(new) + 2 * sum(map(len, new))
        self.held += size
        if self.old:
            kept = {p: self.old[p] for p in new if p in self.old}
            self.known.update(kept)
            return list(new.difference(kept))
        return list(new)


@lru_cache(maxsize=4)
def cache_of(path: str) -> PieceCache:
    """The cache of this worker process for a tokenizer file."""
    return PieceCache()


def stem(piece: str) -> tuple[str, str]:
    """A piece without a closing mark, and that mark, where the tokenizer always parts them."""
    if len(piece) > 1 and piece[-1] in MARKS and piece[-2].lower().isalnum():
        return piece[:-1], piece[-1]
    return piece, ""


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a file, once for each worker, without threads, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def safe_pieces(text: str) -> list[str]:
    """Splits at ASCII blanks and line feeds, and long pieces also after wide marks.

    For tokenizers that drop white space before they form words (as word_bpe_49k does), no token
    spans such a boundary, and neither NFC nor lower-casing looks across it; so the counts of the
    pieces add up to the count of the whole text.
    """
    pieces = text.replace("\n", " ").split(" ")
    if len(text) > LONGEST * len(pieces) and not text.isascii():
        return [q for p in pieces for q in (_WIDE.split(p) if len(p) > LONGEST else (p,))]
    return pieces


def segments(text: str, limit: int) -> Iterator[str]:
    """The text in parts of at most ``limit`` characters, cut at blanks (a longer run without one stays whole)."""
    start = 0
    while len(text) - start > limit:
        cut = text.rfind(" ", start, start + limit)
        cut = cut if cut > start else text.find(" ", start + limit)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def fold_case(piece: str) -> str:
    """Lower case where only ASCII letters are affected; this tokenizer lowers them anyway."""
    return piece.lower() if piece.isascii() and piece.isalpha() else piece


def count_lengths(texts: list[str | None], path: str, cache: PieceCache) -> list[int]:
    """The number of tokens of each text; each distinct piece is encoded once (see safe_pieces)."""
    encode = load(path).encode_batch_fast
    split = [safe_pieces(text) if text else [] for text in texts]
    every = set().union(*split)
    long = [p for p in every if len(p) > LONGEST]
    every.difference_update(long)
    if new := cache.lacking(every):
        parts = [(p, fold_case(q), mark) for p in new for q, mark in [stem(p)]]
        known = cache.known
        words = list(({w for _, w, _ in parts} | {mark for _, _, mark in parts}).difference(known))
        known.update(zip(words, (len(e.ids) for e in encode(words, add_special_tokens=False))))
        known[""] = 0
        known.update([(p, known[w] + known[mark]) for p, w, mark in parts])
    own = dict(zip(long, (len(e.ids) for e in encode(long, add_special_tokens=False)))) if long else {}
    cache.known.update(own)
    counts = [sum(map(cache.known.__getitem__, pieces)) for pieces in split]
    for p in own:  # long pieces are never kept
        del cache.known[p]
    return counts


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", path: str | None = None, batch_bytes: int = BATCH_BYTES // 2) -> DataFrame:
    """Per row: id, n_bytes (UTF-8) and n_tokens of the whole text, without special tokens.

    Null and empty texts have 0 bytes and 0 tokens.  Strings of special tokens inside a text count
    as the library's default has it (one token each).  Texts of any length are counted whole, in
    pieces split at safe boundaries; repeated rows give repeated rows; other columns are ignored;
    an empty table gives an empty one.  ``path`` overrides the file that ``tokenizer`` names and
    must belong to a tokenizer that drops white space.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or tokenizer_path(tokenizer)
        cache = cache_of(file)
        for b in slices(batches, "text", batch_bytes):
            texts = column(b, "text").to_pylist()
            if len(texts) == 1 and texts[0]:  # what is longer than a batch comes alone
                n = [sum(k for part in segments(texts[0], batch_bytes) for k in count_lengths([part], file, cache))]
            else:
                n = count_lengths(texts, file, cache)
            yield pa.RecordBatch.from_arrays([column(b, "id"), column(b, "n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
