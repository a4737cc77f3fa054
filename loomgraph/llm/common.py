"""Helpers shared by the operators: shared scratch tables, folds, byte-balanced Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.storage import BROADCAST_ROWS, checked, cut, scope, scratch_dir

__all__ = ["BATCH_BYTES", "BROADCAST_ROWS", "Memo", "checked", "code_points", "column", "fold", "materialise", "scope", "scratch_dir", "share", "slices"]

#: Bytes of text that one Python batch holds at most (a longer single text is a batch alone).
BATCH_BYTES = 4 << 20


def materialise(df: DataFrame, label: str, into: list[str] | None = None) -> DataFrame:
    """``df`` as a table of the shared scratch folder, see storage.cut()."""
    return cut(df, label, into)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text modulo ``n``; a null id falls in fold -1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n)), F.lit(-1)).cast("int")


def share(doc_id: str, salt: str) -> Column:
    """A number in [0, 1) that depends on the id and ``salt`` only, for bounded training samples."""
    h = F.xxhash64(F.lit(salt), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.pmod(h, F.lit(1 << 30)) / F.lit(float(1 << 30))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the texts of each piece hold at most ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop
        del batch
        pa.default_memory_pool().release_unused()  # else a worker keeps the room of its largest batch


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Memo(dict):
    """A dictionary from words to what ``make`` gives for them; it forgets all when it holds
    ``limit`` characters, and keeps no word of more than ``longest``."""

    def __init__(self, make, limit: int = 4 << 20, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.held = make, limit, longest, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            self.held += len(key)
            if self.held > self.limit:
                self.clear()
                self.held = len(key)
            self[key] = value
        return value
