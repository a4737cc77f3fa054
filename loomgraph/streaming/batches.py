"""Change batches: debounce, deduplication and mode switch, in batch and streaming form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Events of a batch beyond which everything is recomputed.
FULL_ABOVE = 15


def latest(changes: DataFrame, key: str = "path") -> DataFrame:
    """The last change of each path; a later sequence number wins equal times."""
    order = F.struct("ts", "seq")
    row = F.max_by(F.struct(*[c for c in changes.columns if c != key]), order).alias("r")
    return changes.groupBy(key).agg(row).select(key, "r.*")


def debounce(changes: DataFrame, key: str, gap: str) -> DataFrame:
    """Batches that a quiet gap closes, per key: first and last time, events and distinct paths."""
    w = F.session_window("ts", gap)
    return changes.groupBy(key, w.alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"), F.size(F.collect_set("path")).cast("long").alias("paths"))


def with_mode(batches: DataFrame, full_above: int = FULL_ABOVE) -> DataFrame:
    return batches.withColumn("mode", F.when(F.col("events") > full_above, "full").otherwise("incremental"))


def debounced_stream(changes: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """The streaming form of debounce: batches are emitted when the watermark passes their gap."""
    return debounce(changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), key, gap)


def unchanged_dropped(changes: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """Streaming: drops a change whose hash is that of the key's change before; state per key."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = changes.schema

    def step(k, frames, state):
        (last,) = state.get if state.exists else (None,)
        for pdf in frames:
            pdf = pdf.sort_values(["ts", "seq"])
            before = pdf[value].shift(1)
            if len(pdf):
                before.iloc[0] = last
                last = pdf[value].iloc[-1]
            yield pdf[(before.isna()) | (before != pdf[value])]
        state.update((last,))

    return changes.groupBy(key).applyInPandasWithState(step, schema, f"{value} string", "append", GroupStateTimeout.NoTimeout)


def run_batches(changes: DataFrame, handle: Callable[[DataFrame, str], None], checkpoint: str, full_above: int = FULL_ABOVE) -> StreamingQuery:
    """Feeds each micro-batch, deduplicated, to ``handle`` with its mode; all available input once."""

    def each(batch: DataFrame, _: int) -> None:
        rows = latest(batch)
        n = rows.limit(full_above + 1).count()
        if n:
            handle(rows, "full" if n > full_above else "incremental")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
