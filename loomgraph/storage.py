"""Scratch tables in the cluster's shared folder, and session defaults."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table (an id or two) that is broadcast at most, see checked().
BROADCAST_ROWS = 1_000_000


def session(app: str = "loomgraph", **conf: str) -> SparkSession:
    """A session with the defaults that the operators assume: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch").rstrip("/")


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def cut(df: DataFrame, label: str = "table", into: list[str] | None = None) -> DataFrame:
    """``df`` written as a table in the scratch folder and read again, without its lineage.

    Later stages survive lost executors without recomputing what stands before.  The table stays
    until the scope() that it was written in ends, or for good without one, or where its path is
    put ``into`` a list.
    """
    path = f"{scratch_dir(df.sparkSession)}/loomgraph-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    if (own := _scope.get() if into is None else into) is not None:
        own.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession, also: list[str] | None = None) -> Iterator[None]:
    """Deletes, at its end, the tables that cut() wrote within it and in no inner scope, and those
    of the paths ``also``.

    Results that read them have to be written or collected before; other results are untouched.
    """
    own = [*(also or [])]
    mark = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(mark)
        for path in own:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checked(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow side of a join, marked for broadcast if it has at most ``most`` rows; a larger one
    is left to a shuffled join."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any name, whole, or None where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()
