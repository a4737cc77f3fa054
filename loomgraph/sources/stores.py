"""Tables that are kept between runs: file hashes, audit entries, vectors, reports, snapshots.

A table is a folder with numbered versions; a write makes a new version and then names it current,
so a failed write leaves the version before in place.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import relational

HASHES = "path string, hash string, size_bytes long, updated_at long"


class Table:
    """A versioned Parquet table; its current version is the one with the highest number that is
    complete (Spark's committer marks it)."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v{v[-1]}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        v = self._versions()
        df.write.mode("overwrite").parquet(f"{self.root}/v{(v[-1] if v else 0) + 1}")


class HashStore(Table):
    """Hashes of files by path: point, range and full reads, upserts in one batch, deletes."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, HASHES)

    def get(self, path: str) -> DataFrame:
        return self.read().where(F.col("path") == path)

    def changed_since(self, when: int) -> DataFrame:
        return self.read().where(F.col("updated_at") > when)

    def paths(self) -> DataFrame:
        return self.read().select("path")

    def upsert(self, rows: DataFrame) -> None:
        """Rows (path, hash, size_bytes, updated_at) replace those of their paths; of several the
        latest counts, and the hash breaks ties."""
        new = rows.select("path", "hash", "size_bytes", "updated_at").withColumn("n", F.lit(1))
        both = self.read().withColumn("n", F.lit(0)).unionByName(new)
        self.write(relational.last_wins(both, ["path"], [F.col("n"), F.col("updated_at"), F.col("hash")]).drop("n"))

    def delete(self, paths: DataFrame) -> None:
        self.write(self.read().join(paths.select("path"), "path", "left_anti"))


class AuditLog(Table):
    """Entries are appended; none is rewritten."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, "at timestamp, action string, detail string")

    def append(self, action: str, detail: str) -> None:
        row = self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(action).alias("action"), F.lit(detail).alias("detail"))
        row.write.mode("append").parquet(f"{self.root}/log")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/log")


class VectorStore:
    """Vectors of a snapshot, stored under its fingerprint: made once, read afterwards."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def load(self, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
        t = Table(self.spark, f"{self.root}/{fingerprint}", "id string, embedding array<float>")
        if not t._versions():
            t.write(make())
        return t.read()


def write_reports(reports: dict[str, DataFrame], root: str) -> None:
    """Each report (one row, column report) as a text file in its own folder."""
    for name, df in reports.items():
        df.select("report").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/{name}")


class Cached:
    """A loaded value for some seconds, or until ``stale`` says that it no longer holds."""

    def __init__(self, load: Callable[[], object], seconds: float = 30, stale: Callable[[object], bool] = lambda _: False, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.stale, self.clock = load, seconds, stale, clock
        self.value, self.until = None, float("-inf")

    def get(self):
        if self.clock() >= self.until or self.stale(self.value):
            self.value, self.until = self.load(), self.clock() + self.seconds
        return self.value
