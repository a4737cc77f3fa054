"""Watching a project: changes between listings, sync state, and a loop that keeps a graph current."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import SyncError
from loomgraph.functions import scalars as S
from loomgraph.logs import log
from loomgraph.operators import graph as G
from loomgraph.operators import relational as R
from loomgraph.sources import build, parsing
from loomgraph.sources.stores import HashStore
from loomgraph.storage import cut

from . import batches


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash, size, ts): the files under ``root`` as they are now."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    return b.select(F.substring_index("path", base + "/", -1).alias("path"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("ts"))


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(type, path, old_hash, new_hash) between two listings (path, hash): added, changed, deleted."""
    d = R.drift(now, before)
    kind = F.when(F.col("status") == "modified", "changed").otherwise(F.col("status"))
    a, b = before.select("path", F.col("hash").alias("old_hash")), now.select("path", F.col("hash").alias("new_hash"))
    return d.join(a, "path", "left").join(b, "path", "left").select(kind.alias("type"), "path", "old_hash", "new_hash")


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of change events that are written as JSON lines into a folder: (type, path, hash, ts, seq)."""
    return spark.readStream.schema("type string, path string, hash string, ts timestamp, seq long").json(folder)


class SyncState:
    """What a watcher is doing, in a file that is replaced as a whole: syncing, clean or drifted.

    The folder is on the machine of the watcher.  A second file holds its process id.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _write(self, name: str, text: str) -> None:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, name)
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(path + ".tmp", path)

    def set(self, status: str, **more: object) -> None:
        self._write("sync-state.json", json.dumps({"status": status, "lastUpdated": int(time.time() * 1000), **more}))

    def get(self) -> dict:
        try:
            with open(os.path.join(self.folder, "sync-state.json"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"status": "unknown"}

    def start(self) -> None:
        self._write("watcher.pid", str(os.getpid()))

    def stop(self) -> None:
        path = os.path.join(self.folder, "watcher.pid")
        if os.path.exists(path):
            os.remove(path)

    def require_clean(self) -> None:
        if (status := self.get()["status"]) != "clean":
            raise SyncError(f"the snapshot is {status}")


class Watcher:
    """Keeps a project's graph and snapshot current with its files.

    Each step lists the files, reads those that changed since the last step, again (three times at
    most) where their digest moved meanwhile, replaces their parsed rows, rebuilds the graph and
    tells the handlers which nodes changed and which they reach.  Above ``full_above`` changes the
    whole project is read anew, and no impact is told.
    """

    RETRIES = 3

    def __init__(self, spark: SparkSession, root: str, state_folder: str, modules: list[tuple[str, list[str]]], wanted: Callable[[DataFrame], DataFrame] = build.walk, full_above: int = batches.FULL_ABOVE):
        self.spark, self.root, self.modules, self.wanted, self.full_above = spark, root, modules, wanted, full_above
        self.state, self.hashes, self.handlers = SyncState(state_folder), HashStore(spark, f"{state_folder}/hashes"), []
        self.graph: build.Graph | None = None
        self.snapshot: build.Snapshot | None = None

    def on(self, handler: Callable[[dict], None]) -> None:
        self.handlers.append(handler)

    def _tell(self, kind: str, **data: object) -> None:
        for handler in self.handlers:
            handler({"type": kind, "data": data})

    def _note(self, rows: DataFrame) -> None:
        self.hashes.upsert(rows.select("path", "hash", F.col("size").alias("size_bytes"), F.unix_millis("ts").alias("updated_at")))

    def _build(self, parsed: DataFrame, files: DataFrame) -> None:
        known = build.settings(files)
        self.graph = build.graph_of(parsed, known["aliases"], known["module"])
        self.snapshot = build.compile_snapshot(self.graph, self.modules)

    def start(self) -> None:
        """Reads the whole project and its digests."""
        self.state.start()
        now = cut(self.wanted(listing(self.spark, self.root)), "listing")
        files = parsing.read_tree(self.spark, self.root)
        self._build(parsing.parse_files(self.wanted(files)), files)
        self._note(now)
        self.state.set("clean")

    def stop(self) -> None:
        self.state.stop()
        log("info", "watcher stopped")

    def _stable(self, paths: DataFrame) -> DataFrame:
        """Parsed rows of files whose digest did not move while they were read."""
        done = None
        for _ in range(self.RETRIES):
            parsed = cut(parsing.parse_files(parsing.read_tree(self.spark, self.root).join(paths, "path", "left_semi")), "changed")
            now = listing(self.spark, self.root).select("path", F.col("hash").alias("now"))
            same = parsed.join(now, (parsed["path"] == now["path"]) & (parsed["hash"] == now["now"]), "left_semi")
            done = same if done is None else done.join(same.select("path"), "path", "left_anti").unionByName(same)
            paths = cut(paths.join(done.select("path"), "path", "left_anti"), "moved")
            if paths.isEmpty():
                return done
        return done.unionByName(parsed.join(paths, "path", "left_semi"))

    def step(self) -> str | None:
        """One pass; the mode (full or incremental), or None where nothing changed."""
        now = cut(self.wanted(listing(self.spark, self.root)), "listing")
        found = cut(changes(now, self.hashes.read()), "changes")
        n = found.count()
        if not n:
            return None
        self.state.set("syncing", filesInFlight=n)
        try:
            mode = "full" if n > self.full_above else "incremental"
            files = parsing.read_tree(self.spark, self.root)
            paths, gone = found.select("path"), found.where("type = 'deleted'").select("path")
            if mode == "full":
                self._build(parsing.parse_files(self.wanted(files)), files)
                changed, hit = paths.limit(0).toDF("id"), paths.limit(0).toDF("id")
            else:
                fresh = self._stable(found.where("type <> 'deleted'").select("path"))
                self._build(self.graph.parsed.join(paths, "path", "left_anti").unionByName(fresh), files)
                changed = self.graph.nodes.join(paths.withColumnRenamed("path", "file"), "file", "left_semi").select("id")
                # containment tells nothing of who depends on whom
                used = self.graph.edges.where("type <> 'contains'").select("src", "dst")
                hit = G.bfs(used, changed, copy=False).where("depth > 0").select("id").join(changed, "id", "left_anti")
            self._note(now.join(paths, "path", "left_semi"))
            self.hashes.delete(gone)
            self._tell("graph:updated", mode=mode, changed=cut(changed, "changed"), impacted=cut(hit, "impacted"))
            self.state.set("clean")
            return mode
        except Exception as e:
            self.state.set("drifted", error=str(e))
            near = R.assign_modules(found.select("path"), self.modules, S.glob_regex).select("module_id").distinct()
            self._tell("sync:drifted", reason=str(e), modules=sorted(r[0] for r in near.collect()))
            raise

    def run(self, quiet: float = 0.1, steps: int | None = None) -> None:
        """Steps until interrupted, or so many times, with a pause that lets bursts end."""
        while steps is None or steps > 0:
            time.sleep(quiet)
            self.step()
            steps = None if steps is None else steps - 1
