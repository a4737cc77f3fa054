"""Commands over a project folder: python -m loomgraph.cli COMMAND --root FOLDER …

Contracts are JSON files as snapshot.read_contract() reads them.  Each command prints its result
and returns 0, or 1 where a check fails.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import storage
from loomgraph.api import Project
from loomgraph.errors import EngineError
from loomgraph.logs import log, logger
from loomgraph.operators import clusters, graph
from loomgraph.sources import build, projects, snapshot, stores
from loomgraph.streaming import watch

COMMANDS: dict[str, tuple] = {}


def command(*names: str, help: str = ""):  # noqa: A002
    def add(f):
        for n in names:
            COMMANDS[n] = (f, help or (f.__doc__ or "").split("\n")[0])
        return f

    return add


def show(df: DataFrame, most: int = 50) -> None:
    for r in df.limit(most).collect():
        d = r.asDict(recursive=True)
        print(d["report"] if set(d) == {"report"} else json.dumps(d, default=str, ensure_ascii=False))


def _contract_path(a) -> str:
    return a.contract or os.path.join(a.root, ".loom", "contract")


def _project(spark: SparkSession, a) -> Project:
    path = _contract_path(a)
    contract = snapshot.read_contract(spark, path) if os.path.exists(path) else None
    return Project.analyse(spark, a.root, contract, a.language, a.name or os.path.basename(a.root.rstrip("/")))


def _disk(spark: SparkSession, a) -> DataFrame:
    return watch.listing(spark, a.root).select("path", "hash")


@command("init")
def init(spark, a) -> int:
    """Writes a contract from the clusters of the sources, and an ignore file."""
    folder = os.path.join(a.root, ".loom")
    projects.scaffold(a.root)
    g, _, _ = build.analyse(spark, a.root, None, a.language)
    made = clusters.contract(clusters.detect(g.nodes, g.edges), g, a.name or os.path.basename(a.root.rstrip("/")))
    path = _contract_path(a)
    old = snapshot.read_contract(spark, path) if os.path.exists(path) else None
    kept = made if old is None else snapshot.merge_contract(old, made, old.select("overwrite.mode").first()[0] or "never")
    rows = storage.cut(kept, "contract")
    snapshot.write_contract(rows, path, stores.AuditLog(spark, os.path.join(folder, "audit")), old if old is None else storage.cut(old, "old"))
    ignore = os.path.join(a.root, ".ignore")
    if not os.path.exists(ignore):
        with open(ignore, "w", encoding="utf-8") as f:
            f.write(projects.ignore_file(a.language or "typescript"))
    show(snapshot.modules(rows).select("id", "name", "paths"))
    return 0


@command("analyze", "analyse")
def analyze(spark, a) -> int:
    """Parses and links the sources and writes the snapshot."""
    p = _project(spark, a)
    snapshot.write_snapshot(p.functions, os.path.join(a.root, ".loom", "snapshot"))
    watch.SyncState(os.path.join(a.root, ".loom")).set("clean")
    show(p.summary)
    return 0


@command("diff")
def diff(spark, a) -> int:
    """Files that changed since the digests were stored (all are new the first time)."""
    store = stores.HashStore(spark, os.path.join(a.root, ".loom", "hashes"))
    now = storage.cut(build.walk(watch.listing(spark, a.root)), "listing")
    show(watch.changes(now, store.read()).orderBy("path"))
    store.upsert(now.select("path", "hash", F.col("size").alias("size_bytes"), F.unix_millis("ts").alias("updated_at")))
    return 0


@command("validate")
def validate(spark, a) -> int:
    """Fails where a boundary rule is broken or the contract does not read."""
    p = _project(spark, a)
    broken = storage.cut(p.violations(), "violations")
    show(broken)
    return int(not broken.isEmpty())


@command("boundaries")
def boundaries(spark, a) -> int:
    """Calls between modules, counted."""
    p = _project(spark, a)
    show(graph.cross_calls(graph.with_modules(p.calls, p.functions)).orderBy(F.desc("calls"), "from_module", "to_module"))
    return 0


@command("ci")
def ci(spark, a) -> int:
    """Fails on broken rules, or a share of dead functions above --most-dead percent."""
    p = _project(spark, a)
    broken = p.violations().count()
    dead, total = p.dead().where("type = 'function'").count(), p.functions.count()
    share = round(dead / total * 1000) / 10 if total else 0.0
    print(json.dumps({"violations": broken, "dead": dead, "functions": total, "dead_percent": share}))
    return int(broken > 0 or (a.most_dead is not None and share > a.most_dead))


@command("dead-code")
def dead_code(spark, a) -> int:
    """Functions and classes that nothing uses."""
    show(_project(spark, a).dead(a.module).orderBy("module_id", "id"))
    return 0


@command("stats")
def stats(spark, a) -> int:
    """Sizes of the project and of its modules."""
    p = _project(spark, a)
    show(p.stats())
    show(p.overview().orderBy("module_id"))
    return 0


@command("doctor")
def doctor(spark, a) -> int:
    """Whether the snapshot is complete, current and within its rules."""
    p = _project(spark, a)
    probes = storage.cut(p.probes(p.files.select("path", "hash")), "probes")
    show(probes)
    return int(probes.where("NOT passed AND probe NOT IN ('has no dead code')").count() > 0)


@command("context")
def context(spark, a) -> int:
    """Context for a task (--task) in a format, or the impact of a file (--file), or the modules."""
    p = _project(spark, a)
    if a.task:
        show(p.render(a.task, a.format, a.budget))
    elif a.file:
        show(p.impact(a.file).orderBy("depth", "id"))
    else:
        show(p.overview().orderBy("module_id"))
    return 0


@command("intent")
def intent(spark, a) -> int:
    """What a prompt (--task) intends, its conflicts and whether it may proceed."""
    p = _project(spark, a)
    show(p.intents(a.task or ""))
    verdict = p.preflight(a.task or "", p.constraints).first()
    print(json.dumps(verdict.asDict()))
    return int(not verdict["approved"])


@command("visualize", "visualise")
def visualize(spark, a) -> int:
    """Diagrams of the project, or of a module, written below .loom/diagrams."""
    p = _project(spark, a)
    made = {f"module-{a.module}": p.diagram("module", a.module)} if a.module else p.diagrams()
    stores.write_reports(made, os.path.join(a.root, ".loom", "diagrams"))
    print("\n".join(sorted(made)))
    return 0


@command("watch")
def watch_(spark, a) -> int:
    """Keeps the graph current with the files, for --steps passes or until interrupted."""
    p = _project(spark, a)
    mods = [(r["id"], r["paths"] or []) for r in p.modules.select("id", "paths").collect()]  # what people declare
    w = watch.Watcher(spark, a.root, os.path.join(a.root, ".loom"), mods)
    w.on(lambda e: log("info", e["type"], mode=e["data"].get("mode")))
    w.start()
    try:
        w.run(a.quiet, a.steps)
    except KeyboardInterrupt:
        pass
    finally:
        w.stop()
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomgraph", description="Commands over a project folder.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, text) in COMMANDS.items():
        c = sub.add_parser(name, help=text)
        c.add_argument("--root", default=".")
        for option, kind, default in (("contract", str, None), ("language", str, None), ("name", str, ""), ("module", str, None), ("task", str, None), ("file", str, None), ("format", str, "plain"), ("budget", int, 6000), ("most-dead", float, None), ("quiet", float, 0.1), ("steps", int, None)):
            c.add_argument(f"--{option}", type=kind, default=default)
    a = p.parse_args(argv)
    logger()
    try:
        return COMMANDS[a.command][0](spark or storage.session("loomgraph"), a)
    except EngineError as e:
        log("error", str(e), code=e.code)
        return 1


if __name__ == "__main__":
    sys.exit(main())
