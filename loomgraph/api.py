"""The tools of the engine over one snapshot: tables in, DataFrames out."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import AccessDenied, NotFound
from loomgraph.functions import scalars as S
from loomgraph.operators import clusters, context, formats, graph, intents, relational, reports, search
from loomgraph.sources import build, contextfiles, parsing, snapshot, stores
from loomgraph.storage import cut

#: Rows that lists of changes show at most.
LISTED = 50


def inside(path: str) -> str:
    """A path below the project's root, normalised; others are denied."""
    clean = posixpath.normpath(path.replace("\\", "/"))
    if clean.startswith(("/", "../")) or clean == "..":
        raise AccessDenied(path)
    return clean


@dataclass
class Project:
    """A snapshot: functions (id, name, file, module_id, is_exported, size, …), calls (src, dst),
    modules (id, name, …), rules (ord, kind, from_module, to_modules), files (path, hash,
    module_id), and optionally routes, decisions, vectors, classes, all nodes and edges, file
    imports (src, dst), texts (path, text), declared constraints (raw) and context files."""

    functions: DataFrame
    calls: DataFrame
    modules: DataFrame
    rules: DataFrame
    files: DataFrame
    routes: DataFrame | None = None
    decisions: DataFrame | None = None
    vectors: DataFrame | None = None
    classes: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    texts: DataFrame | None = None
    constraints: DataFrame | None = None
    context_files: DataFrame | None = None
    summary: DataFrame | None = None
    name: str = ""
    language: str = ""

    @classmethod
    def analyse(cls, spark: SparkSession, root: str, contract: DataFrame | None = None, language: str | None = None, name: str = "") -> Project:
        """The project of the sources under ``root``; its modules are those that the contract
        declares, or else clusters of its files."""
        declared = None
        if contract is not None:
            mods = snapshot.modules(contract)
            declared = [(r["id"], r["paths"] or []) for r in mods.orderBy("ord").select("id", "paths").collect()]  # what people declare
        g, snap, declared = build.analyse(spark, root, declared, language)
        if contract is None:
            contract = cut(clusters.contract(clusters.detect(g.nodes, g.edges), g, name), "contract")
        mods, raw = snapshot.modules(contract), snapshot.rules(contract)
        rules = raw.select("ord", S.rule_kind(F.col("raw")).alias("kind"), S.rule_from(F.col("raw")).alias("from_module"), S.rule_to(F.col("raw")).alias("to_modules"))
        # files are nodes too: impact counts them
        all_nodes = relational.assign_modules(g.nodes.withColumn("path", F.col("file")), declared, S.glob_regex).drop("path")
        tree = parsing.read_tree(spark, root)
        lang = contract.select("project.language").first()[0]
        return cls(snap.functions, g.calls(), mods, rules, snap.files, snap.routes, snapshot.decisions(contract), None, snap.classes, all_nodes, g.edges, tree, raw.select("raw"), contextfiles.discover(tree), snap.summary, name, lang or "")

    def overview(self) -> DataFrame:
        f = self.functions.groupBy("module_id").agg(F.count("*").alias("functions"), F.count_distinct("file").alias("files"), F.count_if("is_exported").alias("exported"))
        return self.modules.select(F.col("id").alias("module_id"), "name").join(f, "module_id", "left").fillna(0)

    def find_file(self, path: str) -> DataFrame:
        """Functions of a file: by its path, else by its base name; neither is an error."""
        exact = self.functions.where(F.col("file") == path)
        if not exact.isEmpty():
            return exact
        base = self.functions.where(F.substring_index("file", "/", -1) == path.rsplit("/", 1)[-1])
        if base.isEmpty():
            raise NotFound(path)
        return base

    def changed(self, path: str) -> DataFrame:
        """(id): the functions of a file and, where nodes are kept, the file and all else in it."""
        own = self.find_file(path).select("id", "file")
        if self.nodes is None:
            return own.select("id")
        return self.nodes.join(own.select("file").distinct(), "file", "left_semi").where("type IN ('file', 'function')").select("id")

    def impact(self, path: str) -> DataFrame:
        """(id, module_id, depth, risk) of what depends on a file, through calls and imports."""
        if self.nodes is None or self.edges is None:
            return graph.impact(self.calls, self.functions, self.find_file(path).select("id"))
        used = self.edges.where("type <> 'contains'").select("src", "dst")
        return graph.impact(used, self.nodes, self.changed(path), copy=False)

    def before_edit(self, path: str) -> DataFrame:
        """One row on a file: impacted, exported functions at risk, broken rules, cycles."""
        own = self.find_file(path).select("id", "is_exported")
        hit = self.impact(path).agg(F.count("*").alias("impacted"))
        risk = own.agg(F.count_if("is_exported").alias("exported_at_risk"))
        broken = self.violations().join(own.select(F.col("id").alias("src")), "src", "left_semi").agg(F.count("*").alias("violations"))
        cyc = graph.on_cycles(self.calls).join(own, "id", "left_semi").agg((F.count("*") > 0).alias("reaches_cycle"))
        return hit.crossJoin(risk).crossJoin(broken).crossJoin(cyc)  # one row each

    def before_edits(self, paths: list[str]) -> DataFrame:
        """A row for each file as before_edit(), and one for all (path null) that sums them up."""
        out = None
        for p in paths:
            one = self.before_edit(p).withColumn("path", F.lit(p))
            out = one if out is None else out.unionByName(one)
        total = out.agg(F.sum("impacted").alias("impacted"), F.sum("exported_at_risk").alias("exported_at_risk"), F.sum("violations").alias("violations"), F.max("reaches_cycle").alias("reaches_cycle"), F.lit(None).cast("string").alias("path"))
        return out.unionByName(total).withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))

    def cycle(self, function: str) -> str | None:
        """The names on a cycle that a function reaches, or None."""
        ids = graph.cycle_of(self.calls, function)
        if ids is None:
            return None
        names = {r["id"]: r["name"] for r in self.functions.where(F.col("id").isin(ids)).select("id", "name").collect()}
        return " → ".join(names.get(i, i) for i in ids)

    def violations(self) -> DataFrame:
        return graph.violations(graph.with_modules(self.calls, self.functions), self.rules)

    def module(self, name: str) -> DataFrame:
        """Functions of a module with the names of what they call and are called by."""
        if self.modules.where(F.col("id") == name).isEmpty():
            raise NotFound(name)
        n = self.functions.select("id", F.col("name").alias("n"))
        out = self.calls.join(n, F.col("dst") == n["id"]).groupBy(F.col("src").alias("fid")).agg(F.array_sort(F.collect_set("n")).alias("calls"))
        into = self.calls.join(n, F.col("src") == n["id"]).groupBy(F.col("dst").alias("fid")).agg(F.array_sort(F.collect_set("n")).alias("called_by"))
        f = self.functions.where(F.col("module_id") == name)
        return f.join(out, F.col("id") == out["fid"], "left").drop("fid").join(into, F.col("id") == into["fid"], "left").drop("fid")

    def function(self, name: str) -> DataFrame:
        q = F.lit(name)
        return self.functions.where((F.col("name") == q) | F.endswith("name", F.concat(F.lit("."), q)) | F.contains("id", q))

    def function_detail(self, name: str) -> DataFrame:
        """The functions of a name with the names of what they call and are called by, and, where
        texts are kept, their bodies; no function of the name is an error."""
        found = self.function(name)
        if found.isEmpty():
            raise NotFound(name)
        f = found.drop("calls", "called_by")
        f = f.join(self._names("src", "dst", "calls"), "id", "left").join(self._names("dst", "src", "called_by"), "id", "left")
        return reports.bodies(f, self.texts, squeeze=False) if self.texts is not None and "start_line" in f.columns else f

    def _names(self, own: str, other: str, label: str) -> DataFrame:
        n = self.functions.select(F.col("id").alias(other), F.col("name").alias("n"))
        return self.calls.distinct().join(n, other).groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_set("n")).alias(label))

    def file(self, path: str) -> DataFrame:
        """One row (path, lines, text) of a file of the project."""
        clean = inside(path)
        row = self.texts.where(F.col("path") == clean).select("path", F.size(F.split("text", "\n")).alias("lines"), "text")
        if row.isEmpty():
            raise NotFound(path)
        return row

    def read_file(self, path: str, functions: list[str]) -> DataFrame:
        """One row (report): functions of a file by name, each with what is known of it; names that
        the file lacks are said so."""
        clean, known = inside(path), self.texts.sparkSession.createDataFrame(list(enumerate(functions)), "place int, wanted string")
        own = self.functions.where((F.col("file") == clean) | F.endswith("file", F.lit("/" + clean)))
        hit = known.join(own, (F.col("name") == F.col("wanted")) | F.endswith("name", F.concat(F.lit("."), F.col("wanted"))), "left")
        first = relational.top_in(hit, ["place"], [F.col("id")], 1).drop("calls", "called_by")
        first = first.join(self._names("src", "dst", "calls"), "id", "left").join(self._names("dst", "src", "called_by"), "id", "left")
        f = reports.bodies(first, self.texts, squeeze=False)
        some = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"// {label}: "), v))
        params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(": "), F.coalesce(p["type"], F.lit("any")))), ", ")
        head = F.concat_ws("\n", F.concat(F.lit("// ── "), "name", F.lit(" ──")), F.concat(F.lit("// File: "), "file", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")), some("Module", F.col("module_id")), some("Purpose", F.col("purpose")), some("Params", params), some("Returns", F.col("return_type")), F.when(F.coalesce("is_async", F.lit(False)), F.lit("// Async: true")), F.when(F.coalesce("is_exported", F.lit(False)), F.lit("// Exported: true")), some("Called by", F.array_join("called_by", ", ")), some("Calls", F.array_join("calls", ", ")))
        text = F.when(F.col("id").isNull(), F.concat(F.lit('// Function "'), "wanted", F.lit(f'" not found in {path}'))).otherwise(F.concat_ws("\n", head, "body"))
        return f.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))), lambda x: x["text"]), "\n\n").alias("report"))  # what a caller names

    def declared_constraints(self) -> DataFrame:
        """(kind, text): declared constraints and decisions."""
        c = self.constraints.select(F.lit("constraint").alias("kind"), F.col("raw").alias("text"))
        return c if self.decisions is None else c.unionByName(self.decisions.select(F.lit("decision").alias("kind"), F.concat("title", F.lit(": "), "reason").alias("text")))

    def all_routes(self) -> DataFrame:
        """Routes of the sources in order of path, method, file and line."""
        if self.routes is None:
            raise NotFound("routes")
        return self.routes.orderBy("path", "method", "file", "line")

    def select(self, module: str | None = None, exported: bool | None = None, asynchronous: bool | None = None) -> DataFrame:
        """Functions of a module, exported or not, async or not."""
        f = self.functions
        for column, want in (("module_id", module), ("is_exported", exported), ("is_async", asynchronous)):
            f = f if want is None else f.where(F.coalesce(F.col(column), F.lit(False)) == F.lit(want) if column != "module_id" else F.col(column) == want)
        return f

    def search(self, text: str, most: int = 20) -> DataFrame:
        q = F.lit(text.lower())
        return self.functions.where(F.contains(F.lower("name"), q) | F.contains(F.lower("id"), q)).orderBy("id").limit(most)

    def did_you_mean(self, name: str, most: int = 5) -> DataFrame:
        return self.functions.select("name", search.similarity(F.col("name"), name).alias("score")).distinct().where("score > 0.5").orderBy(F.desc("score"), "name").limit(most)

    def semantic_search(self, query: DataFrame, most: int = 10) -> DataFrame:
        if self.vectors is None:
            raise NotFound("vectors")
        return search.nearest(self.vectors, "embedding", query, most, "id").join(self.functions.select("id", "name", "file"), "id")

    def usages(self, name: str) -> DataFrame:
        used = self.calls.join(self.function(name).select(F.col("id").alias("dst")), "dst", "left_semi")
        return used.join(self.functions.select(F.col("id").alias("src"), "name", "file"), "src").select(F.col("src").alias("id"), "name", "file").distinct()

    def dead(self, module: str | None = None) -> DataFrame:
        """Dead functions and, where classes and edges are kept, dead classes."""
        out = graph.dead(self.functions, self.calls, self.routes).select("id", "name", "file", "module_id", F.lit("function").alias("type"), "reason")
        if self.classes is not None and self.edges is not None:
            out = out.unionByName(graph.dead_classes(self.classes, self.edges).select("id", "name", "file", "module_id", F.lit("class").alias("type"), "reason"))
        return out if module is None else out.where(F.col("module_id") == module)

    def stats(self) -> DataFrame:
        return self.functions.agg(F.count("*").alias("functions"), F.count_distinct("file").alias("files"), F.count_if("is_exported").alias("exported"), F.round(F.avg("size")).alias("average_size"))

    def changes(self, disk: DataFrame, digits: int = 16) -> DataFrame:
        """(path, status) of files (path, hash) against the snapshot; a file whose digest the
        snapshot lacks does not count as modified."""
        told = self.files.where(F.coalesce("hash", F.lit("")) != "").select("path")
        d = relational.drift(disk, self.files, digits)
        return d.where("status <> 'modified'").unionByName(d.where("status = 'modified'").join(told, "path", "left_semi"))

    def listed_changes(self, disk: DataFrame, most: int = LISTED) -> DataFrame:
        """(status, total, paths): how many files were added, modified and deleted, and the first of
        them.  Only source files outside skipped folders count as added."""
        d = self.changes(disk)
        d = d.where("status <> 'added'").unionByName(build.walk(d.where("status = 'added'")))
        first = relational.top_in(d, ["status"], [F.col("path")], most).groupBy("status").agg(F.array_sort(F.collect_list("path")).alias("paths"))
        return d.groupBy("status").agg(F.count("*").alias("total")).join(first, "status")

    def session(self, disk: DataFrame) -> DataFrame:
        """The five modules with most modified files."""
        m = self.changes(disk).where("status = 'modified'").join(self.files.select("path", "module_id"), "path")
        return m.groupBy("module_id").agg(F.count("*").alias("modified")).orderBy(F.desc("modified"), "module_id").limit(5)

    def context(self, task: str, budget: int = 6000, files: list[str] = (), focus: list[str] = (), hops: int = 4) -> DataFrame:
        """Functions for a task in order of relevance, within a token budget."""
        import re

        words = [w for w in re.sub(r"[^a-z0-9\s_-]", " ", task.lower()).split() if len(w) > 2 and w not in S.CONTEXT_STOP]
        start = context.seeds(self.functions, self.modules, task, words, files, focus)
        start = cut(start, "seeds")
        return context.pack(context.scores(self.functions, self.calls, start, words, hops), budget, seeded=not start.isEmpty()).join(self.functions, "id").orderBy("place")

    def session_context(self, disk: DataFrame) -> DataFrame:
        """One row: sizes, broken rules, changed files and the modules with most of them."""
        n = lambda df, c: df.agg(F.count("*").alias(c))
        hot = self.session(disk).agg(F.array_sort(F.collect_list(F.struct(F.col("modified"), F.col("module_id")))).alias("hot_modules"))
        broken = n(self.violations(), "violations")
        sizes = n(self.functions, "functions").crossJoin(n(self.files, "files")).crossJoin(n(self.modules, "modules"))
        return sizes.crossJoin(broken).crossJoin(n(self.changes(disk), "changes")).crossJoin(hot).withColumn("passes", F.col("violations") == 0)  # one row each

    def render(self, task: str, form: str = "plain", budget: int = 6000, with_bodies: bool = True) -> DataFrame:
        """One row (report): the context for a task in a format of formats.FORMATS."""
        import re

        f = cut(self.context(task, budget), "context").drop("calls", "called_by", "score")
        f = f.join(self._names("src", "dst", "calls"), "id", "left").join(self._names("dst", "src", "called_by"), "id", "left")
        none = F.array().cast("array<string>")
        f = f.withColumn("calls", F.coalesce("calls", none)).withColumn("called_by", F.coalesce("called_by", none))
        f = reports.bodies(f, self.texts) if with_bodies and self.texts is not None else f
        words = [w for w in re.sub(r"[^a-z0-9\s_-]", " ", task.lower()).split() if len(w) > 2 and w not in S.CONTEXT_STOP]
        mods = self.modules
        for c in ("description", "intent"):
            mods = mods if c in mods.columns else mods.withColumn(c, F.lit(""))
        rules = [r["raw"] for r in self.constraints.collect()] if self.constraints is not None else []  # what people declare
        told = [(r["title"], r["reason"]) for r in self.decisions.select("title", "reason").collect()] if self.decisions is not None else []
        counts = {"modules": self.modules.count(), "functions": self.functions.count(), "selected": f.count()}
        return formats.render(formats.Context(f, mods, task, words, self.name, self.language, "", self.routes, self.context_files, rules, told, counts), form)

    def embed(self, store: stores.VectorStore, encode=None) -> Project:
        """The project with vectors of its functions: read by fingerprint, or made by an encoder."""
        key = snapshot.fingerprint(self.functions).first()[0]
        text = search.embedding_text(F.col("name"), F.col("purpose"), F.col("params"), F.col("return_type"))
        make = lambda: search.embed(self.functions.select("id", text.alias("text")), encode or search.hashed_encoder())
        return replace(self, vectors=store.load(key, make))

    def semantic(self, query: str, encode=None, most: int = 10) -> DataFrame:
        """The functions nearest to a text, by the encoder that made the vectors."""
        spark = self.functions.sparkSession
        vector = search.embed(spark.createDataFrame([("q", query)], "id string, text string"), encode or search.hashed_encoder())
        return self.semantic_search(vector, most)

    def intents(self, prompt: str) -> DataFrame:
        return intents.interpret(prompt, self.functions, self.modules, classes=self.classes)

    def preflight(self, prompt: str, constraints: DataFrame) -> DataFrame:
        found = self.intents(prompt)
        return intents.preflight(found, intents.conflicts(found, constraints, self.functions, self.modules, self.files))

    def decide(self, action: str, *args, **values) -> DataFrame:
        """Decisions: list all, get one by id (none is an error), or after add, update or remove."""
        if action == "list":
            return self.decisions
        if action == "get":
            one = self.decisions.where(F.col("id") == args[0])
            if one.isEmpty():
                raise NotFound(args[0])
            return one
        f = {"add": snapshot.add_decision, "update": snapshot.update_decision, "remove": snapshot.remove_decision}[action]
        self.decisions = f(self.decisions, *args, **values)
        return self.decisions

    def health(self) -> DataFrame:
        moded = graph.with_modules(self.calls, self.functions)
        if self.edges is None:
            return graph.module_health(moded, self.functions)
        imports = self.edges.where("type = 'imports'").select("src", "dst")
        return graph.module_health(moded, self.functions, graph.with_modules(imports, self.files.select(F.col("path").alias("id"), "module_id")))

    def diagram(self, kind: str = "modules", of: str = "") -> DataFrame:
        """One row (report): modules, health, matrix, entries, or of one module, file or function:
        module, capsule, impact, flow."""
        moded = graph.with_modules(self.calls, self.functions)
        names = {r["id"]: r["name"] for r in self.modules.where(F.col("id") == of).select("id", "name").collect()}
        if kind in ("module", "capsule") and not names:
            raise NotFound(of)
        if kind == "health":
            return reports.health_diagram(self.health())
        if kind == "module":
            return reports.module_detail(self.functions, self.calls, graph.important(self.functions, moded), of, names[of])
        if kind == "capsule":
            return reports.capsule(self.functions, self.calls, of, names[of])
        if kind == "impact":
            return reports.impact_diagram(self.functions, self.calls, self.find_file(of).select("id"), cut(self.impact(of), "impact"))
        if kind == "entries":
            return reports.entry_diagram(self.functions, self.calls)
        if kind == "flow":
            return reports.flow_diagram(self.functions, self.calls, of)
        return reports.module_diagram(graph.cross_calls(moded))

    def diagrams(self) -> dict[str, DataFrame]:
        """The diagrams of the whole project, for stores.write_reports()."""
        out = {k: self.diagram(k) for k in ("modules", "health", "entries")}
        for r in self.modules.select("id").collect():  # what people declare
            out |= {f"{k}-{r['id']}": self.diagram(k, r["id"]) for k in ("module", "capsule")}
        return out

    def probes(self, disk: DataFrame) -> DataFrame:
        """(probe, passed): whether the snapshot is complete, current and within its rules."""
        rows = [
            ("has functions", self.functions.limit(1).agg(F.count("*") > 0)), ("has modules", self.modules.limit(1).agg(F.count("*") > 0)), ("has calls", self.calls.limit(1).agg(F.count("*") > 0)),
            ("is current", self.changes(disk).agg(F.count("*") == 0)), ("keeps its rules", self.violations().agg(F.count("*") == 0)), ("has no dead code", self.dead().agg(F.count("*") == 0)), ("has no unknown module", self.functions.agg(F.count_if(F.col("module_id") == "unknown") == 0)),
        ]
        out = None
        for name, df in rows:
            one = df.toDF("passed").select(F.lit(name).alias("probe"), "passed")
            out = one if out is None else out.unionByName(one)
        return out
