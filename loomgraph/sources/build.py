"""From parsed files to a dependency graph and a snapshot: nodes, edges, modules, and back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import relational as R
from loomgraph.storage import cut, read_text

from . import parsing, projects, snapshot

#: How an import path ends on a file, in order of trial, for each language.
ENDINGS = {
    "typescript": [".ts", ".tsx", "/index.ts", "/index.tsx"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx", "/index.mjs", ".ts", ".tsx", "/index.ts", "/index.tsx"],
}
#: Files that may hold path aliases, by language, the first that is there counts.
ALIAS_FILES = {"typescript": ["tsconfig.json"], "javascript": ["jsconfig.json", "tsconfig.json"]}
# Folders that a walk over a project leaves out, and what counts as a source file.
SKIPPED_FOLDERS = ["node_modules", ".git", "dist"]
SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".py"]


def walk(files: DataFrame, skipped: list[str] = SKIPPED_FOLDERS) -> DataFrame:
    """Files (path, …) with a source file's extension and in no skipped folder."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    known = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1))).isin(SOURCE_EXTENSIONS)
    return files.where(~F.arrays_overlap(folders, F.lit(skipped)) & known & F.contains("path", F.lit(".")))


def settings(files: DataFrame) -> dict:
    """Path aliases by language and the module path, from the few manifests among files (path, text)."""
    names = F.rlike("path", F.lit(r"(^|/)(tsconfig[^/]*|jsconfig)\.json$")) | (F.col("path") == "go.mod")
    texts = {r["path"]: r["text"] for r in files.where(names).select("path", "text").collect()}  # manifests only
    found = {}
    for lang, tried in ALIAS_FILES.items():
        path = next((p for p in tried if p in texts), None)
        got = projects.aliases(path, texts.get, lang == "typescript") if path else {}
        found[lang] = [(a.replace("/*", ""), ts[0].replace("/*", "")) for a, ts in got.items() if ts]
    return {"aliases": found, "module": projects.go_module(texts.get("go.mod") or "")}


def resolve(parsed: DataFrame, aliases: dict[str, list[tuple[str, str]]] | None = None, module: str = "") -> DataFrame:
    """Imports (file, ord, source, names, is_default, is_dynamic, language, target) of parsed
    files; the target is a path, or '' for what lies outside the project."""
    imports = parsed.select("language", F.posexplode("imports").alias("ord", "i")).select("language", "ord", "i.file", "i.source", "i.names", "i.is_default", "i.is_dynamic")
    files, out = parsed.select("path"), None
    for lang in ("typescript", "javascript", "go"):
        own = imports.where(F.col("language") == lang)
        found = R.resolve_packages(own, files, module) if lang == "go" else R.resolve_imports(own, files, (aliases or {}).get(lang, []), ENDINGS[lang])
        out = found if out is None else out.unionByName(found)
    return imports.join(out, ["file", "source"], "left").withColumn("target", F.coalesce("target", F.lit("")))


def nodes(parsed: DataFrame) -> DataFrame:
    """(id, type, name, file, …) of files, functions, methods, classes and generics; of entities
    with one id the last in order of file, kind and line counts."""
    bare = {"start_line": "int", "end_line": "int", "params": f"array<{parsing.PARAM}>", "return_type": "string", "is_exported": "boolean", "is_async": "boolean", "purpose": "string", "edge_cases": "array<string>", "error_handling": "array<struct<line:int,type:string,detail:string>>", "kind": "string"}

    def shaped(df: DataFrame, kind: str, rank: int) -> DataFrame:
        have = set(df.columns)
        cols = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in bare.items()]
        return df.select("id", F.lit(kind).alias("type"), "name", "file", F.col("hash") if "hash" in have else F.lit(None).cast("string").alias("hash"), F.lit(rank).alias("rank"), *cols)

    files = parsed.select(F.col("path").alias("id"), F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("file"), "hash")
    parts = [(files, "file", 0), (parsing.child(parsed, "functions"), "function", 1), (parsing.child(parsed, "classes"), "class", 2), (parsed.select(F.explode("classes").alias("c")).select(F.explode("c.methods").alias("m")).select("m.*"), "function", 2), (parsing.child(parsed, "generics"), "generic", 3)]
    out = None
    for df, kind, rank in parts:
        one = shaped(df, kind, rank)
        out = one if out is None else out.unionByName(one)
    return R.last_wins(out, ["id"], [F.col("file"), F.col("rank"), F.coalesce("start_line", F.lit(0)), F.col("type")]).drop("rank")


def edges(parsed: DataFrame, imports: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """(src, dst, type, confidence): imports between files of the project, calls and containment."""
    ids = all_nodes.select(F.col("id").alias("dst"))
    out = imports.where("target <> ''").select(F.col("file").alias("src"), F.col("target").alias("dst")).join(ids, "dst", "left_semi").select("src", "dst", F.lit("imports").alias("type"), F.lit(1.0).alias("confidence"))
    listed = imports.where("target <> ''").select("file", "target", "ord", F.posexplode("names").alias("k", "name")).select("file", "name", "target", F.struct("ord", "k").alias("ord"))
    fns = parsing.all_functions(parsed)
    made = fns.select(F.col("id").alias("src"), "file", F.explode(F.array_distinct("calls")).alias("name"))
    calls = R.resolve_calls(made, listed, all_nodes.where("type = 'function'")).select("src", "dst", F.lit("calls").alias("type"), "confidence")
    own = parsed.select(F.col("path").alias("src"), F.explode(F.concat(F.transform("functions", lambda f: f["id"]), F.transform("classes", lambda c: c["id"]))).alias("dst"))
    methods = parsed.select(F.explode("classes").alias("c")).select(F.col("c.id").alias("src"), F.explode(F.transform("c.methods", lambda m: m["id"])).alias("dst"))
    holds = own.unionByName(methods).select("src", "dst", F.lit("contains").alias("type"), F.lit(None).cast("double").alias("confidence"))
    return out.unionByName(calls).unionByName(holds)


@dataclass
class Graph:
    """Nodes and edges of a project, written once; its parsed files and resolved imports."""

    nodes: DataFrame
    edges: DataFrame
    parsed: DataFrame
    imports: DataFrame

    def counts(self) -> tuple[int, int]:
        return self.nodes.count(), self.edges.count()

    def calls(self) -> DataFrame:
        return self.edges.where("type = 'calls'").select("src", "dst")


def graph_of(parsed: DataFrame, aliases: dict | None = None, module: str = "") -> Graph:
    """The graph of parsed files: nodes first, then edges between them; each table is written, so
    analyses do not parse again."""
    parsed = cut(parsed, "parsed")
    imports = cut(resolve(parsed, aliases, module), "imports")
    all_nodes = cut(nodes(parsed), "nodes")
    return Graph(all_nodes, cut(edges(parsed, imports, all_nodes), "edges"), parsed, imports)


@dataclass
class Snapshot:
    """What a graph and the declared modules compile to; every table has one row for each entity."""

    functions: DataFrame
    classes: DataFrame
    generics: DataFrame
    files: DataFrame
    modules: DataFrame
    routes: DataFrame
    edges: DataFrame
    summary: DataFrame
    context: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def compile_snapshot(graph: Graph, modules: list[tuple[str, list[str]]]) -> Snapshot:
    """The snapshot of a graph; ``modules`` are (id, path globs) in order of declaration.

    functions have calls and called_by (ids), size, module_id and a purpose (from the name where no
    comment tells one); exported generics of one name and kind are one row with the other files;
    modules have the files that their globs match and a digest of these files' digests; the
    summary counts nodes and edges and digests the modules and the functions.
    """
    regex = S.glob_regex
    assigned = R.assign_modules(graph.nodes.withColumn("path", F.col("file")), modules, regex).drop("path")
    calls = graph.edges.where("type = 'calls'")
    out = calls.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("calls"))
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_list("src")).alias("called_by"))
    none = F.array().cast("array<string>")
    told = F.when(F.coalesce("purpose", F.lit("")) != "", F.col("purpose"))
    size = (F.col("end_line") - F.col("start_line") + 1).cast("long")
    fns = assigned.where("type = 'function'").join(out, "id", "left").join(into, "id", "left")
    fns = fns.withColumn("calls", F.coalesce("calls", none)).withColumn("called_by", F.coalesce("called_by", none)).withColumn("size", size)
    fns = cut(fns.withColumn("purpose", F.coalesce(told, S.purpose(F.col("name"), F.col("params"), F.col("return_type")))).drop("type", "kind"), "functions")
    classes = assigned.where("type = 'class'").withColumn("purpose", F.coalesce(told, S.purpose(F.col("name")))).select("id", "name", "file", "start_line", "end_line", "module_id", F.coalesce("is_exported", F.lit(False)).alias("is_exported"), "purpose")
    exported = assigned.where("type = 'generic' AND is_exported").select("id", "name", F.coalesce("kind", F.lit("generic")).alias("kind"), "file", "start_line", "module_id")
    generics = R.first_with_others(exported, ["name", "kind"], F.struct("file", "start_line", "id"), "file")
    imported = graph.edges.where("type = 'imports'").groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    files = R.assign_modules(graph.parsed.select("path", "language", "hash"), modules, regex).join(imported, "path", "left").withColumn("imports", F.coalesce("imports", none))
    spark = graph.nodes.sparkSession
    globs = spark.createDataFrame([(i, m, "|".join(f"(?:{regex(g)})" for g in gs) or "(?!)") for i, (m, gs) in enumerate(modules)], "ord int, module_id string, pattern string")
    held = files.select("path", "hash").join(F.broadcast(globs), F.expr("path rlike pattern"))  # as many as declared
    sums = R.merkle(held)
    of = held.groupBy("module_id").agg(F.array_sort(F.collect_list("path")).alias("files"))
    mods = globs.select("ord", "module_id").join(of, "module_id", "left").join(sums, "module_id", "left")
    mods = mods.select("ord", F.col("module_id").alias("id"), F.coalesce("files", none).alias("files"), F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("hash"))
    n, m = graph.counts()
    root = R.merkle_root(mods.select(F.col("id").alias("module_id"), "hash"))
    summary = root.crossJoin(snapshot.fingerprint(fns)).select(F.lit(n).alias("nodes"), F.lit(m).alias("edges"), "root", "fingerprint")  # one row each
    routes = parsing.child(graph.parsed, "routes")
    return Snapshot(fns, classes, generics, files, mods, routes, graph.edges, summary)


def graph_from_snapshot(functions: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a snapshot: functions and files as nodes, calls whose callee is there,
    import lists and containment as edges."""
    n = functions.select("id", F.lit("function").alias("type"), "name", "file", "module_id").unionByName(files.select(F.col("path").alias("id"), F.lit("file").alias("type"), F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("file"), "module_id"))
    ids = functions.select(F.col("id").alias("dst"))
    calls = functions.select(F.col("id").alias("src"), F.explode("calls").alias("dst")).join(ids, "dst", "left_semi").select("src", "dst", F.lit("calls").alias("type"))
    holds = functions.join(files.select(F.col("path").alias("file")), "file", "left_semi").select(F.col("file").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type"))
    out = calls.unionByName(holds)
    if "imports" in files.columns:
        paths = files.select(F.col("path").alias("dst"))
        out = out.unionByName(files.select(F.col("path").alias("src"), F.explode("imports").alias("dst")).join(paths, "dst", "left_semi").select("src", "dst", F.lit("imports").alias("type")))
    return n, out


def analyse(spark: SparkSession, root: str, modules: list[tuple[str, list[str]]] | None = None, language: str | None = None, ignore_file: str = ".ignore") -> tuple[Graph, Snapshot, list[tuple[str, list[str]]]]:
    """Reads, parses, links and compiles the project under ``root``.  Without declared modules
    they come from clusters of its files."""
    from loomgraph.operators import clusters

    tree = parsing.read_tree(spark, root)
    files = cut(tree, "tree")
    language = language or projects.language(files).first()["language"]
    ignored = read_text(spark, f"{root.rstrip('/')}/{ignore_file}")
    found = parsing.discover(files, language, parsing.ignore_globs(ignored or ""))
    known = settings(files)
    graph = graph_of(parsing.parse_files(found), known["aliases"], known["module"])
    if modules is None:
        made = clusters.detect(graph.nodes, graph.edges)
        modules = [(r["id"], r["paths"]) for r in clusters.declared(made, graph).orderBy("ord").select("id", "paths").collect()]
    return graph, compile_snapshot(graph, modules), modules
