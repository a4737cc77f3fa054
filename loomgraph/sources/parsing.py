"""Source files to entity tables: one parser for each language, run over partitions of files."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.errors import UnsupportedLanguage
from loomgraph.functions.scalars import glob_regex
from loomgraph.storage import cut

from . import golang, script

PARAM = "struct<name:string,type:string,optional:boolean,default_value:string>"
FUNCTION = f"id string, name string, file string, start_line int, end_line int, params array<{PARAM}>, return_type string, is_exported boolean, is_async boolean, calls array<string>, purpose string, edge_cases array<string>, error_handling array<struct<line:int,type:string,detail:string>>, blocks array<struct<start_line:int,end_line:int,block:string>>, type_parameters array<string>"
_FUNCTION_STRUCT = "struct<" + FUNCTION.replace(" string", ":string").replace(" int", ":int").replace(" boolean", ":boolean").replace(" array", ":array").replace(", ", ",") + ">"
CHILDREN = {
    "functions": f"array<{_FUNCTION_STRUCT}>",
    "classes": f"array<struct<id:string,name:string,file:string,start_line:int,end_line:int,methods:array<{_FUNCTION_STRUCT}>,is_exported:boolean,purpose:string,decorators:array<string>,type_parameters:array<string>>>",
    "generics": "array<struct<id:string,name:string,file:string,kind:string,is_exported:boolean,start_line:int>>",
    "imports": "array<struct<file:string,source:string,resolved_path:string,names:array<string>,is_default:boolean,is_dynamic:boolean>>",
    "exports": "array<struct<name:string,kind:string,file:string>>",
    "routes": "array<struct<method:string,path:string,handler:string,middlewares:array<string>,file:string,line:int>>",
}
#: Parsers by extension; a plug-in is a function (path, text, kinds) -> entities of these kinds, or of more.
PARSERS: dict[str, tuple[str, Callable[[str, str, Collection[str]], dict]]] = {**{e: ("typescript", script.parse) for e in (".ts", ".tsx")}, **{e: ("javascript", script.parse) for e in (".js", ".mjs", ".cjs", ".jsx")}, ".go": ("go", golang.parse)}

# Tasks for each core that files are dealt to, and bytes of entities that are handed on at once.
TASKS_PER_CORE, SLICE = 4, 4 << 20
# What is discovered and ignored for each language.
IGNORED = ["**/.git/**", "**/coverage/**", "**/build/**"]
DISCOVERY = {
    "typescript": (["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx"], ["**/node_modules/**", "**/dist/**", "**/.next/**", "**/.nuxt/**", "**/.svelte-kit/**", "**/*.d.ts", "**/*.test.*", "**/*.spec.*"]),
    "javascript": (["**/*.js", "**/*.jsx", "**/*.mjs", "**/*.cjs", "**/*.ts", "**/*.tsx"], ["**/node_modules/**", "**/dist/**", "**/.next/**", "**/*.d.ts", "**/*.test.*", "**/*.spec.*"]),
    "python": (["**/*.py"], ["**/__pycache__/**", "**/venv/**", "**/.venv/**", "**/.tox/**", "**/test_*.py", "**/*_test.py"]),
    "go": (["**/*.go"], ["**/vendor/**", "**/*_test.go"]),
    "rust": (["**/*.rs"], ["**/target/**"]),
    "java": (["**/*.java", "**/*.kt"], ["**/target/**", "**/.gradle/**", "**/Test*.java", "**/*Test.java"]),
    "ruby": (["**/*.rb"], ["**/vendor/**", "**/*_spec.rb", "**/spec/**"]),
    "php": (["**/*.php"], ["**/vendor/**", "**/*Test.php"]),
    "csharp": (["**/*.cs"], ["**/bin/**", "**/obj/**"]),
}


def ignore_globs(text: str) -> list[str]:
    """Globs of an ignore file: comments, blank lines and negations are dropped."""
    out = []
    for line in map(str.strip, text.split("\n")):
        if not line or line[0] in "#!":
            continue
        bare, folder = (line[:-1], True) if line.endswith("/") else (line, False)
        out.append(("" if "/" in bare else "**/") + bare + ("/**" if folder else ""))
    return out


def matches(path: Column, globs: list[str]) -> Column:
    return F.rlike(path, F.lit("|".join(f"(?:{glob_regex(g)})" for g in globs))) if globs else F.lit(False)


def discover(files: DataFrame, language: str, ignore: list[str] = ()) -> DataFrame:
    """Files (path, …) of a language that no ignore glob matches; unknown languages as TypeScript."""
    wanted, skipped = DISCOVERY.get(language, DISCOVERY["typescript"])
    return files.where(matches(F.col("path"), wanted) & ~matches(F.col("path"), [*IGNORED, *skipped, *ignore]))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of every file under ``root`` but hidden ones; paths are relative to it, bytes
    that are no UTF-8 are replaced."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    return b.select(F.substring_index("path", base + "/", -1).alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def language_of(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for ext, (lang, _) in PARSERS.items():
        out = F.when(F.endswith(path, F.lit(ext)), lang).otherwise(out)
    return out


def spread(files: DataFrame) -> DataFrame:
    """Files dealt by path to a number of tasks that the cores set: a small table is read by few
    tasks, often one, whatever the work on each of its rows.  A count that is given is kept by
    adaptive execution, which would join small partitions again."""
    return files.repartition(TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism, "path")


def parse_files(files: DataFrame, strict: bool = False, only: Collection[str] | None = None) -> DataFrame:
    """One row for each file (path, text): language, hash and arrays of its entities.

    Files of other extensions are dropped, or with ``strict`` an error; null texts count as empty.
    With ``only`` some kinds of entities (names of CHILDREN) just these are read and have columns.
    """
    kept = {k: v for k, v in CHILDREN.items() if only is None or k in only}
    kind = ", ".join(f"{k} {v}" for k, v in kept.items())
    schema, wanted = f"path string, language string, hash string, {kind}", tuple(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(k, pa.string()) for k in ("path", "language", "hash", "entities")])
        for b in batches:
            out, held = {k: [] for k in kinds.names}, 0
            for path, text in ((x.as_py(), y.as_py()) for x, y in zip(b.column(0), b.column(1))):
                ext = next((e for e in PARSERS if path.endswith(e)), None)
                if ext is None:
                    if strict:
                        raise UnsupportedLanguage(f"no parser for {path}")
                    continue
                lang, parse = PARSERS[ext]
                out["path"].append(path)
                out["language"].append(lang)
                out["hash"].append(hashlib.sha256((text or "").encode()).hexdigest())
                out["entities"].append(json.dumps(parse(path, text or "", wanted)))
                held += len(out["entities"][-1])
                if held >= SLICE:
                    yield pa.RecordBatch.from_pydict(out, schema=kinds)
                    out, held = {k: [] for k in kinds.names}, 0
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    raw = spread(files.select("path", "text")).mapInArrow(run, "path string, language string, hash string, entities string")
    return raw.select("path", "language", "hash", F.from_json("entities", kind, {"mode": "FAILFAST"}).alias("e")).select("path", "language", "hash", "e.*").to(spark_schema(files.sparkSession, schema))


def spark_schema(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def all_functions(parsed: DataFrame) -> DataFrame:
    """Functions and methods of all files."""
    f = parsed.select(F.explode("functions").alias("f")).select("f.*")
    m = parsed.select(F.explode("classes").alias("c")).select(F.explode("c.methods").alias("f")).select("f.*")
    return f.unionByName(m)


def child(parsed: DataFrame, name: str) -> DataFrame:
    return parsed.select(F.explode(name).alias("x")).select("x.*")


def next_routes(parsed: DataFrame) -> DataFrame:
    """Routes that route files of an app folder declare by path: groups dropped, [id] to :id; in
    order of URL and method."""
    verbs = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
    own = parsed.where(F.rlike("path", F.lit(r"(^|/)app/(.*/)?route\.(ts|js|tsx|jsx)$")))
    names = F.array_distinct(F.concat(F.transform("functions", lambda f: f["name"]), F.transform("generics", lambda g: g["name"])))
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("path", r"(?:^|/)app/((?:.*/)?)route\.\w+$", 1), r"\([^)/]*\)/", ""), r"\[\.\.\.([^\]]+)\]", "*$1"), r"\[([^\]]+)\]", ":$1")
    found = own.select("path", F.explode(F.array_intersect(names, F.lit(verbs))).alias("method"), F.concat(F.lit("/"), F.regexp_replace(url, "/$", "")).alias("url"))
    return cut(found, "routes").orderBy("url", "method")  # a sort looks at its rows twice: written, files are not parsed twice
