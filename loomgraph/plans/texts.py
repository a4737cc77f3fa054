"""Queries over texts, paths, prompts and sources that are made of the tables' rows.

A text is one expression that both engines read (CASE, ||, split_part), so they judge the same
rows; what they make of them is stated apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import clusters, intents, search
from loomgraph.operators import relational as R
from loomgraph.plans import adapters as A
from loomgraph.sources import build, contextfiles, parsing, snapshot, stores
from loomgraph.storage import scratch_dir
from loomgraph.streaming import watch

from .catalog import query

_W1, _W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_U1, _U2 = (f"upper(substr({w}, 1, 1)) || substr({w}, 2)" for w in (_W1, _W2))


def _case(by: str, values: list[str]) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _parts(spark: SparkSession, sf: str, **columns: str) -> DataFrame:
    return A.table(spark, sf, "part").select("p_partkey", *[F.expr(e).alias(c) for c, e in columns.items()])


def _sql(**columns: str) -> str:
    return "(SELECT p_partkey, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + " FROM part)"


_VERBS = ["use", "handle", "on", "get", "save", "is", "has", "check", "compute", "fetch"]
_NAME = f"{_case(f'p_partkey % {len(_VERBS)}', [repr(v) for v in _VERBS])} || {_U1} || {_U2}"


@query(f"SELECT p_partkey, name, {_case(f'p_partkey % {len(_VERBS)}', [repr(x) for x in ['Hook for ', 'Handle ', 'Handle ', 'Get ', 'Save ', 'Check if ', 'Check if ', 'Check ', 'Compute ', 'Fetch ']])} || w1 || ' ' || w2 AS purpose FROM {_sql(name=_NAME, w1=_W1, w2=_W2)}")
def purpose_case(spark, sf):
    return _parts(spark, sf, name=_NAME).select("p_partkey", "name", S.purpose(F.col("name")).alias("purpose"))


_SHOWN = "CASE p_partkey % 4 WHEN 0 THEN 'JSX.Element' WHEN 1 THEN 'string' WHEN 2 THEN 'void' END"


@query(f"SELECT p_partkey, CASE WHEN kind = 0 THEN {_U1} || ' ' || w2 || ' component' WHEN kind = 1 THEN 'Hook for ' || w2 WHEN kind = 2 THEN 'Get ' || w2 || ' (' || w1 || ')' ELSE 'Load ' || w2 END AS purpose FROM (SELECT *, p_partkey % 4 AS kind, {_W1} AS w1, {_W2} AS w2 FROM part)")
def purpose_with_types(spark, sf):
    """Components by their result type, parameters that tell something, and plain ones that do not."""
    p = _parts(spark, sf, name=f"{_case('p_partkey % 4', [f'{_U1} || {_U2}', f'{repr(chr(117) + chr(115) + chr(101))} || {_U2}', f'{repr(chr(103) + chr(101) + chr(116))} || {_U2}', f'{repr(chr(108) + chr(111) + chr(97) + chr(100))} || {_U2}'])}", ret=_SHOWN, param=f"{_case('p_partkey % 4', [_W1, _W1, _W1, repr('props')])}")
    return p.select("p_partkey", S.purpose(F.col("name"), F.array(F.struct(F.col("param").alias("name"))), F.col("ret")).alias("purpose"))


_RULE_TEXT = _case("p_partkey % 8", [f"'No direct ' || {_W1} || ' access outside ' || {_W2} || '/'", f"'All ' || {_W1} || ' must go through ' || {_W2} || '.main'", f"{_W1} || ' cannot import from ' || {_W2} || ' directly'", f"'Never call ' || {_W1} || ' in the ' || {_W2} || ' flow'", f"'The ' || {_W1} || ' layer owns ' || {_W2}", f"{_W1} || ' must be named in camelCase'", f"'Keep the ' || {_W1} || ' ' || {_W2} || ' simple'", f"'module:' || {_W1} || ' cannot import module:' || {_W2}"])
_CLASS = "CASE WHEN t LIKE '%no direct%' OR t LIKE '%cannot import%' OR t LIKE '%must not import%' THEN 'no-import' WHEN t LIKE '%must go through%' OR t LIKE '%must use%' OR t LIKE '%required%' THEN 'must-use' WHEN t LIKE '%never call%' OR t LIKE '%do not call%' THEN 'no-call' WHEN t LIKE '%layer%' THEN 'layer' WHEN t LIKE '%must be%' AND (t LIKE '%case%' OR t LIKE '%named%') THEN 'naming' ELSE 'complex' END"


@query(f"SELECT p_partkey, {_CLASS} AS class FROM (SELECT p_partkey, lower(raw) AS t FROM {_sql(raw=_RULE_TEXT)})")
def constraint_classify(spark, sf):
    return _parts(spark, sf, raw=_RULE_TEXT).select("p_partkey", S.constraint_class(F.col("raw")).alias("class"))


_ACTION = _case("p_partkey % 3", ["'create'", "'modify'", "'delete'"])
_HIT = f"""CASE p_partkey % 8 WHEN 0 THEN CASE WHEN NOT contains(m, w2) THEN 'error' END WHEN 1 THEN CASE WHEN (contains(n, w1) OR contains(m, w1)) AND a <> 'delete' THEN 'warning' END WHEN 2 THEN CASE WHEN contains(m, w2) THEN 'error' END
 WHEN 3 THEN CASE WHEN (contains(n, w2) OR contains(m, w2)) AND a <> 'delete' THEN 'warning' END WHEN 5 THEN CASE WHEN a = 'create' AND NOT regexp_full_match(name, '[a-z][a-zA-Z0-9]*') THEN 'warning' END WHEN 6 THEN 'warning' WHEN 7 THEN CASE WHEN contains(m, 'module') THEN 'error' END END"""


@query(f"SELECT p_partkey, {_HIT} AS severity FROM (SELECT *, lower(name) AS n, lower(module) AS m FROM {_sql(w1=_W1, w2=_W2, a=_ACTION, name=f'{_U1} || {_U2}', module='lower(p_type)')})")
def constraint_hits(spark, sf):
    """How intents on parts meet the constraints made of the same rows."""
    p = _parts(spark, sf, raw=_RULE_TEXT, a=_ACTION, name=f"{_U1} || {_U2}", module="lower(p_type)", reason=f"'the ' || {_W1} || ' and ' || {_W2}")
    return p.select("p_partkey", intents.constraint_hit(F.col("raw"), F.col("name"), F.col("module"), F.col("a"), F.col("reason")).alias("severity"))


_GRAMMAR = _case("p_partkey % 5", [f"'module:' || {_U1} || '  cannot import module:' || {_W2}", f"'Module:' || {_W1} || ' can only import module:' || {_W2} || ', module:core'", f"'module:' || {_W1} || ' is isolated'", f"'module:' || {_W1} || ' has no imports'", f"'modules like ' || {_W1} || ' are fine'"])


@query(f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'deny' WHEN 1 THEN 'allow_only' WHEN 4 THEN NULL ELSE 'isolated' END AS kind, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE w1 END AS from_module, CASE p_partkey % 5 WHEN 0 THEN w2 WHEN 1 THEN w2 || ',core' ELSE '' END AS to_modules FROM {_sql(w1=_W1, w2=_W2)}""")
def rule_parse(spark, sf):
    raw = F.col("raw")
    return _parts(spark, sf, raw=_GRAMMAR).select("p_partkey", S.rule_kind(raw).alias("kind"), S.rule_from(raw).alias("from_module"), F.array_join(S.rule_to(raw), ",").alias("to_modules"))


_KINDS = [("prisma/schema.prisma", "schema"), ("a/{}.schema.ts", "schema"), ("{}.proto", "api-spec"), ("docs/OpenAPI-{}.yaml", "api-spec"), ("db/migrations/{}.sql", "migration"), ("db/migrate/{}.rb", "migration"), ("{}.sql", "schema"), ("src/models/{}.ts", "model"), ("{}/models.py", "model"), ("types/{}.ts", "types"), ("src/routes/{}.ts", "routes"), ("{}/docker-compose.yml", "docker"), (".env.{}", "config")]
_KIND_PATH = _case(f"p_partkey % {len(_KINDS)}", ["'" + p.replace("{}", f"' || {_W1} || '") + "'" for p, _ in _KINDS])


@query(f"SELECT p_partkey, path, {_case(f'p_partkey % {len(_KINDS)}', [repr(k) for _, k in _KINDS])} AS kind FROM {_sql(path=_KIND_PATH)}")
def context_file_class(spark, sf):
    return _parts(spark, sf, path=_KIND_PATH).select("p_partkey", "path", S.context_kind(F.col("path")).alias("kind"))


_CTX_PATH = _case("p_partkey % 6", ["'src/models/' || p_partkey || '.ts'", "'api/' || p_partkey || '.proto'", "'db/migrations/' || p_partkey || '.sql'", "'src/other/' || p_partkey || '.ts'", "'node_modules/models/' || p_partkey || '.ts'", "'src/types/' || p_partkey || '.ts'"])
_CTX_SIZE = "CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 11 = 0 THEN 50001 ELSE p_size + 1 END"


@query(f"SELECT path, type, CASE type WHEN 'model' THEN 2 WHEN 'types' THEN 3 WHEN 'api-spec' THEN 4 ELSE 6 END AS priority, size FROM (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'model' WHEN 1 THEN 'api-spec' WHEN 2 THEN 'migration' WHEN 5 THEN 'types' END AS type FROM {_sql(path=_CTX_PATH, size=f'CAST({_CTX_SIZE} AS BIGINT)')}) WHERE type IS NOT NULL AND size BETWEEN 1 AND 50000")
def context_files(spark, sf):
    """Context files among files made of the parts: by path, size, type and order."""
    files = _parts(spark, sf, path=_CTX_PATH, size=_CTX_SIZE).select("path", F.repeat(F.lit("x"), F.col("size")).alias("text"))
    return contextfiles.discover(files).select("path", "type", "priority", "size")


_NUMBER, _KIND_OF = "CAST(replace(p_brand, 'Brand#', '') AS INT)", "lower(p_type)"


def _import_texts(spark: SparkSession, sf: str, endings: list[str]) -> tuple[DataFrame, DataFrame]:
    files = _parts(spark, sf, path=f"'src/' || {_KIND_OF} || '/Brand' || {_NUMBER} || {_case(f'{_NUMBER} % {len(endings)}', [repr(e) for e in endings])}").select("path").distinct()
    return _parts(spark, sf, file=f"'src/' || {_KIND_OF} || '/main.ts'", source=_SOURCE).select("file", "source").distinct(), files


_SOURCE = _case("p_partkey % 5", ["'./Brand' || p_size", f"'../' || {_KIND_OF} || '/Brand' || p_size", f"'@/' || {_KIND_OF} || '/Brand' || p_size", "'express'", "'./Brand' || p_size || '.ts'"])


def _probe_sql(endings: list[str]) -> str:
    tried = " ".join(f"WHEN base || '{e}' IN (SELECT path FROM f) THEN base || '{e}'" for e in endings)
    return f"""WITH f AS (SELECT DISTINCT path FROM {_sql(path=f"'src/' || {_KIND_OF} || '/Brand' || {_NUMBER} || {_case(f'{_NUMBER} % {len(endings)}', [repr(e) for e in endings])}")}),
i AS (SELECT DISTINCT file, source, base, k FROM {_sql(file=f"'src/' || {_KIND_OF} || '/main.ts'", source=_SOURCE, base=f"'src/' || {_KIND_OF} || '/Brand' || p_size", k='p_partkey % 5')})
SELECT DISTINCT file, source, CASE WHEN k = 3 THEN '' WHEN k = 4 THEN base || '.ts' {tried} ELSE base || '{endings[0]}' END AS target FROM i"""


@query(_probe_sql(build.ENDINGS["typescript"]))
def import_resolution_probe(spark, sf):
    imports, files = _import_texts(spark, sf, build.ENDINGS["typescript"])
    return R.resolve_imports(imports, files, [("@", "src")], build.ENDINGS["typescript"])


@query(_probe_sql(build.ENDINGS["javascript"]))
def import_resolution_javascript(spark, sf):
    imports, files = _import_texts(spark, sf, build.ENDINGS["javascript"])
    return R.resolve_imports(imports, files, [("@", "src")], build.ENDINGS["javascript"])


_GO_FILE = _case(f"{_NUMBER} % 4", [f"'pkg/b' || {_NUMBER} || '/b' || {_NUMBER} || '.go'", f"'pkg/b' || {_NUMBER} || '/index.go'", f"'pkg/b' || {_NUMBER} || '.go'", f"'pkg/b' || {_NUMBER} || '/other.go'"])
_GO_SOURCE = _case("p_partkey % 3", [f"'example.org/app/pkg/b' || {_NUMBER}", "'fmt'", f"'example.org/app/none/b' || {_NUMBER}"])


@query(f"SELECT DISTINCT 'main.go' AS file, source, CASE WHEN source = 'fmt' THEN '' WHEN source LIKE '%/none/%' THEN 'none/b' || n WHEN n % 4 = 3 THEN 'pkg/b' || n ELSE path END AS target FROM {_sql(source=_GO_SOURCE, path=_GO_FILE, n=_NUMBER)}")
def import_resolution_go(spark, sf):
    p = _parts(spark, sf, source=_GO_SOURCE, path=_GO_FILE)
    return R.resolve_packages(p.select(F.lit("main.go").alias("file"), "source"), p.select("path"), "example.org/app")


_PROMPT = _case("p_partkey % 8", [f"'fix the ' || {_W1} || ' ' || {_W2}", f"'add error handling to `' || {_U1} || {_U2} || '`'", f"'remove the old ' || {_W2}", f"'migrate ' || {_W1} || ' books'", f"'refactor the ' || {_W1} || ' module'", f"'create a new class for ' || {_W1} || {_U2}", f"'show ' || {_W2}", f"'clean up the ' || {_W1} || ' function'"])


@query(f"""SELECT p_partkey, unnest(list_filter([CASE WHEN regexp_matches(t, 'add|create|new|implement') THEN 'create' END, CASE WHEN regexp_matches(t, 'modify|change|update|fix|edit|patch') THEN 'modify' END, CASE WHEN regexp_matches(t, 'delete|remove|drop') THEN 'delete' END,
 CASE WHEN regexp_matches(t, 'refactor|restructure|clean up|reorganize') THEN 'refactor' END, CASE WHEN regexp_matches(t, 'move|migrate|relocate') THEN 'move' END, CASE WHEN NOT regexp_matches(t, 'add|create|new|implement|modify|change|update|fix|edit|patch|delete|remove|drop|refactor|restructure|clean up|reorganize|move|migrate|relocate') THEN 'modify' END], lambda x: x IS NOT NULL)) AS action,
 CASE WHEN regexp_matches(t, 'function|method') THEN 'function' WHEN contains(t, 'class') THEN 'class' WHEN regexp_matches(t, 'module|package') THEN 'module' ELSE 'file' END AS target FROM (SELECT p_partkey, lower(prompt) AS t FROM {_sql(prompt=_PROMPT)})""")
def intent_actions(spark, sf):
    prompt = F.col("prompt")
    return _parts(spark, sf, prompt=_PROMPT).select("p_partkey", F.explode(S.intent_actions(prompt)).alias("action"), S.target_type(prompt).alias("target"))


@query(f"SELECT p_partkey, {_case('p_partkey % 8', ['w2', f'{_U1} || {_U2}', 'w2', repr('books'), 'w1', f'w1 || {_U2}', 'w2', 'w1'])} AS name FROM (SELECT *, {_W1} AS w1, {_W2} AS w2 FROM part)")
def intent_names(spark, sf):
    return _parts(spark, sf, prompt=_PROMPT).select("p_partkey", intents.name_in(F.col("prompt")).alias("name"))


_TASK = "refactor the economy and promo modules, small sizes first"


@query("SELECT id, name, score FROM (SELECT module_id AS id, module_id || ' parts' AS name, least(1.0, CASE WHEN contains(t, module_id) THEN 0.8 ELSE 0 END + CASE WHEN contains(t, module_id || ' parts') THEN 0.7 ELSE 0 END + list_sum([CASE WHEN contains(module_id || ' parts', k) THEN 0.2 ELSE 0 END + CASE WHEN contains(module_id, k) THEN 0.2 ELSE 0 END FOR k IN ['refactor', 'economy', 'promo', 'modules', 'small', 'sizes', 'first'] IF k <> 'refactor']))::DOUBLE AS score FROM (SELECT DISTINCT module_id, '" + _TASK + f"' AS t FROM {A.FUNCTIONS})) WHERE score > 0.3")
def module_match(spark, sf):
    m = A.functions(spark, sf).select(F.col("module_id").alias("id"), F.concat("module_id", F.lit(" parts")).alias("name")).distinct()
    return m.select("id", "name", intents.module_score(_TASK, intents.keywords_of(_TASK)).alias("score")).where("score > 0.3")


_CLASS_TASK, _CLASS_WORDS = "fix the class RedRing for large bolts", ["redring", "large", "bolts"]


@query(f"""SELECT id, name, least(round(s, 6), 1.0)::DOUBLE AS score FROM (SELECT id, name, CASE WHEN contains('{_CLASS_TASK.lower()}', lower(name)) AND length(name) > 3 THEN 0.95 ELSE 0 END + {' + '.join(f"CASE WHEN contains(lower(name), '{k}') THEN 0.3 ELSE 0 END + CASE WHEN starts_with(w1, '{k}') OR starts_with('{k}', w1) OR starts_with(w2, '{k}') OR starts_with('{k}', w2) THEN 0.2 ELSE 0 END" for k in _CLASS_WORDS)} AS s FROM (SELECT 'class:' || p_partkey AS id, {_U1} || {_U2} AS name, {_W1} AS w1, {_W2} AS w2 FROM part)) WHERE round(s, 6) > 0.3""")
def class_match(spark, sf):
    c = _parts(spark, sf, id="'class:' || p_partkey", name=f"{_U1} || {_U2}")
    return search.class_score(c, _CLASS_TASK, _CLASS_WORDS)


@query(f"SELECT p_partkey, {_U1} || {_U2} || ' ' || 'Makes ' || w1 || CASE WHEN p_partkey % 2 = 0 THEN ' ' || w1 || ' ' || w2 ELSE '' END || CASE WHEN p_partkey % 4 = 1 THEN ' returns string' ELSE '' END AS text FROM (SELECT *, {_W1} AS w1, {_W2} AS w2 FROM part)")
def embedding_texts(spark, sf):
    p = _parts(spark, sf, name=f"{_U1} || {_U2}", w1=_W1, w2=_W2, ret="CASE p_partkey % 4 WHEN 1 THEN 'string' WHEN 2 THEN 'void' WHEN 3 THEN 'any' END")
    params = F.when(F.col("p_partkey") % 2 == 0, F.array(F.struct(F.col("w1").alias("name")), F.struct(F.col("w2").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>"))
    return p.select("p_partkey", search.embedding_text(F.col("name"), F.concat(F.lit("Makes "), "w1"), params, F.col("ret")).alias("text"))


@query("SELECT path, type, CASE WHEN type = 'added' THEN NULL ELSE was END AS old_hash, CASE WHEN type = 'deleted' THEN NULL ELSE is_now END AS new_hash FROM (SELECT coalesce(d.path, l.path) AS path, CASE WHEN l.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted' ELSE 'changed' END AS type, l.hash AS was, d.hash AS is_now " + f"FROM {A.DISK} d FULL JOIN {A.FILES} l ON d.path = l.path WHERE d.path IS NULL OR l.path IS NULL OR d.hash <> l.hash)")
def change_events(spark, sf):
    return watch.changes(A.disk(spark, sf), A.files(spark, sf).select("path", "hash"))


_SINCE = 1_705_708_800_000


@query(f"SELECT path, hash FROM (SELECT event_type || '/' || user_id AS path, arg_max(hash, (ms, hash)) AS hash, max(ms) AS ms FROM (SELECT event_type, user_id, json_extract_string(props, '$.k') AS hash, epoch_ms(ts) AS ms FROM events) GROUP BY ALL) WHERE ms > {_SINCE}")
def changed_since(spark, sf):
    """Events as upserts of a store of hashes, then a range read of it."""
    e = A.table(spark, sf, "events")
    rows = e.select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("path"), F.get_json_object("props", "$.k").alias("hash"), F.lit(0).cast("long").alias("size_bytes"), F.unix_millis(F.col("ts").cast("timestamp")).alias("updated_at"))
    store = stores.HashStore(spark, f"{scratch_dir(spark)}/hashes-{uuid.uuid4().hex}")
    store.upsert(rows)
    return store.changed_since(_SINCE).select("path", "hash")


# Sources made of the parts: one TypeScript file for each part, whose function calls the functions of the parts that
# it calls and imports those whose key is not a multiple of 3; every fifth has a class.
_PATH = "'src/' || lower(p_type) || '/p' || p_partkey || '.ts'"


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(path, text) of the made sources."""
    p = _parts(spark, sf, path=_PATH, folder=_KIND_OF)
    to = p.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("dst"), F.col("p_partkey").alias("k"), F.col("folder").alias("f"))
    own = p.select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("src"), "p_partkey")
    called = A.part_calls(spark, sf).where("src <> dst").join(to, "dst").join(own, "src").groupBy("p_partkey").agg(F.array_sort(F.collect_list(F.struct("k", "f"))).alias("c"))
    t, key = p.join(called, "p_partkey", "left"), F.col("p_partkey").cast("string")
    none = F.array().cast("array<string>")
    imports = F.coalesce(F.transform(F.filter("c", lambda x: x["k"] % 3 != 0), lambda x: F.concat(F.lit("import { f"), x["k"].cast("string"), F.lit(' } from "../'), x["f"], F.lit("/p"), x["k"].cast("string"), F.lit('";\n'))), none)
    calls = F.coalesce(F.transform("c", lambda x: F.concat(F.lit("  f"), x["k"].cast("string"), F.lit("(a);\n"))), none)
    head = F.when(F.col("p_partkey") % 2 == 0, "export ").otherwise("")
    cls = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("export class K"), key, F.lit(" {\n  run(): void {\n    f"), key, F.lit("(1);\n  }\n}\n"))).otherwise("")
    return t.select("path", F.concat(F.array_join(imports, ""), head, F.lit("function f"), key, F.lit("(a: number): void {\n"), F.array_join(calls, ""), F.lit("}\n"), cls).alias("text"))


def _graph(spark: SparkSession, sf: str) -> build.Graph:
    return build.graph_of(parsing.parse_files(sources(spark, sf)))


_P = f"(SELECT p_partkey AS k, {_PATH} AS path, lower(p_type) AS module FROM part)"
_E = f"(SELECT a.k, a.path, b.k AS ck, b.path AS cpath FROM {A.CALLS} e JOIN {_P} a ON 'p:' || a.k = e.src JOIN {_P} b ON 'p:' || b.k = e.dst WHERE e.src <> e.dst)"
_SOURCE_EDGES = f"""(SELECT DISTINCT path AS src, cpath AS dst, 'imports' AS type, 1.0::DOUBLE AS confidence FROM {_E} WHERE ck % 3 <> 0
 UNION ALL SELECT 'fn:' || path || ':f' || k, 'fn:' || cpath || ':f' || ck, 'calls', 0.8 FROM {_E} WHERE ck % 3 <> 0 UNION ALL SELECT 'fn:' || path || ':K' || k || '.run', 'fn:' || path || ':f' || k, 'calls', 1.0 FROM {_P} WHERE k % 5 = 0
 UNION ALL SELECT path, 'fn:' || path || ':f' || k, 'contains', NULL FROM {_P} UNION ALL SELECT path, 'class:' || path || ':K' || k, 'contains', NULL FROM {_P} WHERE k % 5 = 0 UNION ALL SELECT 'class:' || path || ':K' || k, 'fn:' || path || ':K' || k || '.run', 'contains', NULL FROM {_P} WHERE k % 5 = 0)"""


@query(f"SELECT * FROM {_SOURCE_EDGES}")
def source_edges(spark, sf):
    """Edges of the graph that is built from the made sources."""
    return _graph(spark, sf).edges


@query(f"SELECT path AS id, 'file' AS type, 'p' || k || '.ts' AS name, path AS file FROM {_P} UNION ALL SELECT 'fn:' || path || ':f' || k, 'function', 'f' || k, path FROM {_P} UNION ALL SELECT 'class:' || path || ':K' || k, 'class', 'K' || k, path FROM {_P} WHERE k % 5 = 0 UNION ALL SELECT 'fn:' || path || ':K' || k || '.run', 'function', 'K' || k || '.run', path FROM {_P} WHERE k % 5 = 0")
def source_nodes(spark, sf):
    return _graph(spark, sf).nodes.select("id", "type", "name", "file")


def _snapshot(spark: SparkSession, sf: str) -> build.Snapshot:
    kinds = sorted(r[0] for r in _parts(spark, sf, kind=_KIND_OF).select("kind").distinct().collect())  # the module list
    return build.compile_snapshot(_graph(spark, sf), [(k, [f"src/{k}/**"]) for k in kinds])


@query(f"""WITH e AS MATERIALIZED (SELECT * FROM {_SOURCE_EDGES} WHERE type = 'calls'), f AS (SELECT 'fn:' || path || ':f' || k AS id, module, k % 2 = 0 AS is_exported FROM {_P} UNION ALL SELECT 'fn:' || path || ':K' || k || '.run', module, true FROM {_P} WHERE k % 5 = 0)
SELECT f.id, f.module AS module_id, f.is_exported, coalesce(o.n, 0) AS calls, coalesce(i.n, 0) AS called_by FROM f LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON o.src = f.id LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = f.id""")
def source_functions(spark, sf):
    f = _snapshot(spark, sf).functions
    return f.select("id", "module_id", F.coalesce("is_exported", F.lit(False)).alias("is_exported"), F.size("calls").cast("long").alias("calls"), F.size("called_by").cast("long").alias("called_by"))


@query(f"SELECT 'class:' || path || ':K' || k AS id, 'K' || k AS name, module AS module_id, true AS is_exported, 'K' || k AS purpose FROM {_P} WHERE k % 5 = 0")
def source_classes(spark, sf):
    return _snapshot(spark, sf).classes.select("id", "name", "module_id", "is_exported", "purpose")


@query(f"SELECT (SELECT 2 * count(*) + 2 * count(*) FILTER (k % 5 = 0) FROM {_P}) AS nodes, (SELECT count(*) FROM {_SOURCE_EDGES}) AS edges")
def source_summary(spark, sf):
    return _snapshot(spark, sf).summary.select(F.col("nodes").cast("long").alias("nodes"), F.col("edges").cast("long").alias("edges"))


@query(f"SELECT path, module AS module_id, coalesce(n, 0) AS imports FROM {_P} LEFT JOIN (SELECT src, count(*) AS n FROM {_SOURCE_EDGES} WHERE type = 'imports' GROUP BY src) ON src = path")
def source_files(spark, sf):
    return _snapshot(spark, sf).files.select("path", "module_id", F.size("imports").cast("long").alias("imports"))


@query(f"SELECT src, dst, type FROM {_SOURCE_EDGES} WHERE type <> 'contains' OR src LIKE 'src/%' AND dst LIKE 'fn:%' UNION ALL SELECT path, 'fn:' || path || ':K' || k || '.run', 'contains' FROM {_P} WHERE k % 5 = 0")
def snapshot_graph(spark, sf):
    """The graph that a snapshot gives back."""
    s = _snapshot(spark, sf)
    return build.graph_from_snapshot(s.functions, s.files)[1]


_GO_NAME = _case("p_partkey % 2", [f"{_U1} || {_U2} || p_partkey", f"{_W1} || {_U2} || p_partkey"])


@query(f"SELECT name, regexp_matches(name, '^[A-Z]') AS is_exported FROM {_sql(name=_GO_NAME)}")
def go_exports(spark, sf):
    """Functions of Go sources made of the parts: a capital exports them."""
    p = _parts(spark, sf, name=_GO_NAME)
    files = p.select(F.concat(F.lit("pkg/p"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("path"), F.concat(F.lit("package pkg\n\nfunc "), "name", F.lit("(a int) error {\n\treturn nil\n}\n")).alias("text"))
    return parsing.child(parsing.parse_files(files, only=["functions"]), "functions").select("name", "is_exported")


@query("SELECT path FROM (SELECT CASE p_partkey % 4 WHEN 0 THEN 'src/' || p_partkey || '/index.ts' WHEN 1 THEN 'src/p' || p_partkey || '.ts' WHEN 2 THEN p_partkey || '/main.go' ELSE 'lib' || p_partkey || '.py' END AS path, p_partkey FROM part) WHERE p_partkey % 4 IN (0, 2)")
def entry_files(spark, sf):
    path = "CASE p_partkey % 4 WHEN 0 THEN 'src/' || p_partkey || '/index.ts' WHEN 1 THEN 'src/p' || p_partkey || '.ts' WHEN 2 THEN p_partkey || '/main.go' ELSE 'lib' || p_partkey || '.py' END"
    return clusters.entry_files(_parts(spark, sf, path=path))


@query(f"SELECT module AS id, coalesce(names, '') AS names FROM (SELECT DISTINCT module FROM {_P}) LEFT JOIN (SELECT module AS m, string_agg(name, ',' ORDER BY path, id) AS names FROM (SELECT module, path, 'fn:' || path || ':f' || k AS id, 'f' || k AS name FROM {_P} WHERE k % 2 = 0) GROUP BY module) ON m = module")
def exported_names(spark, sf):
    s = _parts(spark, sf, path=_PATH, module=_KIND_OF)
    c = s.groupBy(F.col("module").alias("id")).agg(F.array_sort(F.collect_list("path")).alias("files"))
    f = parsing.child(parsing.parse_files(sources(spark, sf), only=["functions"]), "functions")
    return clusters.exported_names(c, f).select("id", F.array_join("names", ",").alias("names"))


_DOMAINS = [(0, "Fasteners", "bolt"), (0, "Fasteners", "nut"), (1, "Rings", "ring"), (1, "Rings", "washer"), (2, "Gears", "gear"), (3, "Colours", "red"), (3, "Colours", "blue"), (4, "Sizes", "small"), (4, "Sizes", "large")]
_DOMAIN_ROWS = ", ".join(f"({o}, '{d}', '{k}')" for o, d, k in _DOMAINS)


@query(f"""WITH w AS (SELECT p_brand || '/' || p_type AS g, unnest([{_W1}, {_W2}]) AS word FROM part), h AS (SELECT g, domain, ord, count(*) AS score FROM w JOIN (VALUES {_DOMAIN_ROWS}) AS t(ord, domain, keyword) ON contains(word, keyword) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, ord) AS k FROM h), a AS (SELECT * FROM r WHERE k = 1), b AS (SELECT * FROM r WHERE k = 2)
SELECT a.g AS "group", CASE WHEN b.score > 1 AND b.score >= a.score * 0.5 THEN a.domain || ' & ' || b.domain ELSE a.domain END AS name FROM a LEFT JOIN b ON b.g = a.g""")
def domain_names(spark, sf):
    """Names of groups by one domain, or by two that are about as strong."""
    words = _parts(spark, sf, g="p_brand || '/' || p_type", w1=_W1, w2=_W2).select(F.col("g").alias("group"), F.explode(F.array("w1", "w2")).alias("word"))
    return search.domain_names(words, spark.createDataFrame(_DOMAINS, "ord int, domain string, keyword string"))


_PHRASE = f"'Fix the ' || {_W1} || '-' || {_W2} || '_v' || p_size || ' module: must not update all_of IT, please add token'"


def _kept(marks: str, stop: list[str]) -> str:
    return f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(t), '[^a-z0-9\\s{marks}]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(map(repr, stop))})), ' ')"


@query(f"SELECT p_partkey, {_kept('', S.PROMPT_STOP)} AS prompt, {_kept('_-', S.CONTEXT_STOP)} AS context, {_kept('', S.INTENT_STOP)} AS intent, {_kept('', S.CONFLICT_STOP)} AS conflict FROM {_sql(t=_PHRASE)}")
def keyword_variants(spark, sf):
    """The four ways of reading keywords: of prompts, of contexts (marks stay in words), of intents and of conflicts."""
    p, t = _parts(spark, sf, t=_PHRASE), F.col("t")
    kinds = [("prompt", S.PROMPT_STOP, ""), ("context", S.CONTEXT_STOP, "_-"), ("intent", S.INTENT_STOP, ""), ("conflict", S.CONFLICT_STOP, "")]
    return p.select("p_partkey", *[F.array_join(S.keywords(t, stop, marks), " ").alias(name) for name, stop, marks in kinds])


@query(f"SELECT module_id, count(*) FILTER (is_exported) AS exported, count(*) FILTER (NOT is_exported) AS inner_ones FROM {A.FUNCTIONS} GROUP BY module_id")
def functions_by_export(spark, sf):
    """Functions filtered by module and export, as the tools select them."""
    from loomgraph.api import Project

    f = A.functions(spark, sf)
    p = Project(f, f, f, f, f)
    counted = lambda df, name: df.groupBy("module_id").agg(F.count("*").alias(name))
    every = f.select("module_id").distinct()
    return every.join(counted(p.select(exported=True), "exported"), "module_id", "left").join(counted(p.select(exported=False), "inner_ones"), "module_id", "left").fillna(0)


def _parsed(spark: SparkSession, sf: str, path: str, text: str, only: list[str]) -> DataFrame:
    """Parsed files that are made of the parts by two expressions, with some kinds of entities."""
    return parsing.parse_files(_parts(spark, sf, path=path, text=text).select("path", F.regexp_replace("text", "~", "\n").alias("text")), only=only)


_ROUTE = _case("p_partkey % 4", ["'app.get(\"/a/' || p_partkey || '\", auth, h' || p_partkey || ');~'", "'router.post(\"/b/' || p_partkey || '\", h' || p_partkey || ');~'", "'server.listen(3);~prisma.file.delete(\"x\");~'", "'api.put(\"/c/' || p_partkey || '\", one, two, h' || p_partkey || ');~'"])


@query("SELECT 'r/' || p_partkey || '.ts' AS file, CASE p_partkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, CASE p_partkey % 4 WHEN 0 THEN '/a/' WHEN 1 THEN '/b/' ELSE '/c/' END || p_partkey AS path, 'h' || p_partkey AS handler, CASE p_partkey % 4 WHEN 0 THEN 'auth' WHEN 1 THEN '' ELSE 'one,two' END AS middlewares, 1 AS line FROM part WHERE p_partkey % 4 <> 2")
def source_routes(spark, sf):
    r = parsing.child(_parsed(spark, sf, "'r/' || p_partkey || '.ts'", _ROUTE, ["routes"]), "routes")
    return r.select("file", "method", "path", "handler", F.array_join("middlewares", ",").alias("middlewares"), "line")


_IMPORT = _case("p_partkey % 4", ["'import { a, b } from \"./m' || p_partkey || '\";~'", "'import d from \"lib' || p_partkey || '\";~'", "'const { x, y } = require(\"./r' || p_partkey || '\");~'", "'const z = require(\"pkg' || p_partkey || '\");~'"])


@query("SELECT 'i/' || p_partkey || '.js' AS file, CASE p_partkey % 4 WHEN 0 THEN './m' WHEN 1 THEN 'lib' WHEN 2 THEN './r' ELSE 'pkg' END || p_partkey AS source, CASE p_partkey % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'd' WHEN 2 THEN 'x,y' ELSE 'z' END AS names, p_partkey % 2 = 1 AS is_default FROM part")
def source_imports(spark, sf):
    """Imports of both module systems."""
    i = parsing.child(_parsed(spark, sf, "'i/' || p_partkey || '.js'", _IMPORT, ["imports"]), "imports")
    return i.select("file", "source", F.array_join("names", ",").alias("names"), "is_default")


_FUNCTION = f"'/** Does ' || {_W1} || ' */~export async function f' || p_partkey || '(a: number, b?: ' || {_U1} || '): Promise<' || {_U1} || '> {{~  if (!a) {{~    return null;~  }}~  try {{~    g' || p_partkey || '(a);~  }} catch (e) {{~    throw new Error(\"x\");~  }}~}}~'".replace("{{", "{").replace("}}", "}")


@query(f"SELECT 'f' || p_partkey AS name, 'a:number,b:' || u || '?' AS params, 'Promise<' || u || '>' AS return_type, 'Does ' || w AS purpose, 'g' || p_partkey || ',Error' AS calls, '!a' AS edge_cases, 'try-catch,throw' AS errors, 2 AS start_line, 11 AS end_line, true AS is_async, true AS is_exported FROM {_sql(u=_U1, w=_W1)}")
def source_signatures(spark, sf):
    """What is read of a function: signature, comment, calls, conditions that leave, errors, lines."""
    f = parsing.child(_parsed(spark, sf, "'f/' || p_partkey || '.ts'", _FUNCTION, ["functions"]), "functions")
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), p["type"], F.when(p["optional"], "?").otherwise(""))), ",")
    errors = F.array_join(F.transform("error_handling", lambda e: e["type"]), ",")
    return f.select("name", params.alias("params"), "return_type", "purpose", F.array_join("calls", ",").alias("calls"), F.array_join("edge_cases", ",").alias("edge_cases"), errors.alias("errors"), "start_line", "end_line", "is_async", "is_exported")


_GO = f"'package store~~// Saves ' || {_W1} || '~func (s *Store) F' || p_partkey || '(a, b int, c ' || {_W2} || '.T) (int, error) {{~    if a == 0 {{~        return 0, nil~    }}~    if err != nil {{~        panic(\"x\")~    }}~    run' || p_partkey || '(a)~    return 1, nil~}}~'".replace("{{", "{").replace("}}", "}")


@query(f"SELECT 'Store.F' || p_partkey AS name, 'a:int,b:int,c:' || w2 || '.T' AS params, 'Saves ' || w1 AS purpose, 'run' || p_partkey AS calls, 'a == 0,err != nil' AS edge_cases, 'try-catch,throw' AS errors, 4 AS start_line, 13 AS end_line, true AS is_exported FROM {_sql(w1=_W1, w2=_W2)}")
def go_methods(spark, sf):
    """Methods of Go sources: receiver, shared types, comment, calls, conditions and panics."""
    c = parsing.child(_parsed(spark, sf, "'store/f' || p_partkey || '.go'", _GO, ["classes"]), "classes")
    f = c.select(F.explode("methods").alias("m")).select("m.*")
    params = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",")
    errors = F.array_join(F.transform("error_handling", lambda e: e["type"]), ",")
    return f.select("name", params.alias("params"), "purpose", F.array_join("calls", ",").alias("calls"), F.array_join("edge_cases", ",").alias("edge_cases"), errors.alias("errors"), "start_line", "end_line", "is_exported")


_PAGE = _case("p_partkey % 3", ["'app/(shop)/p' || p_partkey || '/route.ts'", "'app/api/p' || p_partkey || '/[id]/route.ts'", "'src/app/p' || p_partkey || '/page.tsx'"])


@query("SELECT CASE p_partkey % 3 WHEN 0 THEN '/p' || p_partkey ELSE '/api/p' || p_partkey || '/:id' END AS url, unnest(['GET', 'POST']) AS method FROM part WHERE p_partkey % 3 <> 2")
def page_routes(spark, sf):
    """Routes that files declare by their place."""
    text = "'export function GET() {}~export async function POST() {}~export function helper() {}~'"
    return parsing.next_routes(_parsed(spark, sf, _PAGE, text, ["functions", "generics"])).select("url", "method")


_FOUND = _case("p_partkey % 9", ["'src/p' || p_partkey || '.ts'", "'src/p' || p_partkey || '.test.ts'", "'node_modules/p/' || p_partkey || '.ts'", "'dist/p' || p_partkey || '.js'", "'lib/deep/p' || p_partkey || '.jsx'", "'p' || p_partkey || '.py'", "'src/gen/p' || p_partkey || '.ts'", "'src/p' || p_partkey || '.d.ts'", "'old/p' || p_partkey || '.tsx'"])


@query(f"SELECT path FROM {_sql(path=_FOUND)} WHERE p_partkey % 9 IN (0, 4)")
def discovered_files(spark, sf):
    """Sources of a language without what it and an ignore file leave out."""
    files = _parts(spark, sf, path=_FOUND).select("path")
    return parsing.discover(files, "typescript", parsing.ignore_globs("# made\ngen/\n\n!kept.ts\nold/*.tsx\n"))


@query(f"SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM {A.FUNCTIONS}")
def id_ranks(spark, sf):
    """The numbers that a written snapshot gives to ids."""
    return snapshot.ranks(A.functions(spark, sf))


@query(f"SELECT f.id, f.name, coalesce(string_agg(c.dst, ',' ORDER BY c.dst), '') AS calls FROM {A.FUNCTIONS} f LEFT JOIN {A.CALLS} c ON c.src = f.id GROUP BY f.id, f.name")
def snapshot_round_trip(spark, sf):
    """Functions and their calls after they were written in compact form and read again."""
    calls = A.part_calls(spark, sf).groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("calls"))
    f = A.functions(spark, sf).select("id", "name").join(calls, "id", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))
    path = f"{scratch_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.write_snapshot(f, path)
    return snapshot.read_snapshot(spark, path, "id string, name string").select("id", "name", F.array_join("calls", ",").alias("calls"))


@query(f"WITH d AS (SELECT coalesce(d.path, l.path) AS path, CASE WHEN d.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM {A.DISK} d FULL JOIN {A.FILES} l ON d.path = l.path WHERE l.path IS NOT NULL AND (d.path IS NULL OR left(d.hash, 16) <> left(l.hash, 16))), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY path) AS k FROM d) SELECT status, count(*) AS total, string_agg(path, ',' ORDER BY path) FILTER (k <= 50) AS paths FROM r GROUP BY status")
def listed_changes(spark, sf):
    """Changed files as the tools list them: how many, the first of them, and new ones only if they are sources."""
    from loomgraph.api import Project

    f = A.files(spark, sf)
    listed = Project(f, f, f, f, f).listed_changes(A.disk(spark, sf))
    return listed.select("status", "total", F.array_join("paths", ",").alias("paths"))
