"""All queries over the reference's operators, each with the SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import context, graph, reports, search
from loomgraph.operators import relational as R
from loomgraph.plans import adapters as A
from loomgraph.sources import pages
from loomgraph.streaming import batches

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str = ""):
    """Registers a function of (spark, sf_dir) under its name, with its oracle SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import texts  # noqa: F401 - registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def _changed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("s:1",)], "id string")


_HIT = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {A.EDGES}), w(id, depth) AS (SELECT 's:1', 0 UNION SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.id WHERE w.depth < 8),
hit AS (SELECT id, min(depth) AS depth FROM w GROUP BY id HAVING min(depth) > 0),
risk AS (SELECT h.id, n.module_id, h.depth, CASE WHEN depth = 1 AND n.module_id NOT IN (SELECT module_id FROM {A.NODES} WHERE id = 's:1') THEN 'critical' WHEN depth = 1 THEN 'high' WHEN depth = 2 THEN 'medium' ELSE 'low' END AS risk FROM hit h JOIN {A.NODES} n ON n.id = h.id)
"""


@query(_HIT + "SELECT id, module_id, depth, risk FROM risk")
def impact_risk(spark, sf):
    return graph.impact(A.edges(spark, sf), A.nodes(spark, sf), _changed(spark))


@query(_HIT + """SELECT count(*) AS impacted, max(depth) AS depth, count(*) FILTER (risk = 'critical') AS critical, count(*) FILTER (risk = 'high') AS high, count(*) FILTER (risk = 'medium') AS medium, count(*) FILTER (risk = 'low') AS low,
CASE WHEN count(*) < 5 AND max(depth) < 3 THEN 'high' WHEN count(*) < 20 AND max(depth) < 6 THEN 'medium' ELSE 'low' END AS confidence FROM risk""")
def impact_summary(spark, sf):
    return graph.impact_summary(impact_risk(spark, sf))


@query(_HIT + "SELECT risk, id, rank, total > 10 AS truncated FROM (SELECT risk, id, row_number() OVER (PARTITION BY risk ORDER BY depth, id) AS rank, count(*) OVER (PARTITION BY risk) AS total FROM risk) WHERE rank <= 10")
def impact_truncated(spark, sf):
    return graph.truncated(impact_risk(spark, sf))


@query(_HIT + f"SELECT e.src, e.dst FROM e WHERE e.src IN (SELECT id FROM risk WHERE depth <= 2 UNION SELECT 's:1') AND e.dst IN (SELECT id FROM risk WHERE depth <= 2 UNION SELECT 's:1')")
def impact_subgraph(spark, sf):
    return graph.subgraph(A.edges(spark, sf), graph.bfs(A.edges(spark, sf), _changed(spark), most=2))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src AS a, dst AS b FROM {A.CALLS} UNION SELECT dst, src FROM {A.CALLS}), w(id, depth) AS (SELECT 'p:1', 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth FROM w GROUP BY id""")
def bfs_bounded_undirected(spark, sf):
    return graph.bfs(A.part_calls(spark, sf), spark.createDataFrame([("p:1",)], "id string"), most=3, undirected=True)


_EXEMPT = r"(is_exported OR regexp_matches(name, '(?i)^(main|bootstrap|start|init|setup|configure|register|mount)$|(?i)^(app|server|index|mod|program)$|(?i)(Handler|Middleware|Controller)$|^use[A-Z]|^handle[A-Z]|^on[A-Z]'))"
_DEAD = f"SELECT id, name, file, module_id, is_exported, size, 'No callers found anywhere in the codebase' AS reason FROM {A.FUNCTIONS} WHERE id NOT IN (SELECT dst FROM {A.CALLS}) AND NOT {_EXEMPT}"


@query(_DEAD)
def dead_nodes(spark, sf):
    return graph.dead(A.functions(spark, sf), A.part_calls(spark, sf))


@query(f"WITH d AS ({_DEAD}) SELECT f.module_id, count(d.id) AS dead, count(*) AS total, round(count(d.id) / count(*)::DOUBLE * 1000) / 10 AS percent FROM {A.FUNCTIONS} f LEFT JOIN d ON d.id = f.id GROUP BY f.module_id")
def dead_by_module(spark, sf):
    return graph.dead_by_module(A.functions(spark, sf), dead_nodes(spark, sf))


@query(f"SELECT module_id, id, rank FROM (SELECT module_id, id, row_number() OVER (PARTITION BY module_id ORDER BY id) AS rank FROM ({_DEAD})) WHERE rank <= 15")
def dead_top_per_module(spark, sf):
    return R.top_in(dead_nodes(spark, sf), ["module_id"], [F.col("id")], 15).select("module_id", "id", "rank")


@query(f"SELECT id, name FROM {A.FUNCTIONS} WHERE id NOT IN (SELECT dst FROM {A.CALLS})")
def entry_points(spark, sf):
    return A.functions(spark, sf).join(A.called_parts(spark, sf), "id", "left_anti").select("id", "name")


@query(f"WITH c AS {A.CALLS} SELECT f.id FROM {A.FUNCTIONS} f WHERE EXISTS (SELECT 1 FROM c JOIN {A.FUNCTIONS} g ON g.id = c.src WHERE c.dst = f.id AND g.is_exported AND g.file = f.file)")
def called_by_exported_in_file(spark, sf):
    f = A.functions(spark, sf)
    callers = A.part_calls(spark, sf).join(f.where("is_exported").select(F.col("id").alias("src"), F.col("file").alias("caller_file")), "src")
    return f.join(callers, (F.col("id") == F.col("dst")) & (F.col("file") == F.col("caller_file")), "left_semi").select("id")


_SCORES = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src AS a, dst AS b FROM {A.CALLS} UNION SELECT dst, src FROM {A.CALLS}), seeds AS (SELECT id FROM {A.FUNCTIONS} WHERE contains(name, '{{0}}') OR contains(lower(file), '{{0}}')),
w(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.id WHERE w.depth < 4), d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
SELECT f.id, round((CASE WHEN depth <= 1 THEN 1.0 WHEN depth = 2 THEN 0.6 WHEN depth = 3 THEN 0.35 WHEN depth IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN name = '{{0}}' THEN 0.9 WHEN contains(name, '{{0}}') OR contains(lower(file), '{{0}}') THEN 0.45 ELSE 0 END + CASE WHEN f.id NOT IN (SELECT dst FROM {A.CALLS}) THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS score FROM {A.FUNCTIONS} f LEFT JOIN d ON d.id = f.id"""


_FAN = f"(SELECT id, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM {A.CALLS} UNION ALL SELECT dst, 1, 0 FROM {A.CALLS}) GROUP BY id)"


@query(f"SELECT module_id, kind, id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY module_id, kind ORDER BY n DESC, id) AS rank FROM (SELECT module_id, 'in' AS kind, id, CAST(fan_in AS BIGINT) AS n FROM {_FAN} JOIN {A.FUNCTIONS} USING (id) UNION ALL SELECT module_id, 'out', id, CAST(fan_out AS BIGINT) FROM {_FAN} JOIN {A.FUNCTIONS} USING (id))) WHERE rank <= 5")
def fan_in_out_topk(spark, sf):
    f = graph.fan(A.part_calls(spark, sf)).join(A.functions(spark, sf).select("id", "module_id"), "id")
    long = f.select("module_id", "id", F.explode(F.array(F.struct(F.lit("in").alias("kind"), F.col("fan_in").alias("n")), F.struct(F.lit("out").alias("kind"), F.col("fan_out").alias("n")))).alias("x")).select("module_id", "id", "x.kind", "x.n")
    return R.top_in(long, ["module_id", "kind"], [F.desc("n"), F.col("id")], 5).select("module_id", "kind", "id", "n", "rank")


@query(f"SELECT src AS id, row_number() OVER (PARTITION BY src ORDER BY dst) AS place, dst AS other FROM {A.CALLS}")
def adjacency_lists(spark, sf):
    return graph.neighbours(A.part_calls(spark, sf))


@query(f"""SELECT f.id, f.name, f.module_id, coalesce(o.calls, '') AS calls, coalesce(i.called_by, '') AS called_by FROM {A.FUNCTIONS} f
LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS calls FROM {A.CALLS} GROUP BY src) o ON o.src = f.id LEFT JOIN (SELECT dst, string_agg(src, ',' ORDER BY src) AS called_by FROM {A.CALLS} GROUP BY dst) i ON i.dst = f.id""")
def snapshot_functions(spark, sf):
    e, join = A.part_calls(spark, sf), lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    out = e.groupBy(F.col("src").alias("id")).agg(join("dst").alias("calls"))
    into = e.groupBy(F.col("dst").alias("id")).agg(join("src").alias("called_by"))
    return A.functions(spark, sf).join(out, "id", "left").join(into, "id", "left").fillna("", ["calls", "called_by"]).select("id", "name", "module_id", "calls", "called_by")


@query(f"SELECT from_module, to_module, count(*) AS calls FROM {A.MODED} WHERE from_module <> to_module GROUP BY ALL")
def cross_module_calls(spark, sf):
    return graph.cross_calls(A.moded(spark, sf))


@query("SELECT from_module, " + ", ".join(f"CAST(count(*) FILTER (to_module = '{i}' AND from_module <> to_module) AS BIGINT) AS to_{i}" for i in range(5)) + f" FROM {A.MODED} WHERE from_module IN (SELECT from_module FROM {A.MODED} WHERE from_module <> to_module) GROUP BY from_module")
def dependency_matrix(spark, sf):
    m = R.pivot_counts(graph.cross_calls(A.moded(spark, sf)), "from_module", "to_module", "calls", [str(i) for i in range(5)])
    return m.select("from_module", *[F.col(str(i)).alias(f"to_{i}") for i in range(5)])


@query(f"""SELECT n.module_id, n.functions, coalesce(c.external, 0) AS coupling, round(coalesce(c.cohesion, 0.5), 6) AS cohesion, round(coalesce(c.cohesion, 0.5) * 0.6 + least(1.0, 10.0::DOUBLE / n.functions) * 0.4, 6) AS health
FROM (SELECT module_id, count(*) AS functions FROM {A.NODES} GROUP BY module_id) n LEFT JOIN (SELECT from_module, count(*) FILTER (from_module <> to_module) AS external, count(*) FILTER (from_module = to_module) / count(*)::DOUBLE AS cohesion FROM {A.MODED} GROUP BY from_module) c ON c.from_module = n.module_id""")
def module_health(spark, sf):
    return graph.module_health(A.moded(spark, sf), A.nodes(spark, sf))


_VIOLATIONS = f"""(SELECT src, dst, from_module, to_module, arg_min(kind, ord) AS kind, min(ord) AS rule FROM (
 SELECT *, 0 AS ord, 'deny' AS kind FROM {A.MODED} WHERE from_module = '0' AND to_module = '1'
 UNION ALL SELECT *, 1, 'isolated' FROM {A.MODED} WHERE from_module = '2' AND to_module <> '2'
 UNION ALL SELECT *, 2, 'allow_only' FROM {A.MODED} WHERE from_module = '3' AND to_module NOT IN ('3', '4')
 UNION ALL SELECT *, 3, 'deny' FROM {A.MODED} WHERE from_module = '0' AND to_module IN ('1', '2')) GROUP BY src, dst, from_module, to_module)"""


@query(f"SELECT * FROM {_VIOLATIONS}")
def boundary_violations(spark, sf):
    return graph.violations(A.moded(spark, sf), A.rules(spark))


@query(f"SELECT count(*) AS errors, count(DISTINCT rule) AS rules_broken, count(*) = 0 AS pass FROM {_VIOLATIONS}")
def boundary_summary(spark, sf):
    return graph.summary_of(boundary_violations(spark, sf))


@query(f"SELECT DISTINCT dst AS id, to_module AS module_id FROM {A.MODED} WHERE from_module <> to_module")
def public_api_nodes(spark, sf):
    return graph.public_api(A.moded(spark, sf))


_MODULES = [("cheap", ["src/economy/**", "src/small/*.ts"]), ("brand1", ["src/**/Brand1*.ts"]), ("large", ["src/large/**"])]


@query(f"SELECT id, file AS path, CASE WHEN regexp_matches(file, '^src/economy/.*$') OR regexp_matches(file, '^src/small/[^/]*\\.ts$') THEN 'cheap' WHEN regexp_matches(file, '^src/(?:.+/)?Brand1[^/]*\\.ts$') THEN 'brand1' WHEN regexp_matches(file, '^src/large/.*$') THEN 'large' ELSE 'unknown' END AS module_id FROM {A.FUNCTIONS}")
def module_assignment_glob(spark, sf):
    return R.assign_modules(A.functions(spark, sf).select("id", F.col("file").alias("path")), _MODULES, S.glob_regex)


@query(f"""WITH f AS {A.FUNCTIONS}, e AS (SELECT a.file AS fa, b.file AS fb FROM {A.CALLS} c JOIN f a ON a.id = c.src JOIN f b ON b.id = c.dst WHERE a.file <> b.file UNION ALL SELECT file, target FROM {A.IMPORTED}),
d AS (SELECT file, sum(n) AS n FROM (SELECT file, count(*) AS n FROM f GROUP BY file UNION ALL SELECT file, count(*) FROM {A.IMPORTED} GROUP BY file UNION ALL SELECT target, count(*) FROM {A.IMPORTED} GROUP BY target) GROUP BY file),
p AS (SELECT least(fa, fb) AS a, greatest(fa, fb) AS b, count(*) AS pairs FROM e GROUP BY ALL)
SELECT p.a, p.b, p.pairs, round(2.0::DOUBLE * p.pairs / (x.n + y.n), 6) AS score FROM p JOIN d x ON x.file = p.a JOIN d y ON y.file = p.b""")
def coupling_scores(spark, sf):
    f, imported = A.functions(spark, sf), A.imported(spark, sf)
    files = f.select("file").distinct()
    nodes = f.select("id", "file").unionByName(files.select(F.col("file").alias("id"), "file"))
    imports = imported.select(F.col("file").alias("src"), F.col("target").alias("dst"))
    ends = f.select("file").unionByName(imports.select(F.col("src").alias("file"))).unionByName(imports.select(F.col("dst").alias("file")))
    return graph.coupling(A.part_calls(spark, sf).unionByName(imports), nodes, ends.groupBy("file").agg(F.count("*").alias("n")))


@query(f"SELECT m.module_id, round(coalesce(c, 0.5::DOUBLE), 6) AS confidence FROM (SELECT DISTINCT module_id FROM {A.FUNCTIONS}) m LEFT JOIN (SELECT from_module, avg(CAST(from_module = to_module AS INT)) AS c FROM {A.PMODED} GROUP BY from_module) x ON x.from_module = m.module_id")
def cluster_confidence(spark, sf):
    return graph.cluster_confidence(A.part_moded(spark, sf), A.functions(spark, sf))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {A.CALLS}), reach(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b), core AS (SELECT DISTINCT a FROM reach WHERE a = b)
SELECT DISTINCT a AS id FROM reach WHERE b IN (SELECT a FROM core)""")
def reachable_cycles(spark, sf):
    return graph.on_cycles(A.part_calls(spark, sf))


@query(f"""WITH x AS (SELECT id FROM (SELECT src AS id FROM {A.PMODED} WHERE from_module <> to_module UNION SELECT dst FROM {A.PMODED} WHERE from_module <> to_module)),
c AS (SELECT f.module_id, f.id, CAST(coalesce(n.fan_in, 0) + coalesce(n.fan_out, 0) AS BIGINT) AS connections, coalesce(n.fan_in, 0) = 0 OR f.is_exported OR f.id IN (SELECT id FROM x) AS own FROM {A.FUNCTIONS} f LEFT JOIN {_FAN} n USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY module_id ORDER BY own DESC, connections DESC, id) AS place, count(*) OVER (PARTITION BY module_id) AS size, sum(CAST(own AS INT)) OVER (PARTITION BY module_id) AS owns FROM c)
SELECT module_id, id, connections, row_number() OVER (PARTITION BY module_id ORDER BY connections DESC, id) AS rank FROM r WHERE size <= 40 OR (place <= 40 AND (own OR owns < least(10, size)))""")
def important_functions(spark, sf):
    return graph.important(A.functions(spark, sf), A.part_moded(spark, sf))


@query(f"SELECT coalesce(d.path, l.path) AS path, CASE WHEN l.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM {A.DISK} d FULL JOIN {A.FILES} l ON d.path = l.path WHERE d.path IS NULL OR l.path IS NULL OR d.hash <> l.hash")
def drift_full_outer(spark, sf):
    return R.drift(A.disk(spark, sf), A.files(spark, sf))


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.path IS NULL THEN 'added' WHEN d.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM {A.DISK} d FULL JOIN {A.FILES} l ON d.path = l.path WHERE d.path IS NULL OR l.path IS NULL OR left(d.hash, 16) <> left(l.hash, 16)) GROUP BY status")
def drift_prefix16(spark, sf):
    return R.drift(A.disk(spark, sf), A.files(spark, sf), 16).groupBy("status").agg(F.count("*").alias("n"))


_MERKLE = f"(SELECT module_id, sha256(string_agg(hash, '' ORDER BY hash)) AS hash FROM {A.FILES} GROUP BY module_id)"


@query(f"SELECT module_id, hash FROM {_MERKLE}")
def merkle_module_hash(spark, sf):
    return R.merkle(A.files(spark, sf))


@query(f"SELECT sha256(string_agg(hash, '' ORDER BY module_id)) AS root FROM {_MERKLE}")
def merkle_root_hash(spark, sf):
    return R.merkle_root(R.merkle(A.files(spark, sf)))


@query(f"SELECT path, user_id, hash, seq FROM (SELECT *, row_number() OVER (PARTITION BY path, user_id ORDER BY ts DESC, seq DESC) AS n FROM {A.CHANGES}) WHERE n = 1")
def upsert_latest(spark, sf):
    return R.last_wins(A.changes(spark, sf), ["path", "user_id"], [F.col("ts"), F.col("seq")]).select("path", "user_id", "hash", "seq")


@query("SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS body, sha256(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10))) AS hash FROM documents WHERE text IS NOT NULL")
def line_slice(spark, sf):
    body = S.lines_between(F.col("text"), 2, 4)
    return A.table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", body.alias("body"), F.sha2(body, 256).alias("hash"))


def _stop(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_KEYWORDS = f"(SELECT conv_id, turn, w FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')) AS w FROM conversations WHERE text IS NOT NULL) WHERE length(w) > 2 AND w NOT IN {_stop(S.PROMPT_STOP)})"


@query(f"SELECT conv_id, turn, w AS keyword, count(*) AS n FROM {_KEYWORDS} GROUP BY ALL")
def keyword_extract(spark, sf):
    c = A.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(S.keywords(F.col("text"))).alias("keyword"))
    return c.groupBy("conv_id", "turn", "keyword").agg(F.count("*").alias("n"))


@query(f"SELECT w AS keyword, count(DISTINCT conv_id) AS df FROM {_KEYWORDS} GROUP BY w")
def keyword_df(spark, sf):
    c = A.table(spark, sf, "conversations").select("conv_id", F.explode(S.keywords(F.col("text"))).alias("keyword"))
    return c.groupBy("keyword").agg(F.count_distinct("conv_id").alias("df"))


def _camel_sql(c: str, digits: str = "") -> str:
    return rf"regexp_replace(regexp_replace({c}, '([a-z{digits}])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"


@query(rf"SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array({_camel_sql('n')}, '[\s_-]+'), lambda x: x <> ''), '|') AS words, array_to_string(list_filter(list_transform(regexp_split_to_array({_camel_sql('n', '0-9')}, '[\s_.-]+'), lambda x: lower(x)), lambda x: length(x) > 1), '|') AS bag FROM (SELECT p_partkey, p_name || 'HTTPServer_' || p_brand || 'getValue2X.ts' AS n FROM part)")
def camel_split(spark, sf):
    n = F.concat("p_name", F.lit("HTTPServer_"), "p_brand", F.lit("getValue2X.ts"))
    return A.table(spark, sf, "part").select("p_partkey", F.array_join(S.words_of(n), "|").alias("words"), F.array_join(S.words_of(n, keep_dots=False, digits=True, lower=True, least=2), "|").alias("bag"))


_WORDS = "string_split(name, '_')"


@query(f"""SELECT id, name, score FROM (SELECT id, name, round(least(1.0, (CASE WHEN contains('polish the small_ring economy', lower(name)) AND length(name) > 3 THEN 0.9 ELSE 0 END)
 + list_sum(list_transform(['polish', 'small', 'ring', 'economy'], lambda k: (CASE WHEN contains(name, k) THEN 0.3 ELSE 0 END) + (CASE WHEN contains(lower(file), k) THEN 0.15 ELSE 0 END) + (CASE WHEN len(list_filter({_WORDS}, lambda w: starts_with(w, k) OR starts_with(k, w))) > 0 THEN 0.2 ELSE 0 END) + (CASE WHEN contains(module_id, k) THEN 0.25 ELSE 0 END)))::DOUBLE), 6) AS score FROM {A.FUNCTIONS}) WHERE score > 0.2 ORDER BY score DESC, id LIMIT 10""")
def fuzzy_topk(spark, sf):
    prompt, words = "polish the small_ring economy", ["polish", "small", "ring", "economy"]
    score = F.round(F.least(F.lit(1.0), search.prompt_score(F.col("name"), F.col("file"), F.col("module_id"), prompt, words)), 6)
    return A.functions(spark, sf).select("id", "name", score.alias("score")).where("score > 0.2").orderBy(F.desc("score"), "id").limit(10)


@query(f"SELECT DISTINCT name, round(1 - levenshtein('smal ring', name)::DOUBLE / greatest(9, length(name)) + CASE WHEN contains(name, 'smal ring') OR contains('smal ring', name) THEN 0.3 ELSE 0 END, 6) AS score FROM {A.FUNCTIONS} WHERE 1 - levenshtein('smal ring', name)::DOUBLE / greatest(9, length(name)) + CASE WHEN contains(name, 'smal ring') OR contains('smal ring', name) THEN 0.3 ELSE 0 END > 0.5 ORDER BY score DESC, name LIMIT 5")
def did_you_mean(spark, sf):
    s = search.similarity(F.col("name"), "smal ring")
    return A.functions(spark, sf).select("name", s.alias("score")).distinct().where("score > 0.5").select("name", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "name").limit(5)


@query(_SCORES.format("ring"))
def context_scores(spark, sf):
    f, e = A.functions(spark, sf), A.part_calls(spark, sf)
    k = search.keyword_score(F.col("name"), F.col("file"), ["ring"])
    d = graph.bfs(e, f.where(k >= 0.45).select("id"), most=4, undirected=True)
    called = e.select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    score = F.coalesce(S.depth_score(F.col("depth")), F.lit(0.0)) + k + F.when(F.col("called").isNull(), 0.2).otherwise(0.0)
    return f.join(d, "id", "left").join(called, "id", "left").select("id", F.round(score, 6).alias("score"))


@query("SELECT conv_id, turn, used FROM (SELECT conv_id, turn, CAST(sum(CAST(ceil(length(text) / 4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 300")
def budget_prefix(spark, sf):
    c = A.table(spark, sf, "conversations")
    return R.within_budget(c, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], S.estimate_tokens(F.col("text")), 300).select("conv_id", "turn", "used")


@query("""WITH RECURSIVE s AS MATERIALIZED (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY ceil(length(text) / 4.0), turn) AS k FROM conversations WHERE text IS NOT NULL),
g(conv_id, k, turn, tokens, used, kept, taken) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM s UNION ALL SELECT s.conv_id, s.k, s.turn, s.tokens, CASE WHEN g.kept < 80 AND g.used + s.tokens <= 300 THEN g.used + s.tokens ELSE g.used END, CASE WHEN g.kept < 80 AND g.used + s.tokens <= 300 THEN g.kept + 1 ELSE g.kept END, g.kept < 80 AND g.used + s.tokens <= 300 FROM g JOIN s ON s.conv_id = g.conv_id AND s.k = g.k + 1)
SELECT conv_id, kept AS place, tokens, turn FROM g WHERE taken""")
def greedy_pack(spark, sf):
    c = A.table(spark, sf, "conversations").withColumn("tokens", S.estimate_tokens(F.col("text")))
    return R.greedy_pack(c, ["conv_id"], ["tokens", "turn"], "tokens", 300)


_Q = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 7)"


@query(f"SELECT vec_id, round(greatest(-1.0, least(1.0, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE)))), 3) AS score FROM embeddings, {_Q} ORDER BY score DESC, vec_id LIMIT 10")
def semantic_topk(spark, sf):
    e = A.table(spark, sf, "embeddings")
    return search.nearest(e, "embedding", e.where("vec_id = 7"), 10, "vec_id")


#: Domains for the parts' words.
_DOMAINS = {"Fasteners": ["bolt", "screw", "nut"], "Rings": ["ring", "washer"], "Gears": ["gear", "cog"], "Colours": ["red", "blue", "green"], "Sizes": ["small", "large", "big"]}


@query(f"SELECT file AS \"group\", domain, count(*) AS score FROM (SELECT file, unnest(string_split(name, '_')) AS word FROM {A.FUNCTIONS}), (VALUES {', '.join(f'({chr(39)}{d}{chr(39)}, {chr(39)}{k}{chr(39)})' for d, ks in _DOMAINS.items() for k in ks)}) AS t(domain, keyword) WHERE contains(word, keyword) GROUP BY ALL")
def domain_naming(spark, sf):
    words = A.functions(spark, sf).select(F.col("file").alias("group"), F.explode(S.words_of(F.col("name"))).alias("word"))
    return search.domain_scores(words, _DOMAINS)


@query(f"SELECT name, module_id, min(file) AS file, coalesce(string_agg(DISTINCT file, ',' ORDER BY file) FILTER (n > 1), '') AS also_in FROM (SELECT *, row_number() OVER (PARTITION BY name, module_id ORDER BY file) AS n FROM (SELECT DISTINCT name, module_id, file FROM {A.FUNCTIONS})) GROUP BY name, module_id")
def generic_dedup_alsoin(spark, sf):
    f = A.functions(spark, sf).select("name", "module_id", "file").distinct()
    return R.first_with_others(f, ["name", "module_id"], F.col("file"), "file")


@query(f"SELECT id, CASE WHEN n = 1 THEN name ELSE name || '-' || n END AS label FROM (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM {A.FUNCTIONS})")
def dup_id_suffix(spark, sf):
    return A.functions(spark, sf).select("id", R.numbered_duplicates("name", F.col("id")).alias("label"))


@query(f"SELECT id, CASE WHEN n > 1 THEN name || ' (' || module_id || ')' ELSE name END AS label FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM {A.FUNCTIONS})")
def dup_name_labels(spark, sf):
    return A.functions(spark, sf).select("id", R.told_apart("name", "module_id").alias("label"))


@query("SELECT source, arg_min(lang, (-n, lang)) AS lang FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY source")
def language_mode(spark, sf):
    return R.most_frequent(A.table(spark, sf, "documents").where("lang IS NOT NULL"), ["source"], "lang")


@query(f"SELECT path, hash, seq FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, seq DESC) AS n FROM {A.CHANGES}) WHERE n = 1")
def latest_event_per_key(spark, sf):
    return batches.latest(A.changes(spark, sf)).select("path", "hash", "seq")


_SESSION = f"""(SELECT user_id, s, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, count(DISTINCT path) AS paths FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, seq) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, seq) IS NULL THEN 1 ELSE 0 END AS fresh FROM {A.CHANGES})) GROUP BY user_id, s)"""


@query(f"SELECT user_id, first_ts, last_ts, events, paths FROM {_SESSION}")
def debounce_sessions(spark, sf):
    return batches.debounce(A.changes(spark, sf), "user_id", "6 hours").select("user_id", "first_ts", "last_ts", "events", "paths")


@query(f"SELECT user_id, first_ts, events, CASE WHEN events > 15 THEN 'full' ELSE 'incremental' END AS mode FROM {_SESSION}")
def batch_mode_switch(spark, sf):
    return batches.with_mode(batches.debounce(A.changes(spark, sf), "user_id", "6 hours")).select("user_id", "first_ts", "events", "mode")


@query(f"SELECT seq, path, before, hash FROM (SELECT *, lag(hash) OVER (PARTITION BY path ORDER BY ts, seq) AS before FROM {A.CHANGES}) WHERE before IS NULL OR before <> hash")
def hash_change_lag(spark, sf):
    return R.changed_values(A.changes(spark, sf), "path", [F.col("ts"), F.col("seq")], "hash").select("seq", "path", "before", "hash")


@query(f"SELECT f.module_id, count(*) AS modified FROM {A.DISK} d JOIN {A.FILES} f ON f.path = d.path WHERE d.hash <> f.hash GROUP BY f.module_id ORDER BY modified DESC, f.module_id LIMIT 5")
def hot_modules(spark, sf):
    m = R.drift(A.disk(spark, sf), A.files(spark, sf)).where("status = 'modified'").join(A.files(spark, sf).select("path", "module_id"), "path")
    return m.groupBy("module_id").agg(F.count("*").alias("modified")).orderBy(F.desc("modified"), "module_id").limit(5)




@query("SELECT DISTINCT p.page_id AS source, h AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS h FROM pages) p WHERE h IN (SELECT h FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS h FROM pages) GROUP BY h HAVING count(DISTINCT page_id) > 1)")
def page_link_graph(spark, sf):
    p = A.table(spark, sf, "pages")
    shared = pages.links(p).groupBy(F.col("target").alias("path")).agg(F.count("*").alias("n")).where("n > 1")
    return pages.link_graph(p, shared)


@query(f"SELECT count(*) AS functions, count(DISTINCT file) AS files, count(DISTINCT module_id) AS modules, count(*) FILTER (is_exported) AS exported, round(avg(size)) AS average_size FROM {A.FUNCTIONS}")
def stats_overview(spark, sf):
    return A.functions(spark, sf).agg(F.count("*").alias("functions"), F.count_distinct("file").alias("files"), F.count_distinct("module_id").alias("modules"), F.count_if("is_exported").alias("exported"), F.round(F.avg("size")).alias("average_size"))


@query(f"SELECT m.module_id, coalesce(n, 0) AS functions, coalesce(files, 0) AS files, coalesce(x, 0) AS exported FROM (SELECT lower(p_type) AS module_id FROM part UNION SELECT 'empty') m LEFT JOIN (SELECT module_id, count(*) AS n, count(DISTINCT file) AS files, count(*) FILTER (is_exported) AS x FROM {A.FUNCTIONS} GROUP BY module_id) f ON f.module_id = m.module_id")
def module_overview(spark, sf):
    f = A.functions(spark, sf)
    m = f.select("module_id").distinct().unionByName(spark.createDataFrame([("empty",)], "module_id string"))
    n = f.groupBy("module_id").agg(F.count("*").alias("functions"), F.count_distinct("file").alias("files"), F.count_if("is_exported").alias("exported"))
    return m.join(n, "module_id", "left").fillna(0)


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT DISTINCT file AS src, id AS dst, 'contains' AS type FROM {A.FUNCTIONS} UNION ALL SELECT DISTINCT module_id, file, 'contains' FROM {A.FUNCTIONS}")
def containment_edges(spark, sf):
    f = A.functions(spark, sf)
    return f.select(F.col("file").alias("src"), F.col("id").alias("dst")).distinct().unionByName(f.select(F.col("module_id").alias("src"), F.col("file").alias("dst")).distinct()).withColumn("type", F.lit("contains"))


@query(f"SELECT name, arg_max(id, (ord, id)) AS id FROM (SELECT name, id, size AS ord FROM {A.FUNCTIONS}) GROUP BY name")
def node_build_last_wins(spark, sf):
    return R.last_wins(A.functions(spark, sf), ["name"], [F.col("size"), F.col("id")]).select("name", "id")


@query(f"""WITH f AS {A.FUNCTIONS}, c AS (SELECT a.id AS src, a.file, b.name FROM {A.CALLS} e JOIN f a ON a.id = e.src JOIN f b ON b.id = e.dst), k AS (SELECT file, name, min(id) AS id FROM f GROUP BY file, name),
i AS (SELECT a.file, b.name, max(b.file) AS target FROM {A.CALLS} e JOIN f a ON a.id = e.src JOIN f b ON b.id = e.dst WHERE a.file <> b.file AND b.is_exported GROUP BY a.file, b.name)
SELECT c.src, coalesce(g.id, h.id) AS dst, CASE WHEN g.id IS NOT NULL THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM c LEFT JOIN i ON i.file = c.file AND i.name = c.name LEFT JOIN k g ON g.file = i.target AND g.name = c.name
LEFT JOIN k h ON h.file = c.file AND h.name = c.name AND h.id <> c.src WHERE coalesce(g.id, h.id) IS NOT NULL""")
def call_resolution(spark, sf):
    f, e = A.functions(spark, sf), A.part_calls(spark, sf)
    both = e.join(f.select(F.col("id").alias("src"), F.col("file").alias("file")), "src").join(f.select(F.col("id").alias("dst"), F.col("name").alias("name"), F.col("file").alias("target"), "is_exported"), "dst")
    listed = both.where("file <> target AND is_exported").select("file", "name", "target").distinct().withColumn("ord", F.lit(0))
    return R.resolve_calls(both.select("src", "file", "name"), listed, f)


@query(f"SELECT id, name FROM {A.FUNCTIONS} WHERE contains(lower(name), 'ring') OR contains(lower(id), 'ring') ORDER BY id LIMIT 20")
def search_functions(spark, sf):
    return A.functions(spark, sf).where("contains(lower(name), 'ring') OR contains(lower(id), 'ring')").select("id", "name").orderBy("id").limit(20)


@query(f"SELECT id FROM {A.FUNCTIONS} WHERE name = 'small_ring' OR name LIKE '%.small_ring' OR contains(id, 'small_ring')")
def name_match(spark, sf):
    return A.functions(spark, sf).where("name = 'small_ring' OR endswith(name, '.small_ring') OR contains(id, 'small_ring')").select("id")


@query(f"SELECT DISTINCT g.id, g.name, f.id AS used FROM {A.CALLS} e JOIN {A.FUNCTIONS} f ON f.id = e.dst JOIN {A.FUNCTIONS} g ON g.id = e.src WHERE f.name = 'small_ring'")
def find_usages(spark, sf):
    f = A.functions(spark, sf)
    used = A.part_calls(spark, sf).join(f.where("name = 'small_ring'").select(F.col("id").alias("dst")), "dst")
    return used.join(f.select(F.col("id").alias("src"), "name"), "src").select(F.col("src").alias("id"), "name", F.col("dst").alias("used"))


@query(f"WITH f AS (SELECT id, file FROM {A.FUNCTIONS}), exact AS (SELECT id FROM f WHERE file = 'Brand12.ts') SELECT id FROM exact UNION ALL SELECT id FROM f WHERE regexp_extract(file, '[^/]*$') = 'Brand12.ts' AND NOT EXISTS (SELECT 1 FROM exact)")
def file_match_fallback(spark, sf):
    f = A.functions(spark, sf).select("id", "file")
    exact, base = f.where("file = 'Brand12.ts'"), f.where("substring_index(file, '/', -1) = 'Brand12.ts'")
    none = exact.agg((F.count("*") == 0).alias("none"))
    return exact.select("id").unionByName(base.crossJoin(F.broadcast(none)).where("none").select("id"))


@query(f"SELECT module_id, string_agg(DISTINCT regexp_replace(file, '/[^/]*$', '') || '/**', ',') AS paths FROM {A.FUNCTIONS} GROUP BY module_id")
def parent_dir_globs(spark, sf):
    return R.folder_globs(A.functions(spark, sf), "module_id", "file").select("module_id", F.array_join("paths", ",").alias("paths"))


@query(f"SELECT file, count(*) AS n FROM (SELECT a.file FROM {A.CALLS} e JOIN {A.FUNCTIONS} a ON a.id = e.src UNION ALL SELECT b.file FROM {A.CALLS} e JOIN {A.FUNCTIONS} b ON b.id = e.dst) GROUP BY file ORDER BY n DESC, file LIMIT 25")
def file_connectivity(spark, sf):
    return graph.file_connectivity(A.part_calls(spark, sf), A.functions(spark, sf))


@query(f"SELECT m.module_id, coalesce(n, 0) AS dependants, coalesce(deps, '') AS depends_on FROM (SELECT DISTINCT module_id FROM {A.NODES}) m LEFT JOIN (SELECT to_module, count(DISTINCT from_module) AS n FROM {A.MODED} WHERE from_module <> to_module GROUP BY to_module) a ON a.to_module = m.module_id LEFT JOIN (SELECT from_module, string_agg(DISTINCT to_module, ',' ORDER BY to_module) AS deps FROM {A.MODED} WHERE from_module <> to_module GROUP BY from_module) b ON b.from_module = m.module_id")
def module_dependencies(spark, sf):
    x = graph.module_dependencies(A.moded(spark, sf))
    n = x.groupBy(F.col("to_module").alias("module_id")).agg(F.count("*").alias("dependants"))
    d = x.groupBy(F.col("from_module").alias("module_id")).agg(F.array_join(F.array_sort(F.collect_list("to_module")), ",").alias("depends_on"))
    return A.nodes(spark, sf).select("module_id").distinct().join(n, "module_id", "left").join(d, "module_id", "left").fillna(0, ["dependants"]).fillna("", ["depends_on"])


@query(f"SELECT user_id, path, min(r) AS first_row, count(*) AS length FROM (SELECT *, r - row_number() OVER (PARTITION BY user_id, path ORDER BY seq) AS i FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS r FROM {A.CHANGES})) GROUP BY user_id, path, i HAVING count(*) >= 3")
def collapse_chains(spark, sf):
    return R.islands(A.changes(spark, sf), ["user_id"], F.col("seq"), "path")


@query(f"SELECT module_id AS base, string_agg(DISTINCT file, ',' ORDER BY file) AS files, round(avg(c), 6) AS confidence FROM (SELECT file, module_id, avg(CASE WHEN is_exported THEN 1.0 ELSE 0.0 END)::DOUBLE AS c FROM {A.FUNCTIONS} GROUP BY file, module_id) GROUP BY module_id")
def merge_siblings(spark, sf):
    c = A.functions(spark, sf).groupBy("file", "module_id").agg(F.avg(F.col("is_exported").cast("double")).alias("confidence"))
    return R.merge_siblings(c.select(F.col("module_id").alias("base"), F.array("file").alias("files"), "confidence"))


@query(f"""WITH f AS {A.FUNCTIONS}, n AS (SELECT count(*) AS total, count(*) FILTER (contains(name, 'ring')) AS a, count(*) FILTER (contains(name, 'widget')) AS b FROM f)
SELECT id, name, round(least(1.0, s)::DOUBLE, 6) AS score FROM (SELECT id, name, (CASE WHEN contains('polish ring widget', name) AND length(name) > 3 THEN 0.9 ELSE 0 END)
 + (CASE WHEN contains(name, 'ring') THEN 0.15 * pa ELSE 0 END) + (CASE WHEN contains(lower(file), 'ring') THEN 0.075 * pa ELSE 0 END) + (CASE WHEN contains(name, 'widget') THEN 0.3 * pb ELSE 0 END) + (CASE WHEN contains(lower(file), 'widget') THEN 0.15 * pb ELSE 0 END)
 + CASE WHEN ca AND cb THEN 0.4 WHEN ca THEN 0.2 * pa WHEN cb THEN 0.2 * pb ELSE 0 END AS s FROM (SELECT f.*, CASE WHEN a > total * 0.4 THEN 0.3 ELSE 1.0 END AS pa, CASE WHEN b > total * 0.4 THEN 0.3 ELSE 1.0 END AS pb, len(list_filter({_WORDS}, lambda w: starts_with(w, 'ring') OR starts_with('ring', w))) > 0 AS ca, len(list_filter({_WORDS}, lambda w: starts_with(w, 'widget') OR starts_with('widget', w))) > 0 AS cb FROM f, n)) WHERE s > 0.3""")
def damped_match(spark, sf):
    return search.damped_score(A.functions(spark, sf), "polish ring widget", ["ring", "widget"])


@query("SELECT p_partkey, replace(replace(replace(replace(n, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS xml, regexp_replace(n, '[^a-zA-Z0-9_]', '_', 'g') AS ident, trim(regexp_replace(n, '\\s+', ' ', 'g')) AS line FROM (SELECT p_partkey, '<' || p_name || '  & \"' || p_brand || '\">' AS n FROM part)")
def text_helpers(spark, sf):
    n = F.concat(F.lit("<"), "p_name", F.lit('  & "'), "p_brand", F.lit('">'))
    return A.table(spark, sf, "part").select("p_partkey", S.xml_escape(n).alias("xml"), S.identifier(n).alias("ident"), S.one_line(n).alias("line"))


@query(f"SELECT id, array_to_string(list_slice(list_filter(string_split(regexp_replace(file, '/[^/]*$', ''), '/'), lambda x: x <> 'src' AND x <> ''), 1, 3), '-') AS cluster, 'fn' AS kind, file AS key_file, name AS key_name FROM {A.FUNCTIONS}")
def path_and_key_parts(spark, sf):
    f = A.functions(spark, sf)
    key = S.entity_key(F.concat(F.lit("fn:"), "file", F.lit(":"), "name"))
    return f.select("id", S.dir_segments(F.col("file")).alias("cluster"), key["kind"].alias("kind"), key["file"].alias("key_file"), key["name"].alias("key_name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN 'high' ELSE 'low' END AS band FROM events")
def json_props(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return A.table(spark, sf, "events").select("event_id", k.alias("k"), F.when(k > 50, "high").otherwise("low").alias("band"))


@query(f"SELECT path, ts > TIMESTAMP '2024-01-15 00:00:00' AS stale FROM (SELECT path, max(ts) AS ts FROM {A.CHANGES} GROUP BY path) ORDER BY path LIMIT 5")
def staleness_sample(spark, sf):
    t = A.changes(spark, sf).groupBy("path").agg(F.max("ts").alias("ts"))
    return t.select("path", (F.col("ts") > F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))).alias("stale")).orderBy("path").limit(5)


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, max(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END) = 1 AS has_promo FROM part GROUP BY p_brand")
def array_helpers(spark, sf):
    t = A.table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t"))
    return t.select("p_brand", F.array_join("t", ",").alias("types"), F.exists("t", lambda x: x == "PROMO").alias("has_promo"))


@query(f"SELECT module_id, count(*) AS total, string_agg(path, ',' ORDER BY path) AS first_files FROM (SELECT module_id, path, row_number() OVER (PARTITION BY module_id ORDER BY path) AS n FROM {A.FILES}) WHERE n <= 3 GROUP BY module_id")
def module_files(spark, sf):
    return R.top_in(A.files(spark, sf), ["module_id"], [F.col("path")], 3).groupBy("module_id").agg(F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("first_files"))


@query(f"SELECT m.module_id AS module_id, c.ord FROM (SELECT DISTINCT module_id FROM {A.FUNCTIONS}) m JOIN (VALUES (0, 'Economy parts stay cheap'), (1, 'No promo in large'), (2, 'other')) AS c(ord, raw) ON contains(lower(c.raw), lower(m.module_id))")
def module_constraints(spark, sf):
    return context.constraints_of(A.functions(spark, sf), A.small(spark, ["Economy parts stay cheap", "No promo in large", "other"], "raw"))


@query(f"SELECT g AS glob_module, count(*) AS files, sha256(string_agg(h, '' ORDER BY h)) AS hash FROM (SELECT DISTINCT file, sha256(file) AS h FROM {A.FUNCTIONS}) f JOIN (VALUES ('cheap', '^src/economy/.*$'), ('cheap', '^src/small/[^/]*\\.ts$'), ('brand1', '^src/(?:.+/)?Brand1[^/]*\\.ts$'), ('large', '^src/large/.*$')) AS m(g, r) ON regexp_matches(f.file, m.r) GROUP BY g")
def modules_by_glob(spark, sf):
    globs = spark.createDataFrame([(m, S.glob_regex(g)) for m, gs in _MODULES for g in gs], "glob_module string, r string")
    f = A.functions(spark, sf).select("file").distinct().withColumn("hash", F.sha2("file", 256))
    hit = f.join(F.broadcast(globs), F.rlike("file", F.col("r"))).select(F.col("glob_module").alias("module_id"), "hash")
    n = hit.groupBy("module_id").agg(F.count("*").alias("files"))
    return R.merkle(hit).join(n, "module_id").select(F.col("module_id").alias("glob_module"), "files", "hash")


@query(f"SELECT a.file, count(DISTINCT b.file) AS imports, string_agg(DISTINCT b.file, ',' ORDER BY b.file) AS targets FROM {A.CALLS} e JOIN {A.FUNCTIONS} a ON a.id = e.src JOIN {A.FUNCTIONS} b ON b.id = e.dst WHERE a.file <> b.file GROUP BY a.file")
def file_imports(spark, sf):
    f, e = A.functions(spark, sf).select("id", "file"), A.part_calls(spark, sf)
    x = e.join(f.select(F.col("id").alias("src"), "file"), "src").join(f.select(F.col("id").alias("dst"), F.col("file").alias("target")), "dst").where("file <> target").select("file", "target").distinct()
    return x.groupBy("file").agg(F.count("*").alias("imports"), F.array_join(F.array_sort(F.collect_list("target")), ",").alias("targets"))


@query(f"SELECT e.src AS id, string_agg(f.name, ',' ORDER BY f.name, f.id) AS callees FROM {A.CALLS} e JOIN {A.FUNCTIONS} f ON f.id = e.dst GROUP BY e.src")
def callee_names(spark, sf):
    n = A.functions(spark, sf).select(F.col("id").alias("dst"), "name")
    return A.part_calls(spark, sf).join(n, "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "dst"))), lambda x: x["name"]), ",").alias("callees"))


@query(f"SELECT from_module, to_module, count(DISTINCT a.name || '>' || b.name) AS name_pairs FROM {A.PMODED} e JOIN {A.FUNCTIONS} a ON a.id = e.src JOIN {A.FUNCTIONS} b ON b.id = e.dst WHERE from_module <> to_module GROUP BY ALL")
def distinct_name_pairs(spark, sf):
    return graph.name_pairs(A.part_moded(spark, sf), A.functions(spark, sf))


_PURPOSES = f"(SELECT *, CASE WHEN size % 2 = 0 THEN name || ' does it. Really.' ELSE '' END AS purpose FROM {A.FUNCTIONS})"


@query(f"""SELECT module_id, string_agg(short, '; ' ORDER BY rank) AS description FROM (SELECT module_id, short, row_number() OVER (PARTITION BY module_id ORDER BY id) AS rank FROM (SELECT module_id, purpose, min(id) AS id, trim(string_split(purpose, '.')[1]) AS short FROM {_PURPOSES} WHERE purpose <> '' GROUP BY module_id, purpose)) WHERE rank <= 3 GROUP BY module_id""")
def module_descriptions(spark, sf):
    f = A.functions(spark, sf).withColumn("purpose", F.when(F.col("size") % 2 == 0, F.concat("name", F.lit(" does it. Really."))).otherwise(""))
    return context.describe_modules(f)


@query(f"SELECT id FROM {A.FUNCTIONS} WHERE contains(name, 'ring') OR contains(lower(file), 'ring')")
def context_seeds(spark, sf):
    f = A.functions(spark, sf)
    mods = f.select(F.col("module_id").alias("id"), F.col("module_id").alias("name")).distinct()
    return context.seeds(f, mods, "polish the ring", ["polish", "ring"])


@query(f"SELECT f.id, f.name AS entry, f.module_id, coalesce(c.calls, '') AS calls FROM {A.FUNCTIONS} f LEFT JOIN (SELECT e.src, string_agg(DISTINCT g.name, ',' ORDER BY g.name) AS calls FROM {A.CALLS} e JOIN {A.FUNCTIONS} g ON g.id = e.dst GROUP BY e.src) c ON c.src = f.id WHERE f.id NOT IN (SELECT dst FROM {A.CALLS})")
def entry_flow(spark, sf):
    return context.entry_flow(A.functions(spark, sf), A.part_calls(spark, sf)).withColumn("calls", F.array_join("calls", ","))


@query(f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS k, CAST(ceil((length(name) + 1 + length(file) + greatest(size, 0) * CASE WHEN size > 15 THEN 20 ELSE 40 END) / 4.0) AS BIGINT) AS tokens FROM ({_SCORES.format('ring')}) JOIN {A.FUNCTIONS} USING (id) WHERE score > 0),
g(k, id, used, kept, taken) AS (SELECT 0::BIGINT, '', 0::BIGINT, 0::BIGINT, false UNION ALL SELECT s.k, s.id, CASE WHEN g.kept < 80 AND g.used + s.tokens <= 6000 THEN g.used + s.tokens ELSE g.used END, CASE WHEN g.kept < 80 AND g.used + s.tokens <= 6000 THEN g.kept + 1 ELSE g.kept END, g.kept < 80 AND g.used + s.tokens <= 6000 FROM g JOIN s ON s.k = g.k + 1)
SELECT id, kept AS place FROM g WHERE taken""")
def context_pack(spark, sf):
    return context.pack(context_scores(spark, sf).join(A.functions(spark, sf), "id"))


@query(f"""WITH p AS (SELECT DISTINCT module_id AS grp, regexp_replace(file, '/[^/]*$', '') || '/' || substr(name, 1, 1) AS path FROM {A.FUNCTIONS}), d AS (SELECT grp, array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS prefix, n FROM p, (VALUES (1), (2), (3)) AS k(n) WHERE n <= len(string_split(path, '/'))),
h AS (SELECT d.grp, prefix, n, count(*) AS hits FROM d GROUP BY ALL) SELECT h.grp AS "group", arg_max(prefix, (n, prefix)) AS prefix FROM h JOIN (SELECT grp, count(*) AS total FROM p GROUP BY grp) t ON t.grp = h.grp WHERE hits >= ceil(total * 0.6) GROUP BY h.grp""")
def path_prefixes(spark, sf):
    p = A.functions(spark, sf).select(F.col("module_id").alias("group"), F.concat(F.regexp_replace("file", "/[^/]*$", ""), F.lit("/"), F.substring("name", 1, 1)).alias("path")).distinct()
    return context.collapse_paths(p)


@query(_HIT + "SELECT id, 'impacted' AS kind FROM risk UNION ALL SELECT 's:1', 'changed'")
def changed_and_impacted(spark, sf):
    seen = graph.bfs(A.edges(spark, sf), _changed(spark))
    return seen.select("id", F.when(F.col("depth") == 0, "changed").otherwise("impacted").alias("kind"))


@query(f"SELECT module_id, count(*) AS selected FROM {A.FUNCTIONS} WHERE contains(name, 'ring') GROUP BY module_id ORDER BY selected DESC, module_id LIMIT 3")
def modules_by_selection(spark, sf):
    return context.modules_by_selection(A.functions(spark, sf).where("contains(name, 'ring')"), 3)


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, left(sha256(array_slice(encode(text), 1, 8192)), 16) AS quick FROM documents WHERE text IS NOT NULL")
def quick_hash(spark, sf):
    d = A.table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), S.quick_hash(F.col("text")).alias("quick"))


@query(f"SELECT kind, count(*) AS n FROM {_VIOLATIONS} GROUP BY kind")
def violations_by_kind(spark, sf):
    return boundary_violations(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'graph LR' || chr(10) || string_agg('    ' || from_module || ' ' || CASE WHEN calls > 10 THEN '==>' WHEN calls > 3 THEN '-->' ELSE '-.->' END || '|' || calls || '| ' || to_module, chr(10) ORDER BY from_module, to_module) AS report FROM (SELECT from_module, to_module, count(*) AS calls FROM " + A.MODED + " WHERE from_module <> to_module GROUP BY ALL)")
def module_diagram(spark, sf):
    return reports.module_diagram(cross_module_calls(spark, sf))


#: Queries of the returned lines' calls that are also registered over the calls of all lines, as <name>_all.
OVER_ALL_LINES = """dead_nodes dead_by_module dead_top_per_module entry_points called_by_exported_in_file fan_in_out_topk adjacency_lists snapshot_functions coupling_scores cluster_confidence reachable_cycles important_functions
context_scores call_resolution find_usages file_connectivity file_imports callee_names distinct_name_pairs entry_flow context_pack""".split()


def _all(name: str) -> None:
    def run(spark, sf):
        with A.all_lines():
            return _QUERIES[name](spark, sf)

    run.__name__ = f"{name}_all"
    # the recursive SQL holds every pair that a path joins; tests hold that query against brute force
    query("" if name == "reachable_cycles" else A.over_all_lines(_SQL.get(name, "")))(run)


for _name in OVER_ALL_LINES:
    _all(_name)
