"""The driver's tables as nodes, edges, functions, files, rules and change events.

Each adapter has the SQL of the same rows beside it, for oracle queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, type, module_id): suppliers, orders, customers, nations and regions; the module is the region."""
    t = lambda n: table(spark, sf, n)
    region = F.col("n_regionkey").cast("string").alias("module_id")
    home = t("nation").select("n_nationkey", "n_regionkey")
    c = t("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [
        t("supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).select(_id("s", "s_suppkey").alias("id"), F.lit("supplier").alias("type"), region),
        t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(_id("o", "o_orderkey").alias("id"), F.lit("order").alias("type"), region),
        c.select(_id("c", "c_custkey").alias("id"), F.lit("customer").alias("type"), region),
        t("nation").select(_id("n", "n_nationkey").alias("id"), F.lit("nation").alias("type"), region),
        t("region").select(_id("r", "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_regionkey").cast("string").alias("module_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


NODES = """(SELECT 's:' || s_suppkey AS id, 'supplier' AS type, CAST(n_regionkey AS VARCHAR) AS module_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 'o:' || o_orderkey, 'order', CAST(n_regionkey AS VARCHAR) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'c:' || c_custkey, 'customer', CAST(n_regionkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'n:' || n_nationkey, 'nation', CAST(n_regionkey AS VARCHAR) FROM nation
 UNION ALL SELECT 'r:' || r_regionkey, 'region', CAST(r_regionkey AS VARCHAR) FROM region)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): orders depend on suppliers, customers on orders, nations on customers, regions on nations."""
    t = lambda n: table(spark, sf, n)
    return (
        t("lineitem").select(_id("o", "l_orderkey").alias("src"), _id("s", "l_suppkey").alias("dst")).distinct()
        .unionByName(t("orders").select(_id("c", "o_custkey").alias("src"), _id("o", "o_orderkey").alias("dst")))
        .unionByName(t("customer").select(_id("n", "c_nationkey").alias("src"), _id("c", "c_custkey").alias("dst")))
        .unionByName(t("nation").select(_id("r", "n_regionkey").alias("src"), _id("n", "n_nationkey").alias("dst")))
    )


EDGES = """(SELECT DISTINCT 'o:' || l_orderkey AS src, 's:' || l_suppkey AS dst FROM lineitem
 UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
 UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
 UNION ALL SELECT 'r:' || n_regionkey, 'n:' || n_nationkey FROM nation)"""


_returned: ContextVar[bool] = ContextVar("returned", default=True)


@contextmanager
def all_lines() -> Iterator[None]:
    mark = _returned.set(False)
    try:
        yield
    finally:
        _returned.reset(mark)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return (lines.where("l_returnflag = 'R'") if _returned.get() else lines).select("l_orderkey", "l_linenumber", "l_partkey")


def part_calls(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): a returned part calls the returned part on the next line of the same order;
    within all_lines() any part calls the part on the next line.

    Only the next lines are told apart before the join, where they are dealt as it needs them: so
    copies of a line do not multiply, and pairs are told apart once, by their numbers."""
    lines, at = _lines(spark, sf), ["l_orderkey", "l_linenumber"]
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next")).repartition(*at).distinct()
    return lines.join(after, at).select("l_partkey", "next").distinct().select(_id("p", "l_partkey").alias("src"), _id("p", "next").alias("dst"))


def called_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(id): the distinct dst of part_calls, by a semi-join that makes no pairs."""
    lines, at = _lines(spark, sf), ["l_orderkey", "l_linenumber"]
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), "l_partkey")
    return after.join(lines.select(*at), at, "left_semi").select("l_partkey").distinct().select(_id("p", "l_partkey").alias("id"))


_LINES = "(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R')"
ALL_LINES = "(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem)"
CALLS = f"(SELECT DISTINCT 'p:' || a.l_partkey AS src, 'p:' || b.l_partkey AS dst FROM {_LINES} a JOIN {_LINES} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


def over_all_lines(sql: str) -> str:
    """The SQL of the same query within all_lines()."""
    return sql.replace(_LINES, ALL_LINES)


def functions(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, file, module_id, is_exported, size): parts as functions of a brand's file."""
    p = table(spark, sf, "part")
    name = F.regexp_replace("p_name", " ", "_")
    return p.select(_id("p", "p_partkey").alias("id"), name.alias("name"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".ts")).alias("file"), F.lower("p_type").alias("module_id"), (F.col("p_size") % 7 == 0).alias("is_exported"), F.col("p_size").cast("long").alias("size"))


FUNCTIONS = "(SELECT 'p:' || p_partkey AS id, replace(p_name, ' ', '_') AS name, 'src/' || lower(p_type) || '/' || replace(p_brand, '#', '') || '.ts' AS file, lower(p_type) AS module_id, p_size % 7 = 0 AS is_exported, CAST(p_size AS BIGINT) AS size FROM part)"


def imported(spark: SparkSession, sf: str) -> DataFrame:
    """(file, target): a file imports those of the exported functions that its functions call."""
    f = functions(spark, sf)
    e = part_calls(spark, sf).join(f.select(F.col("id").alias("src"), "file"), "src").join(f.select(F.col("id").alias("dst"), F.col("file").alias("target"), "is_exported"), "dst")
    return e.where("file <> target AND is_exported").select("file", "target").distinct()


IMPORTED = f"(SELECT DISTINCT a.file, b.file AS target FROM {CALLS} e JOIN {FUNCTIONS} a ON a.id = e.src JOIN {FUNCTIONS} b ON b.id = e.dst WHERE a.file <> b.file AND b.is_exported)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, hash, module_id, size): documents as files of their source."""
    d = table(spark, sf, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.sha2("text", 256).alias("hash"), F.col("source").alias("module_id"), F.col("n_chars").alias("size"), "doc_id")


FILES = "(SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, sha256(text) AS hash, source AS module_id, n_chars AS size, doc_id FROM documents)"


def disk(spark: SparkSession, sf: str) -> DataFrame:
    """The files as a later state: the first digit of a file's digest tells whether it was
    modified (0, 1), is gone (f) or also stands under a new path (2)."""
    f, digit = files(spark, sf), F.left("hash", F.lit(1))
    now = f.where(digit != "f").select("path", F.when(digit.isin("0", "1"), F.sha2(F.concat("hash", F.lit("!")), 256)).otherwise(F.col("hash")).alias("hash"))
    return now.unionByName(f.where(digit == "2").select(F.concat("path", F.lit(".new")).alias("path"), "hash"))


DISK = f"(SELECT path, CASE WHEN left(hash, 1) IN ('0', '1') THEN sha256(hash || '!') ELSE hash END AS hash FROM {FILES} WHERE left(hash, 1) <> 'f' UNION ALL SELECT path || '.new', hash FROM {FILES} WHERE left(hash, 1) = '2')"

#: Boundary rules between regions in the rule grammar.
RULES = ["module:0 cannot import module:1", "module:2 is isolated", "module:3 can only import module:3, module:4", "module:0 cannot import module:1, module:2", "Never call setTimeout in the payment flow"]
#: Free-text constraints for classification.
CONSTRAINTS = ["No direct DB access outside db/", "All auth must go through auth.middleware", "Controllers cannot import from repositories directly", "Never call setTimeout in the payment flow", "The service layer owns transactions", "Exports must be named in camelCase", "Keep it simple", "module:a cannot import module:b"]
#: Prompts of intent queries.
PROMPTS = ["fix the small ring widget", "add error handling to red_widget", "remove the old gear", "migrate address book", "refactor the economy module", "create a new class for steel bolts", "show status"]


def small(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), f"ord int, {name} string")


def values_sql(values: list[str], name: str) -> str:
    rows = ", ".join(f"({i}, '{v}')" for i, v in enumerate(values))
    return f"(SELECT * FROM (VALUES {rows}) AS v(ord, {name}))"


def moded(spark: SparkSession, sf: str) -> DataFrame:
    from loomgraph.operators import graph

    return graph.with_modules(edges(spark, sf), nodes(spark, sf))


MODED = f"(SELECT e.src, e.dst, a.module_id AS from_module, b.module_id AS to_module FROM {EDGES} e JOIN {NODES} a ON e.src = a.id JOIN {NODES} b ON e.dst = b.id)"
PMODED = f"(SELECT e.src, e.dst, a.module_id AS from_module, b.module_id AS to_module FROM {CALLS} e JOIN {FUNCTIONS} a ON e.src = a.id JOIN {FUNCTIONS} b ON e.dst = b.id)"


def part_moded(spark: SparkSession, sf: str) -> DataFrame:
    from loomgraph.operators import graph

    return graph.with_modules(part_calls(spark, sf), functions(spark, sf))


def rules(spark: SparkSession) -> DataFrame:
    from loomgraph.functions import scalars as S

    r = small(spark, RULES, "raw")
    return r.select("ord", S.rule_kind(F.col("raw")).alias("kind"), S.rule_from(F.col("raw")).alias("from_module"), S.rule_to(F.col("raw")).alias("to_modules"))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, path, hash, ts, seq): events as file changes."""
    return table(spark, sf, "events").select("user_id", F.col("event_type").alias("path"), F.get_json_object("props", "$.k").alias("hash"), "ts", F.col("event_id").alias("seq"), "value")


CHANGES = "(SELECT user_id, event_type AS path, json_extract_string(props, '$.k') AS hash, ts, event_id AS seq, value FROM events)"
