"""Contracts, snapshots and decisions as JSON and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.errors import ContractError, OverwriteDenied, SnapshotError
from loomgraph.operators import relational as R
from loomgraph.storage import cut

CONTRACT = """version string, project struct<name:string,description:string,language:string,framework:string>,
declared struct<modules:array<struct<id:string,name:string,description:string,intent:string,owners:array<string>,paths:array<string>,entryFunctions:array<string>>>,constraints:array<string>,decisions:array<struct<id:string,title:string,reason:string,date:string>>>,
overwrite struct<mode:string,requireConfirmation:boolean,lastOverwrittenBy:string,lastOverwrittenAt:string>"""


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """The contract file, one row; malformed files and missing required fields are errors."""
    df = spark.read.schema(CONTRACT).option("mode", "FAILFAST").json(path, multiLine=True)
    row = df.select("version", "project.name", F.size("declared.modules").alias("n")).first()
    if row is None or row["version"] is None or row["name"] is None or row["n"] is None or row["n"] < 0:
        raise ContractError(f"{path}: version, project.name and declared.modules are required")
    return df.withColumn("overwrite", F.coalesce("overwrite", F.from_json(F.lit('{"mode":"never","requireConfirmation":true}'), "mode string, requireConfirmation boolean, lastOverwrittenBy string, lastOverwrittenAt string")))


def content_hash(rows: DataFrame, key: str | None = None) -> DataFrame:
    """One row (hash): the digest of a contract's JSON, or of the digests of a table's rows in order
    of ``key``."""
    text = F.to_json(F.struct(*rows.columns))
    if key is None:
        return rows.select(F.sha2(text, 256).alias("hash"))
    return R.merkle(rows.select(F.lit("").alias("module_id"), F.sha2(F.concat(F.col(key).cast("string"), F.lit("\n"), text), 256).alias("hash"))).select("hash")


def modules(contract: DataFrame) -> DataFrame:
    return contract.select(F.posexplode("declared.modules").alias("ord", "m")).select("ord", "m.*")


def rules(contract: DataFrame) -> DataFrame:
    return contract.select(F.posexplode("declared.constraints").alias("ord", "raw"))


def decisions(contract: DataFrame) -> DataFrame:
    return contract.select(F.explode("declared.decisions").alias("d")).select("d.*")


def merge_contract(old: DataFrame, new: DataFrame, mode: str = "never") -> DataFrame:
    """The contract to keep: of mode never the old one, of explicit the new one with what it lacks
    taken from the old one; 'ask' is for interactive callers and an error here."""
    if mode == "never":
        return old
    if mode != "explicit":
        raise OverwriteDenied(f"overwrite mode {mode} needs an answer")
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    return new.crossJoin(F.broadcast(o)).select(*[F.coalesce(c, f"o_{c}").alias(c) for c in new.columns])  # one row each


def contract_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(part, id, change) of modules, constraints and decisions between two contracts."""
    out = None
    for part, rows in (("module", lambda c: c.select(F.explode("declared.modules").alias("x")).select("x.id", F.to_json("x").alias("t"))), ("constraint", lambda c: c.select(F.explode("declared.constraints").alias("id")).select("id", F.col("id").alias("t")).distinct()), ("decision", lambda c: c.select(F.explode("declared.decisions").alias("x")).select("x.id", F.to_json("x").alias("t")))):
        a, b = rows(old).toDF("id", "then"), rows(new).toDF("id", "now")
        change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("then") != F.col("now"), "changed")
        one = a.join(b, "id", "full").select(F.lit(part).alias("part"), "id", change.alias("change")).where("change IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out


def write_contract(contract: DataFrame, path: str, log=None, old: DataFrame | None = None) -> None:
    """The contract (one row) as a JSON file in the folder ``path``; what changes against ``old``
    is noted in an audit log (stores.AuditLog)."""
    if log is not None:
        for r in contract_changes(old if old is not None else contract.limit(0), contract).orderBy("part", "id").collect():  # what people declare
            log.append(f"{r['part']} {r['change']}", r["id"])
    contract.coalesce(1).write.mode("overwrite").json(path)


def add_decision(table: DataFrame, row: tuple) -> DataFrame:
    """The decisions with one more; an id that exists is an error."""
    if table.where(F.col("id") == row[0]).limit(1).count():
        raise ContractError(f"decision {row[0]} exists")
    return table.unionByName(table.sparkSession.createDataFrame([row], table.schema))


def update_decision(table: DataFrame, key: str, **values: str) -> DataFrame:
    _must_exist(table, key)
    return table.select(*[F.when(F.col("id") == key, F.lit(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def remove_decision(table: DataFrame, key: str) -> DataFrame:
    _must_exist(table, key)
    return table.where(F.col("id") != key)


def _must_exist(table: DataFrame, key: str) -> None:
    if not table.where(F.col("id") == key).limit(1).count():
        raise ContractError(f"decision {key} not found")


def ranks(ids: DataFrame) -> DataFrame:
    """(id, n): the place of each distinct id in id order, from 0.  Ids are sorted by range; only
    the sizes of the ranges reach the driver."""
    parts = cut(ids.select("id").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ranges")
    sizes = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    at, before = 0, []
    for p in sorted(sizes):
        before.append((p, at))
        at += sizes[p]
    offsets = ids.sparkSession.createDataFrame(before, "part int, before long")
    own = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return parts.withColumn("own", own).join(F.broadcast(offsets), "part").select("id", (F.col("before") + F.col("own") - 1).alias("n"))


def compact(functions: DataFrame) -> DataFrame:
    """Functions (id, …, calls) with calls as numbers of a dictionary of ids, nulls left out.

    The number of an id is its place in id order, see ranks().
    """
    ranked = cut(ranks(functions), "ranks")
    calls = functions.select(F.col("id").alias("src"), F.explode("calls").alias("id")).join(ranked, "id").groupBy("src").agg(F.array_sort(F.collect_list("n")).alias("edges"))
    out = functions.drop("calls").join(ranked, "id").join(calls.withColumnRenamed("src", "id"), "id", "left")
    return out.select("n", F.to_json(F.struct(*[c for c in out.columns if c != "n"]), {"ignoreNullFields": "true"}).alias("entry"))


def write_snapshot(functions: DataFrame, path: str) -> None:
    """Compacted functions as JSON lines."""
    compact(functions).write.mode("overwrite").json(path)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Functions of a written snapshot; malformed lines, entries without an id and numbers that do
    not count up from 0 are errors."""
    rows = spark.read.schema("n long, entry string").option("mode", "FAILFAST").json(path)
    seen = rows.select("n", F.get_json_object("entry", "$.id").alias("id"))
    r = seen.agg(F.count("*").alias("rows"), F.count_distinct("n").alias("numbers"), F.coalesce(F.max("n") + 1, F.lit(0)).alias("top"), F.count("id").alias("ids"), F.count_distinct("id").alias("distinct")).first()
    if len({r["rows"], r["numbers"], r["top"], r["ids"], r["distinct"]}) > 1:
        raise SnapshotError(f"{path}: {r.asDict()}")
    return hydrate(rows, schema)


def hydrate(entries: DataFrame, schema: str) -> DataFrame:
    """The inverse of compact: functions with calls as ids."""
    rows = entries.select("n", F.from_json("entry", schema + ", edges array<long>").alias("e")).select("n", "e.*")
    names = rows.select(F.col("n").alias("k"), F.col("id").alias("callee"))
    calls = rows.select("id", F.explode("edges").alias("k")).join(names, "k").groupBy("id").agg(F.array_sort(F.collect_list("callee")).alias("calls"))
    return rows.drop("n", "edges").join(calls, "id", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))


def fingerprint(functions: DataFrame) -> DataFrame:
    """A digest over all ids in order: equal for equal sets of functions."""
    per = functions.select("id", F.substring(F.sha2("id", 256), 1, 2).alias("bucket")).groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("id")), "|"), 256).alias("h"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))
