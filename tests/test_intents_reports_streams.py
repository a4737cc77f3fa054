"""Intents, reports and change streams."""

from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import intents, reports
from loomgraph.streaming import batches


@pytest.fixture(scope="module")
def project(spark):
    fns = spark.createDataFrame([("fn:v", "verifyToken", "src/auth/v.ts", "auth"), ("fn:r", "refreshToken", "src/auth/r.ts", "auth"), ("fn:h", "handleLogin", "src/api/h.ts", "api"), ("fn:u", "validateUserInput", "src/api/u.ts", "api"), ("fn:q", "queryUsers", "src/db/q.ts", "db")], "id string, name string, file string, module_id string")
    mods = spark.createDataFrame([("auth", "auth", ["alice"]), ("api", "api", []), ("db", "db", [])], "id string, name string, owners array<string>")
    rules = spark.createDataFrame([("No direct DB access outside db/",), ("All auth must go through auth.middleware",), ("Controllers cannot import from repositories directly",), ("Never call setTimeout in the payment flow",)], "raw string")
    calls = spark.createDataFrame([("fn:h", "fn:v")], "src string, dst string")
    return fns, mods, rules, calls


def test_interpret(spark, project):
    fns, mods, _, _ = project
    got = intents.interpret("fix verifyToken", fns, mods).orderBy(F.desc("confidence")).collect()
    assert (got[0]["action"], got[0]["name"], got[0]["module_id"]) == ("modify", "verifyToken", "auth")
    assert {r["action"] for r in intents.interpret("add error handling to verifyToken", fns, mods).collect()} == {"modify"}
    r = intents.interpret("create a new `ZapQueue` class", fns, mods).first()
    assert (r["action"], r["type"], r["name"]) == ("create", "class", "ZapQueue")


def test_conflicts_and_preflight(spark, project):
    fns, mods, rules, calls = project
    i = spark.createDataFrame([("move", "function", "verifyToken", "auth", "x", 0.9), ("modify", "function", "noSuch", None, None, 0.5), ("create", "function", "authHandler", "auth", None, 0.5)], "action string, type string, name string, module_id string, file string, confidence double")
    got = {(r["kind"], r["severity"], r["name"]) for r in intents.conflicts(i, rules, fns, mods).collect()}
    assert {("boundary-crossing", "warning", "verifyToken"), ("missing-dependency", "warning", "noSuch"), ("ownership", "warning", "verifyToken"), ("constraint-violation", "warning", "authHandler")} <= got
    # what is outside db/ meets the rule on direct access
    assert {n for k, s, n in got if s == "error"} == {"verifyToken", "authHandler"}
    assert not intents.preflight(i, intents.conflicts(i, rules, fns, mods)).first()["approved"]
    soft = rules.where("raw NOT LIKE 'No direct%'")
    v = intents.preflight(i, intents.conflicts(i, soft, fns, mods)).first()
    assert v["approved"] and v["confidence"] == 0.9 and v["errors"] == 0
    none = intents.preflight(i.limit(0), intents.conflicts(i.limit(0), rules, fns, mods)).first()
    assert not none["approved"]
    s = {r["name"]: (r["affected"], r["new_files"], r["impact"]) for r in intents.suggest(i, fns, calls).collect()}
    assert s == {"verifyToken": (["src/api/h.ts", "x"], [], 2), "noSuch": ([], [], 0), "authHandler": ([], ["src/authHandler.ts"], 1)}
    j = spark.createDataFrame([("modify", "function", "verifyToken", "auth"), ("create", "class", "Zap", "auth")], "action string, type string, name string, module_id string")
    s = {r["name"]: (r["affected"], r["new_files"]) for r in intents.suggest(j, fns, calls, mods.withColumn("paths", F.array(F.lit("src/auth/**")))).collect()}
    assert s == {"verifyToken": (["src/api/h.ts", "src/auth/v.ts"], []), "Zap": ([], ["src/auth/Zap.ts"])}


HITS = [
    ("No direct DB access outside db/", "modify", "q", "db", "", None), ("No direct DB access outside db/", "modify", "q", "api", "", "error"), ("No direct DB access outside db/", "modify", "q", None, "", None),
    ("Controllers cannot import repositories", "delete", "x", "repositories", "", "error"), ("Controllers cannot import repositories", "create", "x", "controllers", "", None),
    ("All auth must go through auth.middleware", "create", "authHandler", "api", "", "warning"), ("All auth must go through auth.middleware", "delete", "authHandler", "api", "", None), ("All auth must use x", "modify", "pay", "billing", "", None),
    ("Never call setTimeout in the payment flow", "modify", "f", "payment", "", "warning"), ("Never call setTimeout in the payment flow", "modify", "f", "api", "", None), ("Do not call eval", "create", "f", None, "", "warning"), ("Do not call eval", "move", "f", None, "", None),
    ("The service layer: views cannot call models", "modify", "f", "views", "", None), ("Exports must be named in camelCase", "create", "Bad_name", "m", "", "warning"), ("Exports must be named in camelCase", "create", "goodName", "m", "", None), ("Exports must be named in camelCase", "modify", "Bad_name", "m", "", None),
    ("Sessions expire after an hour", "modify", "expireSession", "m", "make sessions last", "warning"), ("Sessions expire after an hour", "modify", "other", "m", "sessions", None),
]


def test_each_class_of_constraint(spark):
    df = spark.createDataFrame([h[:5] for h in HITS], "raw string, action string, name string, module string, reason string")
    c = F.col
    got = df.select(intents.constraint_hit(c("raw"), c("name"), c("module"), c("action"), c("reason"))).collect()
    assert [r[0] for r in got] == [h[5] for h in HITS]


def test_intents_on_classes(spark, project):
    fns, mods, _, _ = project
    classes = spark.createDataFrame([("c1", "SessionStore", "src/auth/s.ts", "auth")], "id string, name string, file string, module_id string")
    r = intents.interpret("create a class SessionStore cache", fns, mods, classes=classes).first()
    assert (r["action"], r["type"], r["name"], r["file"]) == ("modify", "class", "SessionStore", "src/auth/s.ts")
    r = intents.interpret("create SessionStore cache", fns, mods, classes=classes).first()
    assert r["action"] == "modify" and r["type"] != "class"


def test_scalars(spark):
    cases = {"verifyToken": ["verify", "Token"], "VerifyToken": ["Verify", "Token"], "verify_token": ["verify", "token"], "validateUserInput": ["validate", "User", "Input"], "": []}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r[0]: r[1] for r in df.select("n", S.words_of(F.col("n"))).collect()} == cases
    k = spark.createDataFrame([("fix the auth token bug",), ("Token Validation",)], "t string").select(S.keywords(F.col("t"))).collect()
    assert [r[0] for r in k] == [["auth", "token"], ["token", "validation"]]
    one = spark.createDataFrame([("  a\n    b\n\n  c", "foo-bar_baz", "class:src/a.ts:K")], "t string, c string, k string")
    r = one.select(S.dedent(F.col("t")), S.camel_case(F.col("c")), S.entity_key(F.col("k")), S.title_case(F.col("c")), S.lines_between(F.col("t"), 2, 2)).first()
    assert list(r) == ["a\n  b\n\nc", "fooBarBaz", ("class", "src/a.ts", "K"), "Foo Bar Baz", "    b"]


def test_reports(spark):
    cross = spark.createDataFrame([("a-b", "c", 20), ("c", "a-b", 2)], "from_module string, to_module string, calls long")
    assert reports.module_diagram(cross).first()[0] == "graph LR\n    a_b ==>|20| c\n    c -.->|2| a_b"
    assert reports.health_diagram(spark.createDataFrame([("m", 0.75), ("n", 0.1)], "module_id string, health double")).first()[0].endswith('n["n 10%"]:::poor')
    assert "| 0 | - | 3 |" in reports.matrix_table(spark.createDataFrame([("0", 0, 3)], "from_module string, to_0 long, to_1 long"), "from_module").first()[0]
    f = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "c")], "module_id string, name string")
    top = f.withColumn("rank", F.lit(1))
    text = reports.module_summary(f, top, top, 1000).first()[0]
    assert text.startswith("## m\nFunctions: 2") and "## n" in text
    assert "## n" not in reports.module_summary(f, top, top, 20).first()[0]


def test_compress_body():
    body = "  // c\n  if (x) {\n    return 1\n  }\n\n  console.log(2)\n  a\n    .b(1)\n    .c(2)\n    .d(3)\n  /* gone\n */\n  end()"
    assert reports.compress_body(body) == "if (x) return 1\na\n  .b(…).c(…).d(…)\nend()"


def rows():
    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    return [("a", "h1", t(0), 1), ("a", "h1", t(1), 2), ("b", "x", t(2), 3), ("a", "h2", t(3), 4), ("a", "h2", t(20), 5), ("b", "y", t(40), 6)]


SCHEMA = "path string, hash string, ts timestamp, seq long"


def test_streams_equal_batches(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("key", F.lit("k"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = batches.unchanged_dropped(stream.drop("key")).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["seq"] for r in spark.table("kept").collect()) == [1, 3, 4, 6]
    q = batches.debounced_stream(stream, "key", "10 seconds", "1 second").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {(r["first_ts"], r["events"]) for r in spark.table("sessions").collect()}
    whole = {(r["first_ts"], r["events"]) for r in batches.debounce(df, "key", "10 seconds").collect()}
    assert closed <= whole and len(whole) == 3 and len(closed) >= 2
    seen = []
    batches.run_batches(stream, lambda b, mode: seen.append((mode, b.count())), str(tmp_path / "c3"), full_above=1).awaitTermination(120)
    assert seen == [("full", 2)]


def test_latest_breaks_ties_by_sequence(spark):
    df = spark.createDataFrame([("a", "1", datetime(2024, 1, 1), 1), ("a", "2", datetime(2024, 1, 1), 2)], SCHEMA)
    assert batches.latest(df).first()["hash"] == "2"
    assert isinstance(batches.latest(df).toPandas(), pd.DataFrame)
