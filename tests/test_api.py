"""The tools over a small project, and what manifests tell."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.api import NotFound, Project
from loomgraph.functions import scalars as S
from loomgraph.operators import context
from loomgraph.plans import adapters
from loomgraph.sources import projects, snapshot


@pytest.fixture(scope="module")
def project(spark):
    fns = spark.createDataFrame(
        [("fn:src/auth.ts:login", "login", "src/auth.ts", "auth", True, 7), ("fn:src/auth.ts:hashPassword", "hashPassword", "src/auth.ts", "auth", False, 3), ("fn:src/auth.ts:generateToken", "generateToken", "src/auth.ts", "auth", False, 3), ("fn:src/api.ts:route", "route", "src/api.ts", "api", False, 9), ("fn:src/api.ts:old", "old", "src/api.ts", "api", False, 9)],
        "id string, name string, file string, module_id string, is_exported boolean, size long")
    p = "fn:src/auth.ts:"
    calls = spark.createDataFrame([(p + "login", p + "hashPassword"), (p + "login", p + "generateToken"), ("fn:src/api.ts:route", p + "login")], "src string, dst string")
    mods = spark.createDataFrame([("auth", "auth", ["a"]), ("api", "api", []), ("none", "none", [])], "id string, name string, owners array<string>")
    raw = adapters.small(spark, ["module:api cannot import module:auth"], "raw")
    rules = raw.select("ord", S.rule_kind(F.col("raw")).alias("kind"), S.rule_from(F.col("raw")).alias("from_module"), S.rule_to(F.col("raw")).alias("to_modules"))
    files = spark.createDataFrame([("src/auth.ts", "1" * 64, "auth"), ("src/api.ts", "2" * 64, "api")], "path string, hash string, module_id string")
    dec = spark.createDataFrame([("d1", "t", "r", "x")], "id string, title string, reason string, date string")
    vec = spark.createDataFrame([("fn:src/api.ts:old", [1.0, 0.0]), (p + "login", [0.6, 0.8]), ("gone", [0.9, 0.1])], "id string, embedding array<float>")
    return Project(fns, calls, mods, rules, files, None, dec, vec)


def test_tools(spark, project):
    assert {r["module_id"]: r["functions"] for r in project.overview().collect()} == {"auth": 3, "api": 2, "none": 0}
    assert [(r["id"], r["risk"]) for r in project.impact("auth.ts").collect()] == [("fn:src/api.ts:route", "critical")]
    with pytest.raises(NotFound):
        project.impact("nope.ts")
    with pytest.raises(NotFound):
        project.module("nope")
    r = project.before_edit("src/api.ts").first()
    assert (r["impacted"], r["exported_at_risk"], r["violations"], r["reaches_cycle"]) == (0, 0, 1, False)
    login = project.module("auth").where("name = 'login'").first()
    assert login["calls"] == ["generateToken", "hashPassword"] and login["called_by"] == ["route"]
    assert [r["name"] for r in project.usages("login").collect()] == ["route"]
    assert {r["name"] for r in project.dead().collect()} == {"route", "old"}
    assert [r["name"] for r in project.did_you_mean("logins").collect()] == ["login"]
    assert project.search("TOKEN").count() == 1 and project.function("login").count() == 1
    q = spark.createDataFrame([([1.0, 0.0],)], "embedding array<float>")
    assert [r["name"] for r in project.semantic_search(q, 2).collect()] == ["old"]
    assert project.semantic_search(q, 0).count() == 0
    disk = spark.createDataFrame([("src/auth.ts", "9" * 64), ("src/new.ts", "3" * 64)], "path string, hash string")
    assert {r["path"]: r["status"] for r in project.changes(disk).collect()} == {"src/auth.ts": "modified", "src/new.ts": "added", "src/api.ts": "deleted"}
    assert project.session(disk).first()["module_id"] == "auth"
    probes = {r["probe"]: r["passed"] for r in project.probes(disk).collect()}
    assert probes["has functions"] and not probes["is current"] and not probes["keeps its rules"]
    assert project.stats().first()["functions"] == 5 and project.health().count() == 2
    assert project.diagram().first()[0].startswith("graph LR") and project.diagram("health").first()[0].startswith("graph TD")
    assert project.decide("add", ("d2", "", "", "")).count() == 2
    with pytest.raises(snapshot.ContractError):
        project.decide("remove", "zz")


def test_context(spark, project):
    got = [r["name"] for r in project.context("explain login").collect()]
    assert got[0] == "login" and set(got) == {"login", "route", "hashPassword", "generateToken", "old"}
    assert len(project.context("explain login", budget=40).collect()) < 5
    names = lambda **k: {r["id"].split(":")[-1] for r in context.seeds(project.functions, project.modules, **k).collect()}
    assert names(task="x", words=[], files=["src/api.ts"]) == {"route", "old"}
    assert names(task="x", words=["hashpassword"], focus=["api"]) == {"route", "old"}
    assert names(task="x", words=["hashpassword"]) == {"hashPassword"}
    assert names(task="about the API module", words=["zzz"]) == {"route", "old"}
    assert names(task="nothing", words=["zzz"]) == set()
    flow = {r["entry"]: r["calls"] for r in context.entry_flow(project.functions, project.calls).collect()}
    assert flow == {"route": ["login"], "old": []}


def test_preflight(spark, project):
    rules = spark.createDataFrame([("All auth must use sso",)], "raw string")
    assert project.preflight("fix hashPassword", rules).first()["approved"]


def test_descriptions_and_paths(spark, project):
    f = project.functions.withColumn("purpose", F.when(F.col("module_id") == "auth", F.concat("name", F.lit(" does it. Really."))).otherwise(""))
    got = {r["module_id"]: r["description"] for r in context.describe_modules(f).collect()}
    assert got == {"auth": "generateToken does it; hashPassword does it; login does it", "api": "primarily old, route operations across 1 files"}
    p = spark.createDataFrame([("g", "src/a/x/**"), ("g", "src/a/y/**"), ("g", "src/b/**"), ("h", "q")], "group string, path string")
    assert {r["group"]: r["prefix"] for r in context.collapse_paths(p).collect()} == {"g": "src/a", "h": "q"}


def test_manifests(spark):
    lang = lambda *ps: projects.language(spark.createDataFrame([(p,) for p in ps], "path string")).first()[0]
    assert [lang("package.json", "tsconfig.base.json"), lang("go.mod", "package.json"), lang("x.csproj"), lang("sub/go.mod")] == ["typescript", "go", "csharp", "unknown"]
    conf = {"a/tsconfig.json": '{ // c\n "extends": "../base", "compilerOptions": {"paths": {"@/*": ["src/*"],}} }', "base.json": json.dumps({"extends": "./a/tsconfig.json", "compilerOptions": {"paths": {"@/*": ["old/*"], "~/*": ["lib/*"]}}})}
    assert projects.aliases("a/tsconfig.json", conf.get) == {"@/*": ["src/*"], "~/*": ["lib/*"]}
    assert projects.aliases("a/tsconfig.json", conf.get, extends=False) == {"@/*": ["src/*"]} and projects.aliases("none", conf.get) == {}
    assert projects.go_module("// x\nmodule github.com/a/b\n") == "github.com/a/b"
    deps = spark.createDataFrame([(d,) for d in ("express", "next", "react", "pg", "zod", "left-pad")], "name string")
    assert [r["technology"] for r in projects.technologies(deps).orderBy("ord").collect()] == ["Next.js", "React", "SQL client", "Zod validation"]
    scripts = spark.createDataFrame([("test", "bun test"), ("dev", "vite"), ("odd", "x")], "name string, script string")
    assert [r["command"] for r in projects.commands(scripts).orderBy("ord").collect()] == ["bun run dev", "bun run test"]
    assert "node_modules/" in projects.ignore_file("typescript", ["packages/*"]) and "packages/*/tests/" in projects.ignore_file("typescript", ["packages/*"])
