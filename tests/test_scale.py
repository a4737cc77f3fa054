"""What keeps a task's share of the work and of the rows bounded, on tables that one task reads."""

import re

from pyspark.sql import functions as F

from loomgraph.operators import graph, relational
from loomgraph.plans import adapters, catalog
from loomgraph.sources import contextfiles, golang, masking, parsing, script


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def one_task(spark, path, text, n=2000):
    return spark.range(n).coalesce(1).select(F.expr(path).alias("path"), F.expr(text).alias("text"))


def test_files_of_one_partition_are_parsed_by_all_cores(spark):
    files = one_task(spark, "'a/p' || id || '.ts'", "'export function f' || id || '() {}'")
    parsed = parsing.parse_files(files)
    assert tasks(parsed) >= spark.sparkContext.defaultParallelism
    names = {r["name"] for r in parsing.child(parsed, "functions").select("name").collect()}
    assert names == {f"f{i}" for i in range(2000)}


def test_sorted_routes_do_not_parse_twice(spark):
    files = one_task(spark, "'app/p' || id || '/route.ts'", "'export function GET() {}'", 20)
    found = parsing.next_routes(parsing.parse_files(files))
    assert "MapInArrow" not in plan(found)
    assert [r["url"] for r in found.collect()] == sorted(f"/p{i}" for i in range(20))


def test_context_files_are_judged_by_all_cores(spark):
    files = one_task(spark, "'src/models/' || id || '.ts'", "CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 50001) ELSE 'x' END")
    found = contextfiles.discover(files)
    assert tasks(found) >= spark.sparkContext.defaultParallelism
    assert found.count() == 1000
    # a large or empty copy of a path does not hide the one that fits
    both = spark.createDataFrame([("src/models/a.ts", "x" * 50001), ("src/models/a.ts", "x"), ("src/models/a.ts", "")], "path string, text string")
    assert [r["size"] for r in contextfiles.discover(both.coalesce(1)).collect()] == [1]


def test_edges_are_not_dealt_by_module_for_rules(spark):
    moded = spark.createDataFrame([("a", "b", "0", "1"), ("a", "b", "0", "1"), ("c", "d", "X", "0"), ("e", "f", "1", "0"), ("g", "h", "0", "0")], "src string, dst string, from_module string, to_module string")
    rules = spark.createDataFrame([(3, "isolated", "0", []), (1, "deny", "0", ["1"]), (2, "allow_only", "x", ["1"]), (4, None, "1", [])], "ord int, kind string, from_module string, to_modules array<string>")
    broken = graph.violations(moded, rules)
    assert "hashpartitioning(lower(" not in plan(broken) and "hashpartitioning(fm" not in plan(broken)
    assert sorted(map(tuple, broken.collect())) == [("a", "b", "0", "1", "deny", 1), ("c", "d", "X", "0", "allow_only", 2)]


def test_depth_of_braces():
    mask = "}a{b{c}d}e{}{"
    depth, d, want = masking.Depth(mask), 0, []
    for c in mask:
        d -= c == "}"
        want.append(d)
        d += c == "{"
    assert [depth[i] for i in range(len(mask))] == want


def test_imports_keep_their_shuffle_partitions(spark):
    imports = one_task(spark, "'a' || id || '.ts'", "'./b' || id", 400).toDF("file", "source")
    files = spark.createDataFrame([("b7.ts",)], "path string")
    found = relational.resolve_imports(imports, files, [], [".ts", ".tsx"])
    assert tasks(found) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.where("target = 'b7.ts'").count() == 1


def test_calls_between_parts_deal_lines_by_order_and_line(spark, tmp_path):
    rows = [(1, 1, 10), (1, 1, 10), (1, 2, 20), (1, 2, 20), (1, 2, 21), (1, 4, 40), (2, 1, 10), (2, 2, 20), (None, 1, 50), (None, 2, 51), (3, 1, None), (3, 2, 60), (4, 1, 70), (4, 2, None)]
    lines = spark.createDataFrame([(o, n, p, "R") for o, n, p in rows] + [(1, 3, 30, "N")], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    calls = adapters.part_calls(spark, str(tmp_path))
    want = {("p:10", "p:20"), ("p:10", "p:21"), (None, "p:60"), ("p:70", None)}
    got = list(map(tuple, calls.collect()))
    assert set(got) == want and len(got) == len(want)
    # lines are shuffled once for each side of the join, and by no other key before it
    keys = [x for x in plan(calls).split("\n") if "hashpartitioning(l_orderkey" in x]
    assert len(keys) == 2 and not any("l_partkey" in x or "next" in x for x in keys)
    parts = spark.createDataFrame([(k, f"n {k}", "T", "B#1", 1) for k in (10, 20, 21, 30, 40, 60, 70)], "p_partkey long, p_name string, p_type string, p_brand string, p_size int")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    few = catalog.queries()["entry_points"](spark, str(tmp_path))
    assert {r["id"] for r in few.collect()} == {"p:10", "p:30", "p:40", "p:70"}
    every = catalog.queries()["entry_points_all"](spark, str(tmp_path))
    assert {r["id"] for r in every.collect()} == {"p:10", "p:70"}
    assert "LeftSemi" in plan(every)


def test_only_the_asked_kinds_are_read(spark, monkeypatch):
    go = "package p\nimport \"fmt\"\nfunc (s *S) Run(a int) { go_on(a) }\nfunc main() { r.GET(\"/a\", h) }\n"
    ts = "import { a } from './m';\nexport function f() {}\nclass K { run() {} }\ntype T = string;\napp.get('/x', h);\n"
    files = spark.createDataFrame([("p/a.go", go), ("a.ts", ts)], "path string, text string")
    every = {r["path"]: r.asDict() for r in parsing.parse_files(files).collect()}
    for kind in parsing.CHILDREN:
        some = parsing.parse_files(files, only=[kind])
        assert some.columns == ["path", "language", "hash", kind]
        assert {r["path"]: r[kind] for r in some.collect()} == {p: r[kind] for p, r in every.items()}
    for module, names in ((script, ["functions", "classes", "generics", "exports", "imports"]), (golang, ["declared", "imports"])):
        for name in names:
            monkeypatch.setattr(module, name, None)  # a call fails
    assert [r["path"] for r in script.parse("a.ts", ts, ["routes"])["routes"]] == ["/x"]
    assert [r["path"] for r in golang.parse("p/a.go", go, ["routes"])["routes"]] == ["/a"]


def test_patterns_of_scripts_are_compiled_once(monkeypatch):
    text = "import { f1 } from '../a/p1';\nimport d from \"lib\";\n/** Does it */\nexport async function f(a: number, b?: T): Promise<T> {\n  if (!a) { return null; }\n  try { f1(a); } catch (e) { throw new Error('x'); }\n}\nexport class K {\n  run(): void {\n    f(1);\n  }\n}\nconst g = (x) => x?.y(1);\ntype T = string;\n"
    want = script.parse("a.ts", text)
    asked = []
    with monkeypatch.context() as m:
        for name in ("finditer", "findall", "match", "fullmatch", "search", "sub"):
            m.setattr(f"re.{name}", lambda *a, _f=getattr(re, name): asked.append(a[0]) or _f(*a))
        assert script.parse("a.ts", text) == want
    assert not asked
    assert [f["calls"] for f in want["functions"]] == [["f1", "Error"], ["x.y"]] and [e["name"] for e in want["exports"]] == ["f", "K"]
    src = masking.Source("a.ts", "a\n\nbc\n")
    assert src.starts == [0, 2, 3, 6] and [src.line(i) for i in range(7)] == [1, 1, 2, 3, 3, 3, 4]
