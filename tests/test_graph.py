"""Graph operators on the fixtures of small call graphs."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graph
from loomgraph.operators import relational as R
from loomgraph.plans import adapters


def chain(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, modules):
    return spark.createDataFrame(list(modules.items()), "id string, module_id string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def risks(spark, pairs, modules, changed):
    got = graph.impact(chain(spark, pairs), nodes(spark, modules), ids(spark, changed))
    return {r["id"]: (r["risk"], r["depth"]) for r in got.collect()}


def test_impact_of_a_chain(spark):
    got = risks(spark, [("A", "B"), ("B", "C"), ("C", "D")], {"A": "m1", "B": "m1", "C": "m2", "D": "m3"}, "D")
    assert got == {"C": ("critical", 1), "B": ("medium", 2), "A": ("low", 3)}


def test_impact_within_a_module(spark):
    assert risks(spark, [("E", "F"), ("F", "G")], dict.fromkeys("EFG", "m4"), "G") == {"F": ("high", 1), "E": ("medium", 2)}


def test_bfs_ends_on_cycles_and_bounds(spark):
    e = chain(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")])
    assert {(r["id"], r["depth"]) for r in graph.bfs(e, ids(spark, "a")).collect()} == {("a", 0), ("c", 1), ("d", 1), ("b", 2)}
    assert {r["id"] for r in graph.bfs(e, ids(spark, "d"), most=1, undirected=True).collect()} == {"d", "a"}
    assert graph.bfs(e.limit(0), ids(spark, "x")).count() == 1


def test_cycles(spark):
    e = chain(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", "f")])
    assert {r["id"] for r in graph.on_cycles(e).collect()} == {"a", "b", "c"}
    assert graph.on_cycles(e.limit(0)).count() == 0


def test_dead_code(spark):
    f = spark.createDataFrame([("A", "A", False), ("B", "B", False), ("C", "C", False), ("D", "D", True), ("m", "main", False), ("l", "loginHandler", False), ("u", "useAuth", False), ("k", "K.constructor", False), ("t", "it", False)], "id string, name string, is_exported boolean").withColumn("file", F.lit("src/x.ts")).withColumn("module_id", F.lit("m"))
    got = graph.dead(f, chain(spark, [("A", "B")]))
    assert {r["id"] for r in got.collect()} == {"A", "C"}
    assert graph.dead(f, chain(spark, [("A", "B")]), spark.createDataFrame([("C",)], "handler string")).count() == 1
    r = graph.dead_by_module(f, got).first()
    assert (r["dead"], r["total"], r["percent"]) == (2, 9, 22.2)


def test_rules(spark):
    m = spark.createDataFrame([("a", "b", "api", "db"), ("a", "c", "api", "auth"), ("d", "e", "core", "api"), ("f", "g", "web", "core"), ("f", "h", "web", "db")], "src string, dst string, from_module string, to_module string")
    from loomgraph.functions import scalars as S

    raw = ["module:api cannot import module:db", "module:api cannot import module:db, module:x", "module:core has no imports", "module:web can only import module:core, module:utils", "anything else"]
    r = adapters.small(spark, raw, "raw").select("ord", S.rule_kind(F.col("raw")).alias("kind"), S.rule_from(F.col("raw")).alias("from_module"), S.rule_to(F.col("raw")).alias("to_modules"))
    got = {(x["from_module"], x["to_module"]): (x["kind"], x["rule"]) for x in graph.violations(m, r).collect()}
    assert got == {("api", "db"): ("deny", 0), ("core", "api"): ("isolated", 2), ("web", "db"): ("allow_only", 3)}


def test_trace():
    assert graph.trace({"a": ["b", "c"], "b": ["c"]}, "a") == [("call", "a", "b"), ("call", "b", "c"), ("return", "c", "b"), ("return", "b", "a"), ("call", "a", "c"), ("return", "c", "a")]


def test_long_chains_and_rings(spark):
    """Nodes that reach a cycle, against peeling by hand, with chains that would take a round a link."""
    import random

    r = random.Random(5)
    e = {(f"c{i}", f"c{i + 1}") for i in range(300)} | {(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)} | {(f"t{i}", f"t{i + 1}") for i in range(90)} | {("t90", "r3"), ("x", "x")}
    e |= {(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(70)}
    core = set(e)
    while (left := {x for x in core if x[1] in {a for a, _ in core}}) != core:
        core = left
    assert {x["id"] for x in graph.on_cycles(chain(spark, sorted(e))).collect()} == {a for a, _ in core}


def test_one_cycle_of_a_function(spark):
    e = chain(spark, [("s", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("z", "z")])
    assert graph.cycle_of(e, "s") == ["a", "b", "c", "a"]
    assert graph.cycle_of(e, "z") == ["z", "z"] and graph.cycle_of(e, "d") is None


def test_dead_classes_and_reasons(spark):
    c = spark.createDataFrame([("K", "K", "a", False), ("L", "L", "a", True), ("M", "M", "a", False)], "id string, name string, file string, is_exported boolean").withColumn("module_id", F.lit("m"))
    edges = spark.createDataFrame([("x", "M", "imports"), ("a", "K", "contains")], "src string, dst string, type string")
    assert [r["id"] for r in graph.dead_classes(c, edges).collect()] == ["K"]
    f = spark.createDataFrame([("A", "A", "a.ts", True), ("B", "B", "a.ts", False), ("C", "C", "b.ts", False)], "id string, name string, file string, is_exported boolean").withColumn("module_id", F.lit("m"))
    noted = chain(spark, [("A", "B"), ("A", "C"), ("gone", "C")])
    got = graph.dead(f, noted.limit(0), None, noted).collect()
    assert [(r["id"], r["reason"]) for r in got] == [("C", "2 references exist but none resolved to active call edges")]


def test_confidence_counts_outgoing_edges_only(spark):
    m = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("c", "a"), ("c", "a")], "from_module string, to_module string")
    n = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "module_id string")
    assert {r["module_id"]: r["confidence"] for r in graph.cluster_confidence(m, n).collect()} == {"a": 0.5, "b": 0.0, "c": 0.0, "d": 0.5}


def test_important_functions_of_small_and_large_modules(spark):
    f = spark.createDataFrame([(f"s{i}", "small", False) for i in range(5)] + [(f"l{i:02}", "large", i == 3) for i in range(50)], "id string, module_id string, is_exported boolean")
    e = [(f"l{i:02}", f"l{(i + 1) % 50:02}", "large", "large") for i in range(50)] + [("s0", "s1", "small", "small")]
    got = graph.important(f, spark.createDataFrame(e, "src string, dst string, from_module string, to_module string"))
    assert {r["module_id"]: r["n"] for r in got.groupBy("module_id").agg(F.count("*").alias("n")).collect()} == {"small": 5, "large": 40}


def test_merkle_does_not_depend_on_order(spark):
    rows = [("m", "h2"), ("m", "h1"), ("n", "x")]
    a = R.merkle_root(R.merkle(spark.createDataFrame(rows, "module_id string, hash string"))).first()[0]
    assert a == R.merkle_root(R.merkle(spark.createDataFrame(rows[::-1], "module_id string, hash string"))).first()[0]
    assert a != R.merkle_root(R.merkle(spark.createDataFrame(rows[:2], "module_id string, hash string"))).first()[0]


def test_call_resolution_by_imported_names(spark):
    """Only names that an import lists go to another file; the last import of a name counts."""
    calls = spark.createDataFrame([("f1", "a.ts", "jwtDecode"), ("f1", "a.ts", "local"), ("f1", "a.ts", "this.helper"), ("f1", "a.ts", "none"), ("f1", "a.ts", "f1name"), ("f1", "a.ts", "bar"), ("f1", "a.ts", "lib.twice"), ("f1", "a.ts", "lost")], "src string, file string, name string")
    imported = spark.createDataFrame([("a.ts", "jwtDecode", "b.ts", 0), ("a.ts", "twice", "b.ts", 1), ("a.ts", "twice", "c.ts", 2), ("a.ts", "lost", "gone.ts", 3)], "file string, name string, target string, ord int")
    fns = spark.createDataFrame([("f1", "f1name", "a.ts"), ("f2", "jwtDecode", "b.ts"), ("f3", "local", "a.ts"), ("f4", "helper", "a.ts"), ("f5", "local", "b.ts"), ("f6", "bar", "a.ts"), ("f7", "bar", "b.ts"), ("f8", "twice", "b.ts"), ("f9", "twice", "c.ts"), ("g1", "lost", "a.ts")], "id string, name string, file string")
    got = {(r["dst"], r["confidence"]) for r in R.resolve_calls(calls, imported, fns).collect()}
    assert got == {("f2", 0.8), ("f3", 1.0), ("f4", 0.5), ("f6", 1.0), ("f9", 0.8), ("g1", 1.0)}


@pytest.mark.parametrize("digits,n", [(64, 3), (16, 2)])
def test_drift(spark, digits, n):
    lock = spark.createDataFrame([("a", "0" * 64), ("b", "1" * 64), ("c", "2" * 64)], "path string, hash string")
    disk = spark.createDataFrame([("a", "0" * 16 + "9" * 48), ("b", "1" * 64), ("d", "3" * 64)], "path string, hash string")
    got = {r["path"]: r["status"] for r in R.drift(disk, lock, digits).collect()}
    assert len(got) == n and got["c"] == "deleted" and got["d"] == "added"


def test_queries_over_the_calls_of_all_lines(spark, sf):
    """The whole graph against brute force from the lines; the filtered one stays as it was."""
    from loomgraph.plans import adapters, catalog

    lines = {(r[0], r[1], r[2]) for r in adapters.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").collect()}
    at = {}
    for o, n, p in lines:
        at.setdefault((o, n), set()).add(p)
    want = {(f"p:{p}", f"p:{q}") for o, n, p in lines for q in at.get((o, n + 1), ())}
    few = adapters.part_calls(spark, sf).count()
    with adapters.all_lines():
        got = {tuple(r) for r in adapters.part_calls(spark, sf).select("src", "dst").collect()}
    assert got == want and few < len(want) / 2 and adapters.part_calls(spark, sf).count() == few
    core = set(want)
    while (left := {e for e in core if e[1] in {a for a, _ in core}}) != core:
        core = left
    run = catalog.queries()
    assert {r["id"] for r in run["reachable_cycles_all"](spark, sf).collect()} == {a for a, _ in core}
    parts = {f"p:{r[0]}" for r in adapters.table(spark, sf, "part").select("p_partkey").collect()}
    assert {r["id"] for r in run["entry_points_all"](spark, sf).collect()} == parts - {b for _, b in want}
