"""From source texts to graphs, snapshots, clusters, contracts, formats, the watcher and commands."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomgraph import cli
from loomgraph.api import Project, inside
from loomgraph.errors import AccessDenied, NotFound, SnapshotError, SyncError
from loomgraph.functions import scalars as S
from loomgraph.operators import clusters, graph
from loomgraph.sources import build, contextfiles, parsing, snapshot, stores
from loomgraph.streaming import watch


def graph_of(spark, files, **settings):
    tree = spark.createDataFrame(sorted(files.items()), "path string, text string")
    return build.graph_of(parsing.parse_files(tree), **settings)


def edges_of(g, kind):
    return {(r["src"], r["dst"]) for r in g.edges.where(F.col("type") == kind).collect()}


def chain(*pairs):
    """Each name in a file of its own that imports what it calls."""
    names = {n for p in pairs for n in p}
    calls = {n: [b for a, b in pairs if a == n] for n in names}
    return {f"src/{n}.ts": "".join(f'import {{ {c} }} from "./{c}";\n' for c in calls[n]) + f"function {n}() {{\n" + "".join(f"  {c}();\n" for c in calls[n]) + "}\n" for n in names}


def impact(spark, g, changed, modules):
    m = spark.createDataFrame([(f"fn:src/{n}.ts:{n}", v) for n, v in modules.items()], "id string, module_id string")
    ids = spark.createDataFrame([(f"fn:src/{changed}.ts:{changed}",)], "id string")
    return {r["id"].rsplit(":", 1)[-1]: (r["risk"], r["depth"]) for r in graph.impact(g.calls(), m, ids).collect()}


def test_imports_calls_and_containment(spark):
    g = graph_of(spark, {"src/auth.ts": 'import { jwtDecode } from "./utils/jwt";\nexport function verifyToken(t: string) {\n  return jwtDecode(t);\n}\n', "src/utils/jwt.ts": "export function jwtDecode(t: string) {\n  return t;\n}\n"})
    nodes = {r["id"]: r["type"] for r in g.nodes.collect()}
    assert nodes["src/auth.ts"] == "file" and nodes["fn:src/auth.ts:verifyToken"] == "function"
    assert edges_of(g, "imports") == {("src/auth.ts", "src/utils/jwt.ts")}
    assert edges_of(g, "calls") == {("fn:src/auth.ts:verifyToken", "fn:src/utils/jwt.ts:jwtDecode")}
    assert g.edges.where("type = 'calls'").first()["confidence"] == 0.8
    assert edges_of(g, "contains") == {("src/auth.ts", "fn:src/auth.ts:verifyToken"), ("src/utils/jwt.ts", "fn:src/utils/jwt.ts:jwtDecode")}


def test_impact_of_chains(spark):
    g = graph_of(spark, chain(("A", "B"), ("B", "C"), ("C", "D")))
    assert impact(spark, g, "C", dict.fromkeys("ABCD", "m")).keys() == {"A", "B"}
    assert impact(spark, g, "D", {"A": "m1", "B": "m1", "C": "m2", "D": "m3"}) == {"C": ("critical", 1), "B": ("medium", 2), "A": ("low", 3)}
    assert impact(spark, g, "D", dict.fromkeys("ABCD", "m4"))["C"] == ("high", 1)
    hit = graph.impact(g.calls(), g.nodes.withColumn("module_id", F.lit("m")), spark.createDataFrame([("fn:src/B.ts:B",)], "id string"))
    assert graph.impact_summary(hit).first()["confidence"] == "high"


def test_dead_code_of_sources(spark):
    files = chain(("A", "B")) | {"src/c.ts": "function C() {}\nexport function D() {}\nfunction main() {}\nfunction loginHandler() {}\nfunction useAuth() {}\nexport function open() { inner(); }\nfunction inner() {}\nclass Unused {}\n"}
    g = graph_of(spark, files)
    s = build.compile_snapshot(g, [("all", ["src/**"])])
    assert {r["name"] for r in graph.dead(s.functions, g.calls()).collect()} == {"A", "C"}
    assert {r["name"] for r in graph.dead_classes(s.classes, g.edges).collect()} == {"Unused"}


AUTH = {
    "src/auth/verify.ts": 'import { authMiddleware } from "./middleware";\nexport function verifyToken() { authMiddleware(); }\n', "src/auth/middleware.ts": 'import { verifyToken } from "./verify";\nexport function authMiddleware() { verifyToken(); }\n',
    "src/payments/charge.ts": "export function charge() {}\n",
}


def test_clusters_by_coupling(spark):
    g = graph_of(spark, AUTH)
    got = {r["id"]: r for r in clusters.detect(g.nodes, g.edges, 1).collect()}
    assert len(got) == 2 and sorted(got["auth"]["files"]) == ["src/auth/middleware.ts", "src/auth/verify.ts"] and got["auth"]["confidence"] == 1.0
    two = {r["id"]: r["confidence"] for r in clusters.detect(g.nodes, g.edges).collect()}
    assert two == {"auth": 1.0, "payments": 0.3}  # a file alone is a cluster of low confidence
    domains = spark.createDataFrame([(0, "Authentication", "auth"), (0, "Authentication", "token"), (1, "Payments", "payment"), (1, "Payments", "charge")], "ord int, domain string, keyword string")
    assert {r["id"]: r["name"] for r in clusters.detect(g.nodes, g.edges, domains=domains).collect()} == {"auth": "Authentication", "payments": "Payments"}


def brute_clusters(pairs, files, least_size, least):
    score = {**{(a, b): s for a, b, s in pairs}, **{(b, a): s for a, b, s in pairs}}
    assigned, out = [], []
    for seed, _ in sorted(files.items(), key=lambda x: (-x[1], x[0])):
        if seed in assigned:
            continue
        cluster, grew = [seed], True
        while grew:
            grew = False
            for member in cluster[:]:
                for other in sorted(files):
                    s = score.get((member, other), 0)
                    if s < least or other in assigned or other in cluster:
                        continue
                    affinity = sum(score.get((other, m), 0) for m in cluster) / len(cluster)
                    outside = max([score.get((other, x), 0) for x in files if x not in cluster and x not in assigned], default=0)
                    if affinity > outside:
                        cluster.append(other)
                        grew = True
        if len(cluster) >= least_size:
            assigned += cluster
            out.append(frozenset(cluster))
    return set(out), set(files) - set(assigned)


def test_growth_of_clusters_by_brute_force(spark):
    import random

    r = random.Random(9)
    for _ in range(4):
        files = {f"f{i:02}": r.randint(0, 9) for i in range(24)}
        pairs = [(a, b, round(r.random(), 3)) for a in files for b in files if a < b and r.random() < 0.12]
        rows = clusters.members(spark.createDataFrame(pairs, "a string, b string, score double"), spark.createDataFrame(list(files.items()), "file string, n long")).collect()
        grown: dict = {}
        for x in rows:
            if not x["orphan"]:
                grown.setdefault(x["seed"], set()).add(x["file"])
        assert ({frozenset(v) for v in grown.values()}, {x["file"] for x in rows if x["orphan"]}) == brute_clusters(pairs, files, 2, 0.15)


def test_contract_of_clusters(spark, tmp_path):
    g = graph_of(spark, AUTH | {"src/index.ts": 'import { charge } from "./payments/charge";\nexport function start() { charge(); }\n'})
    c = clusters.contract(clusters.detect(g.nodes, g.edges), g, "shop")
    row = c.first()
    mods = {m["id"]: m for m in row["declared"]["modules"]}
    assert row["project"]["language"] == "typescript" and row["overwrite"]["mode"] == "never"
    assert mods["auth"]["paths"] == ["src/auth/**"] and sorted(mods["auth"]["entryFunctions"]) == ["authMiddleware", "verifyToken"]
    assert {r["path"] for r in clusters.entry_files(g.parsed).collect()} == {"src/index.ts"}
    log = stores.AuditLog(spark, str(tmp_path / "audit"))
    snapshot.write_contract(c, str(tmp_path / "contract"), log)
    again = snapshot.read_contract(spark, str(tmp_path / "contract"))
    assert snapshot.modules(again).count() == len(mods) and snapshot.contract_changes(c, again).isEmpty()
    assert log.read().count() == len(mods)


def test_javascript_and_go_imports(spark):
    js = {"lib/a.js": 'const { b } = require("./b");\nconst c = require("./c");\nfunction a() { b(); c(); }\nmodule.exports = { a };\n', "lib/b.jsx": "export function b() {}\n", "lib/c/index.mjs": "export function c() {}\n"}
    g = graph_of(spark, js)
    assert edges_of(g, "imports") == {("lib/a.js", "lib/b.jsx"), ("lib/a.js", "lib/c/index.mjs")}
    assert ("fn:lib/a.js:a", "fn:lib/b.jsx:b") in edges_of(g, "calls")
    go = {"main.go": 'package main\n\nimport (\n\t"fmt"\n\t"example.org/app/store"\n\t"example.org/app/util"\n)\n\nfunc main() {\n\tlocal()\n\tfmt.Println(store.Get())\n}\n\nfunc local() {}\n', "store/store.go": "package store\n\nfunc Get() int { return 1 }\n", "util.go": "package util\n"}
    g = graph_of(spark, go, module="example.org/app")
    assert edges_of(g, "imports") == {("main.go", "store/store.go"), ("main.go", "util.go")}
    assert edges_of(g, "calls") == {("fn:main.go:main", "fn:main.go:local")}
    ts = {"src/a.ts": 'import { x } from "@/deep/x";\nexport function a() { x(); }\n', "lib/deep/x/index.tsx": "export function x() {}\n"}
    assert edges_of(graph_of(spark, ts, aliases={"typescript": [("@", "lib")]}), "calls") == {("fn:src/a.ts:a", "fn:lib/deep/x/index.tsx:x")}


def test_three_hops(spark):
    files = {
        "src/index.ts": 'import { authMiddleware } from "./auth/middleware";\nexport function handle() { authMiddleware(); }\n', "src/auth/middleware.ts": 'import { verifyToken } from "./verify";\nexport const authMiddleware = (t: string) => verifyToken(t);\n',
        "src/auth/verify.ts": 'import { jwtDecode } from "../utils/jwt";\nexport function verifyToken(t: string) { return jwtDecode(t); }\n', "src/utils/jwt.ts": "export function jwtDecode(t: string) { return t; }\n",
    }
    g = graph_of(spark, files)
    assert edges_of(g, "imports") == {("src/index.ts", "src/auth/middleware.ts"), ("src/auth/middleware.ts", "src/auth/verify.ts"), ("src/auth/verify.ts", "src/utils/jwt.ts")}
    assert {("fn:src/auth/middleware.ts:authMiddleware", "fn:src/auth/verify.ts:verifyToken"), ("fn:src/auth/verify.ts:verifyToken", "fn:src/utils/jwt.ts:jwtDecode")} <= edges_of(g, "calls")


LOGIN = """export async function login(username: string, password: string): Promise<string> {
    const hash = await hashPassword(password)
    if (!hash) {
        throw new Error('no')
    }
    return generateToken(username)
}

function hashPassword(password: string): Promise<string> {
    return Promise.resolve(`h:${password}`)
}

function generateToken(username: string): string {
    return `t:${username}`
}
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "src").mkdir()
    (root / "src" / "auth.ts").write_text(LOGIN)
    (root / "src" / "types").mkdir()
    (root / "src" / "types" / "user.ts").write_text("export interface User { id: string }\n")
    (root / "src" / "api.ts").write_text('app.get("/login", guard, loginRoute);\nfunction loginRoute() {}\n')
    (root / "tsconfig.json").write_text("{}")
    (root / ".ignore").write_text("*.skip.ts\n")
    (root / "src" / "x.skip.ts").write_text("export function skipped() {}\n")
    return str(root)


CONTRACT = {
    "version": "1.0.0", "project": {"name": "demo", "language": "typescript"}, "overwrite": {"mode": "never"},
    "declared": {"modules": [{"id": "auth", "name": "Auth", "paths": ["src/**"], "description": "Users sign in", "owners": []}], "constraints": ["module:auth is isolated", "Tokens are short"], "decisions": [{"id": "token-format", "title": "Token format", "reason": "Plain", "date": "2024-01-01"}]},
}


@pytest.fixture(scope="module")
def project(spark, folder, tmp_path_factory):
    path = tmp_path_factory.mktemp("contract") / "c.json"
    path.write_text(json.dumps(CONTRACT))
    return Project.analyse(spark, folder, snapshot.read_contract(spark, str(path)), name="demo")


def test_a_project_from_its_sources(spark, project):
    assert {r["name"]: (r["start_line"], r["end_line"], r["is_exported"], r["is_async"]) for r in project.functions.where("file = 'src/auth.ts'").collect()} == {"login": (1, 7, True, True), "hashPassword": (9, 11, False, False), "generateToken": (13, 15, False, False)}
    assert project.changed("src/auth.ts").count() == 4 and project.changed("auth.ts").count() == 4 and project.impact("src/auth.ts").count() == 0
    with pytest.raises(NotFound):
        project.impact("src/none.ts")
    login = project.function_detail("login").where("name = 'login'").first()
    assert login["calls"] == ["generateToken", "hashPassword"] and login["body"].startswith("export async function login") and login["module_id"] == "auth"
    with pytest.raises(NotFound):
        project.function_detail("zzz")
    assert [r["name"] for r in project.select(exported=True, asynchronous=True).collect()] == ["login"] and project.select(module="none").isEmpty()
    assert {(r["path"], r["handler"]) for r in project.all_routes().collect()} == {("/login", "loginRoute")}
    assert {r["kind"] for r in project.declared_constraints().collect()} == {"constraint", "decision"}
    assert project.summary.first()["nodes"] == project.nodes.count() and "skipped" not in {r["name"] for r in project.functions.collect()}
    assert project.decide("get", "token-format").first()["title"] == "Token format" and project.decide("list").count() == 1
    with pytest.raises(NotFound):
        project.decide("get", "none")


def test_files_and_the_guard(project):
    f = project.file("src/auth.ts").first()
    assert f["lines"] == 16 and f["text"] == LOGIN
    for bad in ("../secret", "/etc/passwd", "src/../../x", ".."):
        with pytest.raises(AccessDenied):
            project.file(bad)
    assert inside("./src//a/../auth.ts") == "src/auth.ts"
    with pytest.raises(NotFound):
        project.file("src/none.ts")
    text = project.read_file("src/auth.ts", ["hashPassword", "nothing"]).first()[0]
    assert text.startswith("// ── hashPassword ──\n// File: src/auth.ts:9-11\n// Module: auth") and "// Called by: login" in text and "return Promise.resolve" in text and text.endswith('// Function "nothing" not found in src/auth.ts')


def test_changes_and_session(spark, project):
    files = project.files.select("path", "hash")
    assert project.changes(files).isEmpty()
    disk = files.withColumn("hash", F.when(F.col("path") == "src/auth.ts", F.sha2(F.lit("x"), 256)).otherwise(F.col("hash"))).unionByName(spark.createDataFrame([("src/new.ts", "0" * 64), ("node_modules/x.ts", "0" * 64), ("notes.txt", "0" * 64)], "path string, hash string"))
    assert {r["status"]: (r["total"], r["paths"]) for r in project.listed_changes(disk).collect()} == {"modified": (1, ["src/auth.ts"]), "added": (1, ["src/new.ts"])}
    s = project.session_context(disk).first()
    assert s["functions"] == 4 and s["passes"] and s["hot_modules"][0]["module_id"] == "auth"
    e = project.before_edits(["src/auth.ts", "src/api.ts"]).collect()
    assert len(e) == 3 and {r["status"] for r in e} == {"pass"}


def test_vectors_without_a_model(spark, project, tmp_path):
    p = project.embed(stores.VectorStore(spark, str(tmp_path)))
    assert p.semantic("hash of a password", most=1).first()["name"] == "hashPassword"
    assert p.vectors.count() == p.functions.count()


def test_formats(project):
    plain = project.render("change the login token", "plain").first()[0]
    assert "=== ARCHITECTURAL CONTEXT ===" in plain and "export async login(username: string, password: string): Promise<string>" in plain and "GET /login → loginRoute [guard]" in plain and "  • Tokens are short" in plain and "← called by [login]" in plain and "--- src/types/user.ts (types) ---" in plain
    assert plain.index("HTTP ROUTES") < plain.index("DATA MODELS") < plain.index("--- Module:") < plain.index("CONSTRAINTS")
    small = project.render("change the login token", "compact", with_bodies=False).first()[0]
    assert small.startswith("# demo (typescript)\nTask keywords: change, login, token") and "async login(username: string, password: string): Promise<string> [src/auth.ts:1] → generateToken,hashPassword" in small and "return Promise" not in small
    tags = project.render("change the login token", "tagged").first()[0]
    assert tags.startswith("<project_context>") and tags.endswith("</project_context>") and 'returns="Promise&lt;string&gt;"' in tags and "<constraint>Tokens are short</constraint>" in tags


def test_diagrams(spark, project, tmp_path):
    m = project.diagram("module", "auth").first()[0]
    assert m.startswith('graph TD\n    subgraph mod_auth["📦 Module: Auth"]') and '["⚡ login"]' in m and '["λ hashPassword"]' in m and "fn_src_auth_ts_login --> fn_src_auth_ts_hashPassword" in m
    c = project.diagram("capsule", "auth").first()[0]
    assert '["🔒 Internal"]' in c and "publicApi" not in c
    i = project.diagram("impact", "src/auth.ts").first()[0]
    assert '["🔴 login<br/>src/auth.ts"]' in i and "class fn_src_auth_ts_login changed" in i
    f = project.diagram("flow", "fn:src/auth.ts:login").first()[0].split("\n")
    assert f[0] == "sequenceDiagram" and f[2] == "    auth_login->>+auth_generateToken: login() → generateToken()" and f[3] == "    auth_generateToken-->>-auth_login: return"
    assert "No outgoing calls" in project.diagram("flow", "fn:src/auth.ts:hashPassword").first()[0]
    assert "🚀 login" in project.diagram("entries").first()[0]
    with pytest.raises(NotFound):
        project.diagram("module", "none")
    stores.write_reports(project.diagrams(), str(tmp_path))
    assert {"modules", "health", "entries", "module-auth", "capsule-auth"} <= set(os.listdir(tmp_path))


def test_capsule_and_large_modules(spark):
    f = spark.createDataFrame([(f"f{i:02}", f"n{i}", f"src/{i % 20}.ts", "m") for i in range(30)] + [("out", "out", "x.ts", "o")], "id string, name string, file string, module_id string")
    calls = spark.createDataFrame([("out", "f01"), ("f01", "f02")], "src string, dst string")
    from loomgraph.operators import reports

    c = reports.capsule(f, calls, "m").first()[0]
    assert '["🔒 29 internal functions"]' in c and 'ext_out["out<br/>(o)"] --> f01' in c and "class f01 publicApi" in c
    d = reports.module_detail(f, calls, f.where("id < 'f25'").select("id"), "m").first()[0]
    assert "(5 internal functions collapsed)" in d and 'collapsed_files["📁 +5 more files (5 functions)"]' in d
    assert 'f01 -.->|"calls"| ' not in d and "    f01 --> f02" in d


def test_context_files(spark):
    files = {"prisma/schema.prisma": "model A", "db/migrations/1.sql": "create", "src/models/a.ts": "x", "src/models/big.ts": "x" * 50_001, "src/models/none.ts": "", "node_modules/models/b.ts": "x", "docker-compose.yaml": "v", "src/other.ts": "x", "gen/models/c.ts": "x"}
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    got = [(r["path"], r["type"]) for r in contextfiles.discover(df, ["gen/**"]).orderBy("priority", "path").collect()]
    assert got == [("prisma/schema.prisma", "schema"), ("src/models/a.ts", "model"), ("docker-compose.yaml", "docker")]
    assert {r["type"] for r in contextfiles.discover(df.where("path NOT LIKE 'prisma%'")).collect()} >= {"migration"}


def test_snapshot_round_trip_and_errors(spark, project, tmp_path):
    f = project.functions.select("id", "name", "file", "module_id", "calls")
    snapshot.write_snapshot(f, str(tmp_path / "s"))
    back = snapshot.read_snapshot(spark, str(tmp_path / "s"), "id string, name string, file string, module_id string")
    assert {tuple(r[c] if c != "calls" else tuple(r[c]) for c in f.columns) for r in back.collect()} == {tuple(r[c] if c != "calls" else tuple(r[c]) for c in f.columns) for r in f.collect()}
    assert [(r["id"], r["n"]) for r in snapshot.ranks(f).orderBy("n").collect()] == [(i, n) for n, i in enumerate(sorted(r["id"] for r in f.collect()))]
    spark.createDataFrame([(0, '{"id":"a"}'), (0, '{"id":"b"}')], "n long, entry string").write.json(str(tmp_path / "bad"))
    with pytest.raises(SnapshotError):
        snapshot.read_snapshot(spark, str(tmp_path / "bad"), "id string")
    one, two = (snapshot.content_hash(x, "id").first()[0] for x in (f, f.orderBy(F.desc("id"))))
    assert one == two != snapshot.content_hash(f.where("name <> 'login'"), "id").first()[0]
    nodes, edges = build.graph_from_snapshot(project.functions, project.files)
    assert nodes.count() == project.functions.count() + project.files.count()
    assert {(r["src"], r["dst"]) for r in edges.where("type = 'calls'").collect()} == {(r["src"], r["dst"]) for r in project.calls.collect()}


def test_purposes_and_quick_hash(spark):
    df = spark.createDataFrame([("UserCard", ["props"], "JSX.Element"), ("useAuth", ["a"], "void"), ("getUser", ["id", "event"], "User"), ("sum", ["a", "b", "c", "d"], "number"), ("onClick", ["e"], "void")], "n string, p array<string>, r string")
    p = F.transform("p", lambda x: F.struct(x.alias("name")))
    assert [r[0] for r in df.select(S.purpose(F.col("n"), p, F.col("r"))).collect()] == ["User card component", "Hook for auth", "Get user (id)", "Sum", "Handle click"]
    import hashlib

    text = "é" * 5000
    assert spark.createDataFrame([(text,)], "t string").select(S.quick_hash(F.col("t"))).first()[0] == hashlib.sha256(text.encode()[:8192]).hexdigest()[:16]


def test_watcher(spark, tmp_path):
    root, state = tmp_path / "p", tmp_path / "state"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.ts").write_text('import { b } from "./b";\nexport function a() { b(); }\n')
    (root / "src" / "b.ts").write_text("export function b() {}\n")
    told = []
    w = watch.Watcher(spark, str(root), str(state), [("src", ["src/**"])])
    w.on(told.append)
    w.start()
    assert w.state.get()["status"] == "clean" and (state / "watcher.pid").exists() and w.step() is None
    (root / "src" / "b.ts").write_text("export function b() { return 2 }\nexport function c() {}\n")
    assert w.step() == "incremental"
    d = told[-1]["data"]
    assert {r["id"] for r in d["changed"].collect()} == {"src/b.ts", "fn:src/b.ts:b", "fn:src/b.ts:c"}
    assert {r["id"] for r in d["impacted"].collect()} == {"src/a.ts", "fn:src/a.ts:a"}
    (root / "src" / "b.ts").unlink()
    assert w.step() == "incremental" and not edges_of(w.graph, "calls") and w.step() is None
    for i in range(17):
        (root / "src" / f"n{i}.ts").write_text(f"export function n{i}() {{}}\n")
    assert w.step() == "full" and told[-1]["data"]["impacted"].isEmpty() and w.snapshot.functions.count() == 18
    w.state.set("drifted", error="x")
    with pytest.raises(SyncError):
        w.state.require_clean()
    w.stop()
    assert not (state / "watcher.pid").exists()


def test_changes_between_listings(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, hash string")
    b = spark.createDataFrame([("x", "9"), ("z", "3")], "path string, hash string")
    assert {tuple(r) for r in watch.changes(b, a).select("type", "path", "old_hash", "new_hash").collect()} == {("changed", "x", "1", "9"), ("deleted", "y", "2", None), ("added", "z", None, "3")}


def test_commands(spark, folder, capsys):
    run = lambda *a: cli.main([*a, "--root", folder], spark)
    from loomgraph.sources import projects

    assert len(cli.COMMANDS) >= 13 and projects.scaffold(folder) and not projects.scaffold(folder)
    assert run("init") == 0 and os.path.exists(os.path.join(folder, ".loom", "contract"))
    assert run("analyze") == 0 and json.load(open(os.path.join(folder, ".loom", "sync-state.json")))["status"] == "clean"
    assert set(projects.resources(spark, folder)) == {"contract", "snapshot"} and "version" in projects.resources(spark, folder)["contract"]
    capsys.readouterr()
    assert run("stats") == 0 and '"functions"' in capsys.readouterr().out
    assert run("diff") == 0 and '"added"' in capsys.readouterr().out
    assert run("diff") == 0 and capsys.readouterr().out == ""
    assert run("validate") == 0 and run("boundaries") == 0 and run("doctor") == 0
    assert run("ci", "--most-dead", "100") == 0
    assert run("context", "--task", "login token") == 0 and "login" in capsys.readouterr().out
    assert run("context", "--file", "src/none.ts") == 1
    assert run("intent", "--task", "fix hashPassword") == 0 and '"approved": true' in capsys.readouterr().out
    assert run("dead-code") == 0 and run("visualize") == 0 and os.path.exists(os.path.join(folder, ".loom", "diagrams"))
