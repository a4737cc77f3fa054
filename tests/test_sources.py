"""Parsers, discovery, contracts and snapshots on small sources."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.sources import golang, parsing, script, snapshot

TS = '''import { hash as h, verify } from "./crypto";
import type { T } from "./types";
import def, * as all from "lib";
// import gone from "comment";
const lazy = () => import("./lazy");

/** Signs a user in. */
export async function login(name: string, pass?: string, n = 3): Promise<User> {
  if (!name) { return null; }
  try {
    const user = await db.find(name);
    logger.info("call() in a string");
    return new Session(user);
  } catch (e) {
    throw new Error("bad");
  }
}

const double = (x: number): number => x * twice(x);
function inner() { function nested() { return 1 } return nested() }

export class Auth<T> extends Base {
  constructor(private db: Db) { super(); }
  async check(token: string): Promise<boolean> {
    for (const x of list) { use(x); }
    return verify(token);
  }
}
export interface User { id: string }
type Id = string;
export const LIMIT = 5;
export { double, inner as renamed };
app.get("/users/:id", auth, upload.single("f"), getUser);
router.use(middleware);
prisma.file.delete("x");
'''


def test_script_entities():
    e = script.parse("src/a.ts", TS)
    f = {x["name"]: x for x in e["functions"]}
    assert {"lazy", "login", "double", "inner"} == f.keys()
    login = f["login"]
    assert login["is_async"] and login["is_exported"] and login["purpose"] == "Signs a user in." and login["return_type"] == "Promise<User>"
    assert [p["name"] for p in login["params"]] == ["name", "pass", "n"] and login["params"][1]["optional"] and login["params"][2]["default_value"] == "3"
    assert login["calls"] == ["db.find", "logger.info", "Session", "Error"] and login["edge_cases"] == ["!name"]
    assert [x["type"] for x in login["error_handling"]] == ["try-catch", "throw"] and (login["start_line"], login["end_line"]) == (8, 17)
    assert f["double"]["calls"] == ["twice"] and f["double"]["is_exported"] and f["inner"]["purpose"] == "Inner"
    (c,) = e["classes"]
    assert c["name"] == "Auth" and c["is_exported"] and [m["name"] for m in c["methods"]] == ["Auth.constructor", "Auth.check"]
    assert c["methods"][1]["calls"] == ["use", "verify"] and c["methods"][1]["is_async"]
    assert {(g["name"], g["kind"], g["is_exported"]) for g in e["generics"]} == {("User", "interface", True), ("Id", "type", False), ("LIMIT", "const", True)}
    i = {x["source"]: x for x in e["imports"]}
    assert i.keys() == {"./crypto", "lib", "./lazy"} and i["./crypto"]["names"] == ["h", "verify"] and i["lib"]["is_default"] and i["./lazy"]["is_dynamic"]
    assert {"login", "Auth", "User", "LIMIT", "double", "renamed"} <= {x["name"] for x in e["exports"]}
    assert [(r["method"], r["path"], r["handler"], r["middlewares"]) for r in e["routes"]] == [("GET", "/users/:id", "getUser", ["auth", "upload.single"]), ("USE", "*", "middleware", [])]


def test_commonjs():
    e = script.parse("src/login.js", '''const crypto = require('crypto');
const { sign, verify } = require("jsonwebtoken");
// const no = require('bad');
const hashPassword = async function (p, salt) { return crypto.hash(p) };
exports.legacy = function (req, res) { if (!req) throw new Error("x"); };
module.exports = { hashPassword, other: 1 };
const triple = x => x * 3;
''')
    f = {x["name"]: x for x in e["functions"]}
    assert f.keys() == {"hashPassword", "legacy", "triple"} and f["hashPassword"]["is_exported"] and f["hashPassword"]["is_async"] and not f["triple"]["is_exported"]
    assert [p["name"] for p in f["legacy"]["params"]] == ["req", "res"] and f["legacy"]["edge_cases"] == ["!req"]
    i = {x["source"]: x for x in e["imports"]}
    assert i.keys() == {"crypto", "jsonwebtoken"} and i["crypto"]["is_default"] and i["jsonwebtoken"]["names"] == ["sign", "verify"]
    assert script.parse("e.js", "")["functions"] == [] and script.parse("e.js", "// only\n/* comments */")["imports"] == []


GO = '''package auth

import (
	"context"
	log "github.com/x/logrus"
	_ "embed"
)

// AuthService handles authentication.
type AuthService struct {
	db DB
}

// VerifyToken validates a token.
func (s *AuthService) VerifyToken(ctx context.Context, a, b string) (*Claims, error) {
	if a == "" {
		return nil, errors.New("empty")
	}
	x, err := jwt.Parse(a)
	if err != nil {
		return nil, err
	}
	return x, nil
}

func keyFunc(secret string, more ...int) interface{} {
	return func(t *jwt.Token) { return []byte(secret) }
}

func Routes(r *gin.Engine) {
	r.GET("/health", check)
	r.POST("/users", auth, createUser)
	http.HandleFunc("/old", legacy)
}
func (o Orphan) Do() {}
'''


def test_go():
    e = golang.parse("auth/s.go", GO)
    c = {x["name"]: x for x in e["classes"]}
    assert c.keys() == {"AuthService", "Orphan"} and "authentication" in c["AuthService"]["purpose"]
    (m,) = c["AuthService"]["methods"]
    assert m["id"] == "fn:auth/s.go:AuthService.VerifyToken" and m["is_exported"] and m["return_type"] == "(*Claims, error)"
    assert [(p["name"], p["type"]) for p in m["params"]] == [("ctx", "context.Context"), ("a", "string"), ("b", "string")]
    assert m["calls"] == ["errors.New", "jwt.Parse"] and m["edge_cases"] == ['a == ""', "err != nil"] and len(m["error_handling"]) == 1
    f = {x["name"]: x for x in e["functions"]}
    assert f.keys() == {"keyFunc", "Routes"} and f["keyFunc"]["return_type"] == "interface{}" and f["keyFunc"]["params"][1]["type"] == "...int"
    assert [(i["source"], i["names"]) for i in e["imports"]] == [("context", ["context"]), ("github.com/x/logrus", ["log"])]
    assert {x["name"] for x in e["exports"]} == {"Routes", "AuthService", "Orphan"}
    assert [(r["method"], r["path"], r["handler"], r["middlewares"]) for r in e["routes"]] == [("GET", "/health", "check", []), ("POST", "/users", "createUser", ["auth"]), ("ANY", "/old", "legacy", [])]


def test_tables_of_files(spark):
    files = spark.createDataFrame([("src/a.ts", TS), ("s.go", GO), ("x.py", "pass"), ("n.js", None), ("web/app/(shop)/items/[id]/route.ts", "export async function GET() {}\nexport const POST = () => 1")], "path string, text string")
    p = parsing.parse_files(files)
    assert {r["path"]: r["language"] for r in p.collect()} == {"src/a.ts": "typescript", "s.go": "go", "n.js": "javascript", "web/app/(shop)/items/[id]/route.ts": "typescript"}
    assert parsing.all_functions(p).count() == 4 + 2 + 2 + 2 + 2
    assert {(r["method"], r["url"]) for r in parsing.next_routes(p).collect()} == {("GET", "/items/:id"), ("POST", "/items/:id")}
    assert parsing.child(p, "routes").count() == 5
    with pytest.raises(Exception, match="no parser"):
        parsing.parse_files(files, strict=True).collect()


def test_ignore_and_discovery(spark):
    assert parsing.ignore_globs("# c\n\ndist/\n*.svg\npackages/*/tests/\n!keep\nui/**") == ["**/dist/**", "**/*.svg", "packages/*/tests/**", "ui/**"]
    paths = ["src/a.ts", "a.tsx", "node_modules/x/a.ts", "src/a.test.ts", "b.go", "dist/c.js", "gen/d.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"] for r in parsing.discover(df, "typescript", ["gen/**"]).collect()} == {"src/a.ts", "a.tsx"}
    assert {r["path"] for r in parsing.discover(df, "go").collect()} == {"b.go"}


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("export const x = 1\n")
    got = parsing.read_tree(spark, str(tmp_path)).collect()
    assert [(r["path"], r["text"]) for r in got] == [("src/a.ts", "export const x = 1\n")]


def test_globs():
    import re

    assert re.search(S.glob_regex("src/auth/**"), "src/auth/a/b.ts") and not re.search(S.glob_regex("src/*.ts"), "src/a/b.ts")
    assert re.search(S.glob_regex("a(1)/*.ts"), "a(1)/b.ts")
    assert re.search(S.glob_regex("src/auth/**", True), "src/auth/verify.ts") and not re.search(S.glob_regex("src/auth/**", True), "src/auth/a/b.ts")


CONTRACT = {"version": "1", "project": {"name": "p", "description": "", "language": "typescript"}, "declared": {"modules": [{"id": "auth", "name": "Auth", "description": "", "paths": ["src/**"], "owners": ["alice"]}], "constraints": ["No direct DB access outside db/"], "decisions": [{"id": "d1", "title": "t", "reason": "r", "date": "2024"}]}}


def test_contract(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(CONTRACT))
    c = snapshot.read_contract(spark, str(path))
    assert c.first()["overwrite"]["mode"] == "never" and snapshot.modules(c).first()["owners"] == ["alice"] and snapshot.rules(c).count() == 1
    d = snapshot.decisions(c)
    more = snapshot.add_decision(d, ("d2", "t2", "r2", "2025"))
    assert more.count() == 2 and snapshot.update_decision(more, "d2", title="new").where("title = 'new'").count() == 1 and snapshot.remove_decision(more, "d1").count() == 1
    for bad in (lambda: snapshot.add_decision(d, ("d1", "", "", "")), lambda: snapshot.remove_decision(d, "x"), lambda: snapshot.merge_contract(c, c, "ask")):
        with pytest.raises(snapshot.ContractError):
            bad()
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(snapshot.ContractError):
        snapshot.read_contract(spark, str(tmp_path / "bad.json"))
    new = c.withColumn("version", F.lit("2")).withColumn("overwrite", F.lit(None).cast(c.schema["overwrite"].dataType))
    assert snapshot.merge_contract(c, new).first()["version"] == "1"
    kept = snapshot.merge_contract(c, new, "explicit").first()
    assert kept["version"] == "2" and kept["overwrite"]["mode"] == "never"


def test_snapshot_round_trip(spark):
    f = spark.createDataFrame([("fn:a:x", "x", None, ["fn:a:y", "fn:b:z"]), ("fn:a:y", "y", "p", []), ("fn:b:z", "z", None, None)], "id string, name string, purpose string, calls array<string>")
    c = snapshot.compact(f)
    assert not c.where(F.contains("entry", F.lit("purpose"))).where(F.contains("entry", F.lit('"x"'))).count()
    back = {r["id"]: (r["name"], r["purpose"], r["calls"]) for r in snapshot.hydrate(c, "id string, name string, purpose string").collect()}
    assert back == {"fn:a:x": ("x", None, ["fn:a:y", "fn:b:z"]), "fn:a:y": ("y", "p", []), "fn:b:z": ("z", None, [])}
    assert snapshot.fingerprint(f).first() == snapshot.fingerprint(f.orderBy(F.desc("id"))).first() != snapshot.fingerprint(f.limit(2)).first()
