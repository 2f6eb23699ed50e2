"""Code facts and the graph by path on hand cases."""

from __future__ import annotations

import pytest

from tessera.operators import code_graph as G

SERVER = """import { validateSession } from "./auth/session";
const router = require("./router");
import * as util from '../lib'; import "./side.css";

export function loginHandler(req, res) {
  if (req) validateSession(req.headers.authorization);
  return util.deep(process.env.API_KEY);
}
router.get("/health", healthHandler);
"""
FILES = {
    "src/server.ts": SERVER,
    "src/auth/session.ts": "export function validateSession(token) { return token; }\nexport class Session {}",
    "src/router/index.ts": "const router = make();\nmodule.exports = router; function router() {}",
    "lib/index.ts": "export const deep = (x) => lonely(x);",
    "other/lonely.ts": "export function lonely(x) { return x; }",
    "other/twice.ts": "export function common() {}",
    "more/twice.ts": "export function common() {} common();",
    "src/user.ts": "common(); import { gone } from './nowhere'; import x from 'react';",
    "tests/auth/session.test.ts": "import { validateSession } from '../src/auth/session';\nfunction shouldValidateSession() { return validateSession(1); }",
    "package.json": '{"name": "@acme/api", "scripts": {"dev": "node server.js", "test": "vitest run"}, "workspaces": ["packages/*", "apps/*"]}',
    "docker-compose.yml": "\nservices:\n  gateway:\n    image: one\n  worker:\n    image: two\nvolumes:\n  data:\n",
    "empty.ts": None,
}


@pytest.fixture(scope="module")
def files(spark):
    rows = spark.createDataFrame(list(FILES.items()), "path string, text string")
    return rows.select("path", G.code_facts("text", "path").alias("f")).select("path", "f.*")


def test_facts(files):
    own = {r.path: r for r in files.collect()}
    server = own["src/server.ts"]
    assert server.imports == ["./auth/session", "../lib", "./router", "./side.css"]
    assert [f"{i.symbol} from {i.module}" for i in server.imported] == ["validateSession from ./auth/session", "util from ../lib", "router from ./router"]
    assert (server.exports, server.routes, server.functions, server.env) == (["loginHandler"], ["GET /health"], ["loginHandler"], ["API_KEY"])
    assert "validateSession" in server.calls and "if" not in server.calls and "loginHandler" in server.defined and not server.is_test
    package, compose = own["package.json"], own["docker-compose.yml"]
    assert (package.package, package.scripts, package.workspaces, package.config_kinds) == ("@acme/api", ["dev", "test"], ["packages/*", "apps/*"], ["package"])
    assert (compose.services, compose.config_kinds, compose.package) == (["gateway", "worker"], ["docker"], None)
    assert own["tests/auth/session.test.ts"].is_test and own["empty.ts"].calls == []


def test_graph(files):
    got = {(r.kind, r.file, r.symbol, r.to_file) for r in G.code_graph(files).collect()}
    s, session, test = "src/server.ts", "src/auth/session.ts", "tests/auth/session.test.ts"
    assert got == {
        ("imports", s, None, session), ("imports", s, None, "src/router/index.ts"), ("imports", s, None, "lib/index.ts"), ("imports", test, None, session), ("tests", test, None, session),
        ("imports_symbol", s, "validateSession", session), ("imports_symbol", s, "router", "src/router/index.ts"), ("imports_symbol", test, "validateSession", session),
        ("calls", s, "validateSession", session), ("calls", s, "deep", "lib/index.ts"), ("calls", "lib/index.ts", "lonely", "other/lonely.ts"), ("calls", test, "validateSession", session),
        ("references", s, "validateSession", session), ("references", s, "router", "src/router/index.ts"), ("references", test, "validateSession", session),
    }
    signals = {(r.kind, r.file, r.name) for r in G.file_signals(files).collect()}
    assert {("route", s, "GET /health"), ("package", "package.json", "@acme/api"), ("service", "docker-compose.yml", "gateway"), ("env", s, "API_KEY")} <= signals


def test_resolution_of_dots(spark):
    rows = spark.createDataFrame([("a/b", "./c", "a/b/c"), ("a/b", "../c", "a/c"), ("a", "../../c", "c"), ("", "./c/./d", "c/d"), ("a", "react", None), ("a/b", "..", "a")], "folder string, module string, want string")
    assert [r.got for r in rows.select(G.resolved(rows.module, rows.folder).alias("got")).collect()] == [r.want for r in rows.collect()]


def test_each_edge_once_and_files_read_once(spark, files):
    twice = G.code_graph(files.unionByName(files)).collect()  # a path that comes twice
    assert twice and len(twice) == len(set(twice))
    plan = G.code_graph(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "regexp_replace" not in plan
