"""A small code corpus, the same for Spark and for SQL: what classification and ranking are checked on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.rules import Cues

CUES = Cues(routes=("router.post", "router.get", "app.route"), bases=("Base", "DeclarativeBase"), hooks=("useState", "useEffect"))


def _prim(id, primitive, name, path, decorators="", jsx=False, method="", route="", kind=None):
    return (id, primitive, name, path, decorators, jsx, method, route, kind)


#: id, primitive, name, path, decorators (comma-joined), returns_jsx, method, route, kind
PRIMS = [
    _prim("a::api.py::create", "function", "create", "api.py", "router.post,auth", method="POST", route="/orders"),
    _prim("a::api.py::listing", "function", "listing", "api.py", "router.get", method="GET", route="/orders"),
    _prim("a::test_api.py::test_create", "function", "test_create", "tests/test_api.py", "pytest.mark.slow,router.get"),
    _prim("a::test_api.py::helper", "function", "helper", "tests/test_api.py"),
    _prim("a::check.py::probe", "function", "probe", "check.py"),
    _prim("a::conf.py::session", "function", "session", "conf.py", "pytest.fixture"),
    _prim("w::use.ts::useOrders", "function", "useOrders", "src/use.ts"),
    _prim("w::use.ts::useLess", "function", "useLess", "src/use.ts"),
    _prim("w::use.ts::Panel.useRow", "function", "Panel.useRow", "src/use.ts", jsx=True),
    _prim("w::page.tsx::Orders", "function", "Orders", "app/page.tsx", jsx=True),
    _prim("w::page.tsx::render", "function", "render", "app/page.tsx", jsx=True),
    _prim("a::svc.py::save", "function", "save", "svc.py"),
    _prim("a::svc.py::notify", "function", "notify", "svc.py"),
    _prim("a::svc.py::lonely", "function", "lonely", "svc.py"),
    _prim("a::util.py::fmt", "function", "fmt", "util.py"),
    _prim("a::util.py::pad", "function", "pad", "util.py"),
    _prim("a::util.py::dead", "function", "dead", "util.py"),
    _prim("a::db::schema::orders", "class", "orders", "schema.sql", kind="schema"),
    _prim("a::m.py::Order", "class", "Order", "m.py"),
    _prim("a::m.py::Orphan", "class", "Orphan", "m.py"),
    _prim("a::m.py::Typed", "class", "Typed", "m.py"),
    _prim("a::s.py::In", "class", "In", "s.py"),
    _prim("a::s.py::Sub", "class", "Sub", "s.py"),
    _prim("a::s.py::SubSub", "class", "SubSub", "s.py"),
    _prim("a::gen.py::made", "function", "made", "gen.py", "app.route", kind="component"),
    _prim("a::gen.py::known", "function", "known", "test_gen.py", "pytest.x,app.route", kind="endpoint"),
    _prim("a::m.py", "module", "m", "m.py"),
    _prim("a::m.py::Order.__tablename__", "variable", "Order.__tablename__", "m.py"),
]

#: src, dst, kind, via
EDGES = [
    ("a::api.py::create", "a::svc.py::save", "calls", "call"),
    ("a::api.py::create", "external::unresolved::commit", "calls", "method_call"),
    ("a::api.py::listing", "a::util.py::fmt", "calls", "call"),
    ("a::test_api.py::test_create", "a::api.py::create", "tests", "call"),
    ("a::check.py::probe", "a::api.py::listing", "tests", "call"),
    ("w::use.ts::useOrders", "external::npm::react::useState", "calls", "call"),
    ("w::use.ts::useLess", "external::npm::other::useState", "calls", "call"),
    ("w::use.ts::Panel.useRow", "external::npm::react::useEffect", "calls", "call"),
    ("w::page.tsx::Orders", "w::use.ts::useLess", "calls", "call"),
    ("a::svc.py::save", "a::db::schema::orders", "db_access", "session"),
    ("a::svc.py::save", "a::svc.py::notify", "calls", "call"),
    ("a::svc.py::notify", "a::svc.py::save", "calls", "call"),
    ("a::svc.py::notify", "external::queue", "queue_produce", "call"),
    ("a::svc.py::lonely", "external::queue", "queue_produce", "call"),
    ("a::api.py::listing", "a::db::schema::orders", "db_access", "session"),
    ("a::util.py::fmt", "a::util.py::pad", "calls", "call"),
    ("a::util.py::pad", "a::util.py::fmt", "calls", "call"),
    ("a::util.py::pad", "a::svc.py::save", "calls", "call"),
    ("a::m.py::Order", "external::pypi::sqlalchemy::Base", "extends", "base"),
    ("a::m.py::Order", "a::db::schema::orders", "references", "__tablename__"),
    ("a::m.py::Orphan", "external::pypi::sqlalchemy::Base", "extends", "base"),
    ("a::m.py::Typed", "external::pypi::sqlalchemy::Base", "extends", "base"),
    ("a::m.py::Typed", "a::db::schema::orders", "references", "type_hint"),
    ("a::s.py::In", "external::pypi::pydantic::BaseModel", "extends", "base"),
    ("a::s.py::Sub", "a::s.py::In", "extends", "base"),
    ("a::s.py::SubSub", "a::s.py::Sub", "extends", "base"),
    ("a::gen.py::made", "a::util.py::pad", "calls", "call"),
]


def _ranked() -> tuple[list, list, list, list, list]:
    """Nodes, edges, rule claims, step claims and flows of a web service with jobs."""
    nodes, edges = [("GET::/api/all", "endpoint", "api.py"), ("schema::x", "schema", "x.sql"), ("model::0", "model", "m0.py"), ("model::1", "model", "m1.py")], []
    for k in range(8):
        method = "DELETE" if k == 3 else "POST"
        nodes += [(f"{method}::/api/a{k}", "endpoint", f"api{k}.py"), (f"svc::{k}", "service", f"svc{k}.py"), (f"use::{k}", "hook", f"src/use{k}.ts")]
        nodes += [(f"page::{k}", "component", f"app/a{k}/page.tsx" if k % 2 else f"app/a{k}/box.tsx"), (f"job::{k}", None if k % 3 else "service", ("tests/job.py", "jobs/client.py", f"jobs/j{k}.py")[min(k, 2)])]
        edges += [(f"{method}::/api/a{k}", f"svc::{k % 4}"), (f"{method}::/api/a{k}", "schema::x"), (f"svc::{k}", f"model::{k % 2}"), (f"svc::{k}", "lib::outside"), (f"use::{k}", f"{method}::/api/a{k}")]
        edges += [(f"page::{k}", f"use::{k}"), (f"page::{k}", f"{method}::/api/a{k}"), (f"job::{k}", f"{method}::/api/a{k}" if k % 2 else f"svc::{k}"), (f"job::{k}", f"model::{k % 2}")]
    nodes += [(f"test::{k}", "test", f"tests/t{k}.py") for k in range(3)]
    edges += [(f"test::{k}", f"POST::/api/a{k}") for k in range(3)]
    edges += [("GET::/api/all", "svc::0"), ("svc::1", "svc::0"), ("use::1", "POST::/api/a1")]
    claims = [(f"rule::orders::r{k}", i) for k, ids in enumerate((["svc::0", "model::0", "use::1", "page::1"], ["svc::0", "model::0"], ["POST::/api/a7", "svc::3", "model::1"], ["svc::0", "gone", "schema::x", "page::2"])) for i in ids]
    steps = [("process::orders::buy", "pay", "POST::/api/a7"), ("process::orders::buy", "ship", "svc::2"), ("process::orders::old", "end", "gone")]
    flows = [("use::5", "ui_surface"), ("DELETE::/api/a3", "endpoint")]
    return nodes, edges, claims, steps, flows


NODES, LINKS, CLAIMS, STEPS, FLOWS = _ranked()

#: process, step (null: of the process itself), rule
ENFORCED = [("process::orders::buy", None, "rule::orders::r0"), ("process::orders::buy", "pay", "rule::orders::r0"), ("process::orders::buy", "ship", "rule::orders::r1"), ("process::orders::old", "end", "rule::orders::r0"), ("process::orders::old", None, None)]
#: rule, status, title
RULES = [("rule::orders::r0", "llm_drafted", "Total"), ("rule::orders::r1", "stub", "Tax"), ("rule::orders::r2", "stub", "Stock"), ("rule::orders::r3", "human_reviewed", "Refund"), ("rule::orders::r4", "?", "None")]
#: owner, variable, value text
LITERALS = [("a::m.py::Order", "Order.__tablename__", '"orders"'), ("a::m.py::Orphan", "Orphan.__tablename__", "'missing'"), ("a::m.py::Typed", "Typed.__tablename__", "NAME"), ("a::s.py::In", "In.size", '"orders"')]
#: code, severity, affected (comma-joined)
FLAGS = [("B2", "low", "svc::0,model::0"), ("A1", "critical", "svc::0"), ("C3", "info", "svc::1"), ("A2", "high", "model::0,svc::0"), ("A0", "high", "svc::0"), ("Z", "other", "svc::0")]

FACTS = {
    "prims": (PRIMS, "id string, primitive string, name string, path string, decorators string, returns_jsx boolean, method string, route string, kind string"),
    "code_edges": (EDGES, "src string, dst string, kind string, via string"),
    "code_nodes": (NODES, "id string, kind string, path string"),
    "links": (LINKS, "src string, dst string"),
    "rule_claims": (CLAIMS, "rule string, id string"),
    "steps": (STEPS, "process string, step string, id string"),
    "flows": (FLOWS, "id string, role string"),
    "enforced": (ENFORCED, "process string, step string, rule string"),
    "rules": (RULES, "rule string, status string, title string"),
    "literals": (LITERALS, "owner string, name string, value_text string"),
    "flags": (FLAGS, "code string, severity string, affected string"),
}


def facts(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = FACTS[name]
    return spark.createDataFrame(rows, schema)


def _literal(v) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"


def with_facts(sql: str, *names: str) -> str:
    """A SQL statement over the named facts."""
    views = []
    for name in names:
        rows, schema = FACTS[name]
        columns = ", ".join(c.split()[0] for c in schema.split(", "))
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        views.append(f"{name}({columns}) AS (VALUES {values})")
    return f"WITH RECURSIVE {', '.join(views)}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
