"""The star schema read as facts of code analysis: primitives and their edges, nodes and links of a service, rules, processes, flags.

Parts are functions, suppliers mapped classes, nations schemas, customers validated classes; consecutive lines of an order are calls.
The same text serves both engines, and every view grows with its tables.
"""

from __future__ import annotations


def _function(p: str) -> str:
    """The id of a part as a function; its path and name follow from its key and size."""
    return f"('a::' || {_path(p)} || '::' || {_name(p)})"


def _path(p: str) -> str:
    k = f"({p}.p_partkey % 40)"
    return f"(CASE {p}.p_partkey % 6 WHEN 0 THEN 'api/p' || {k} || '.py' WHEN 1 THEN 'tests/test_p' || {k} || '.py' WHEN 2 THEN 'src/use' || {k} || '.ts' WHEN 3 THEN 'app/p' || {k} || '/page.tsx' WHEN 4 THEN 'svc/s' || {k} || '.py' ELSE 'util/u' || {k} || '.py' END)"


def _name(p: str) -> str:
    return f"(CASE {p}.p_partkey % 6 WHEN 0 THEN 'create' WHEN 1 THEN CASE WHEN {p}.p_size % 2 = 0 THEN 'test_' ELSE 'helper' END WHEN 2 THEN 'useP' WHEN 3 THEN CASE WHEN {p}.p_size % 2 = 0 THEN 'Panel' ELSE 'render' END WHEN 4 THEN 'save' ELSE 'fmt' END || {p}.p_partkey)"


def _node(p: str) -> str:
    """The id of a part as a node of a service."""
    k = f"{p}.p_partkey"
    return f"(CASE {k} % 5 WHEN 0 THEN CASE WHEN {k} % 20 = 15 THEN 'DELETE' WHEN {k} % 20 = 5 THEN 'GET' ELSE 'POST' END || '::/api/a' || {k} WHEN 1 THEN 'svc::' || {k} WHEN 2 THEN 'use::' || {k} WHEN 3 THEN 'page::' || {k} ELSE CASE WHEN {k} % 15 = 4 THEN 'model::' ELSE 'job::' END || {k} END)"


_CLASS = "('a::m' || s_nationkey || '.py::M' || s_suppkey)"
#: Distinct pairs of parts that follow one another in an order, from the lines that pass a test.
_PAIRS = "(SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE {})"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
VIEWS = {
    "prims": f"""SELECT {_function('p')} AS id, 'function' AS primitive, {_name('p')} AS name, {_path('p')} AS path,
    CASE WHEN p.p_partkey % 6 = 0 AND p.p_size % 3 <> 0 THEN 'router.post,auth' WHEN p.p_partkey % 6 = 1 AND p.p_size % 5 = 0 THEN 'pytest.mark.slow,router.get' WHEN p.p_partkey % 6 = 4 AND p.p_size % 11 = 0 THEN 'app.route' ELSE '' END AS decorators,
    p.p_partkey % 6 = 3 AS returns_jsx, CASE WHEN p.p_partkey % 6 = 0 THEN 'POST' ELSE '' END AS method, CASE WHEN p.p_partkey % 12 = 0 THEN '/a' || p.p_partkey ELSE '' END AS route, CASE WHEN p.p_partkey % 97 = 0 THEN 'component' WHEN p.p_partkey % 89 = 0 THEN 'endpoint' END AS kind FROM part p
  UNION ALL SELECT {_CLASS}, 'class', 'M' || s_suppkey, 'm' || s_nationkey || '.py', '', false, '', '', NULL FROM supplier
  UNION ALL SELECT {_CLASS} || '.__tablename__', 'variable', 'M' || s_suppkey || '.__tablename__', 'm' || s_nationkey || '.py', '', false, '', '', NULL FROM supplier
  UNION ALL SELECT 'a::db::schema::t' || n_nationkey, 'class', 't' || n_nationkey, 'schema.sql', '', false, '', '', 'schema' FROM nation
  UNION ALL SELECT 'a::m' || n_nationkey || '.py', 'module', 'm' || n_nationkey, 'm' || n_nationkey || '.py', '', false, '', '', NULL FROM nation
  UNION ALL SELECT 'a::s.py::In' || c_custkey, 'class', 'In' || c_custkey, 's.py', '', false, '', '', NULL FROM customer""",
    "code_edges": f"""SELECT {_function('s')} AS src, {_function('t')} AS dst, CASE WHEN s.p_partkey % 6 = 1 THEN 'tests' ELSE 'calls' END AS kind, 'call' AS via FROM {_PAIRS.format("x.l_linenumber <= 2 AND x.l_returnflag = 'R'")} e JOIN part s ON s.p_partkey = e.a JOIN part t ON t.p_partkey = e.b
  UNION ALL SELECT {_function('p')}, 'external::npm::react::useState', 'calls', 'call' FROM part p WHERE p.p_partkey % 6 = 2 AND p.p_size % 2 = 0
  UNION ALL SELECT {_function('p')}, 'a::db::schema::t' || (p.p_partkey % 25), 'db_access', 'session' FROM part p WHERE p.p_partkey % 6 = 4 AND p.p_size % 4 = 0
  UNION ALL SELECT {_function('p')}, 'external::queue', 'queue_produce', 'call' FROM part p WHERE p.p_partkey % 6 = 5 AND p.p_size % 7 = 0
  UNION ALL SELECT {_function('p')}, 'external::unresolved::commit', 'calls', 'method_call' FROM part p WHERE p.p_partkey % 13 = 0
  UNION ALL SELECT {_CLASS}, 'external::pypi::sqlalchemy::Base', 'extends', 'base' FROM supplier WHERE s_suppkey % 4 <> 0
  UNION ALL SELECT {_CLASS}, 'a::db::schema::t' || s_nationkey, 'references', CASE WHEN s_suppkey % 3 = 0 THEN 'type_hint' ELSE '__tablename__' END FROM supplier
  UNION ALL SELECT 'a::s.py::In' || c_custkey, CASE WHEN c_custkey % 10 = 0 THEN CASE WHEN c_custkey % 20 = 0 THEN 'external::pypi::pydantic::BaseModel' ELSE 'external::pypi::other::Model' END ELSE 'a::s.py::In' || (c_custkey - 1) END, 'extends', 'base' FROM customer""",
    "code_nodes": f"""SELECT {_node('p')} AS id, CASE p.p_partkey % 5 WHEN 0 THEN 'endpoint' WHEN 1 THEN 'service' WHEN 2 THEN 'hook' WHEN 3 THEN CASE WHEN p.p_size % 4 = 0 THEN 'test' ELSE 'component' END ELSE CASE WHEN p.p_partkey % 15 = 4 THEN 'model' END END AS kind,
    CASE p.p_partkey % 5 WHEN 3 THEN CASE WHEN p.p_size % 2 = 0 THEN 'app/a/page.tsx' ELSE 'app/a/box.tsx' END WHEN 4 THEN CASE WHEN p.p_size % 3 = 0 THEN 'tests/job.py' ELSE 'jobs/job.py' END ELSE 'src/f' || (p.p_partkey % 30) || '.py' END AS path FROM part p
  UNION ALL SELECT 'schema::t' || n_nationkey, 'schema', 'schema.sql' FROM nation""",
    "links": f"""SELECT {_node('s')} AS src, CASE WHEN s.p_size % 9 = 0 THEN 'schema::t' || (t.p_partkey % 25) WHEN s.p_size % 10 = 0 THEN 'lib::outside' ELSE {_node('t')} END AS dst FROM {_PAIRS.format("x.l_linenumber = 1 AND x.l_returnflag = 'R' AND x.l_suppkey % 2 = 0")} e JOIN part s ON s.p_partkey = e.a JOIN part t ON t.p_partkey = e.b""",
    "rule_claims": f"SELECT DISTINCT 'rule::d::r' || l_suppkey AS rule, CASE WHEN l_quantity = 1 THEN 'gone::' || l_partkey ELSE {_node('p')} END AS id FROM lineitem JOIN part p ON p.p_partkey = l_partkey WHERE l_linenumber = 2 AND l_returnflag = 'A'",
    "steps": f"SELECT DISTINCT 'process::d::p' || l_suppkey AS process, 's' || l_linenumber AS step, {_node('p')} AS id FROM lineitem JOIN part p ON p.p_partkey = l_partkey WHERE l_linenumber = 7 AND l_returnflag = 'A' AND l_partkey % 4 = 0",
    "flows": f"SELECT {_node('p')} AS id, CASE WHEN p.p_partkey % 5 = 0 THEN 'endpoint' ELSE 'ui_surface' END AS role FROM part p WHERE p.p_size = 1",
    "enforced": "SELECT DISTINCT 'process::d::p' || (l_partkey % 50) AS process, CASE WHEN l_linenumber < 6 THEN 's' || l_linenumber END AS step, CASE WHEN l_quantity > 2 THEN 'rule::d::r' || l_suppkey END AS rule FROM lineitem WHERE l_linenumber >= 5",
    "rules": "SELECT 'rule::d::r' || s_suppkey AS rule, CASE s_suppkey % 4 WHEN 0 THEN 'stub' WHEN 1 THEN 'llm_drafted' WHEN 2 THEN 'human_reviewed' ELSE 'other' END AS status, s_name AS title FROM supplier",
    "literals": f"SELECT {_CLASS} AS owner, 'M' || s_suppkey || CASE WHEN s_suppkey % 10 = 9 THEN '.label' ELSE '.__tablename__' END AS name, CASE s_suppkey % 5 WHEN 0 THEN '\"t' || s_nationkey || '\"' WHEN 1 THEN '\"missing\"' WHEN 2 THEN 'compute()' ELSE chr(39) || 't' || s_nationkey || chr(39) END AS value_text FROM supplier",
    "flags": f"SELECT 'F' || l_orderkey || '.' || l_linenumber AS code, CASE l_orderkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'odd' END AS severity, {_node('p')} || ',rule::d::r' || l_suppkey AS affected FROM lineitem JOIN part p ON p.p_partkey = l_partkey WHERE l_linenumber = 6",
}
