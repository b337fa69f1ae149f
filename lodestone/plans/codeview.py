"""The star schema read as source code: packages, modules, symbols, imports, classes, events of functions, database calls, domains.

Regions and nations are packages, suppliers and customers modules; orders are functions and classes of their customer's
module, their lines the events or bases in them. All views grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: One text for both engines.
VIEWS = {
    "c_packages": "SELECT 'm::r' || r_regionkey || '/__init__' AS id FROM region UNION ALL SELECT 'm::n' || n_nationkey || '/__init__' FROM nation",
    "c_symbols": """SELECT DISTINCT module, name, module || '::' || name AS id, primitive FROM (
  SELECT 'm::n' || s_nationkey || '/s' || s_suppkey AS module, 'S' || (s_suppkey % 40) AS name, 'class' AS primitive FROM supplier
  UNION ALL SELECT 'm::n' || s_nationkey || '/s' || s_suppkey, CASE WHEN p_size % 9 = 0 THEN '_' ELSE '' END || replace(p_name, ' ', '_'), 'function' FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT 'm::c' || c_custkey, 'C' || (c_custkey % 40), 'class' FROM customer) x""",
    # A region takes all of its nations and of the next region, in a circle; a nation takes names of its suppliers, and one name of the nation before.
    "c_imports": """SELECT 'm::r' || n_regionkey || '/__init__' AS module, n_nationkey AS ord, 'wildcard' AS via, CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS binding, 'm::n' || n_nationkey || '/__init__' AS target FROM nation
  UNION ALL SELECT 'm::r' || r_regionkey || '/__init__', 1000, 'wildcard', NULL, NULL, 'm::r' || ((r_regionkey + 1) % 5) || '/__init__' FROM region
  UNION ALL SELECT 'm::n' || s_nationkey || '/__init__', 10000 + s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'import_from' WHEN 1 THEN 'wildcard' ELSE 'import' END, CASE WHEN s_suppkey % 3 = 0 THEN 'S' || (s_suppkey % 40) END,
    CASE s_suppkey % 3 WHEN 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'S' END || (s_suppkey % 40) WHEN 2 THEN 's' || s_suppkey END, 'm::n' || s_nationkey || '/s' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '::S' || (s_suppkey % 40) ELSE '' END FROM supplier
  UNION ALL SELECT 'm::n' || n_nationkey || '/__init__', 5000, 'import_from', 'K', 'K', CASE WHEN n_nationkey = 0 THEN 'm::c1::C1' ELSE 'm::n' || (n_nationkey - 1) || '/__init__' END FROM nation
  UNION ALL SELECT 'm::c' || o_custkey, o_orderkey, 'import_from', nm, nm, CASE WHEN o_orderpriority = '5-LOW' THEN 'external::pypi::lib' || (o_orderkey % 7) || '::' || nm WHEN o_orderkey % 3 = 0 THEN 'm::r' || (o_orderkey % 5) || '/__init__' ELSE 'm::n' || (o_orderkey % 25) || '/__init__' END
    FROM (SELECT o.*, CASE o_orderkey % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'A' || (o_orderkey % 40) WHEN 2 THEN 'S' || (o_orderkey % 41) ELSE coalesce(replace(p_name, ' ', '_'), 'none') END AS nm FROM orders o LEFT JOIN part ON p_partkey = o_custkey) n
  UNION ALL SELECT 'm::c' || o_custkey, o_orderkey, 'import', NULL, 'pkg.s' || s_suppkey, 'm::n' || s_nationkey || '/s' || s_suppkey FROM orders JOIN supplier ON s_suppkey = o_orderkey % 10
  UNION ALL SELECT 'm::c' || o_custkey, o_orderkey, 'import', NULL, 'lib' || (o_orderkey % 7), 'external::pypi::lib' || (o_orderkey % 7) FROM orders WHERE o_orderstatus = 'O'""",
    "c_bases": """SELECT 'm::c' || o_custkey || '::O' || o_orderkey AS src, 'm::c' || o_custkey AS module, l_linenumber AS ord,
  CASE l_linenumber WHEN 1 THEN 'pkg.s' || (l_orderkey % 10) || CASE WHEN l_partkey % 2 = 0 THEN '.deep' ELSE '' END WHEN 2 THEN 'lib' || (l_orderkey % 7) || '.orm' END AS chain,
  CASE l_linenumber WHEN 1 THEN 'S' || (l_orderkey % 10) WHEN 2 THEN 'Base' WHEN 3 THEN 'C' || (o_custkey % 40) WHEN 4 THEN 'S' || (l_suppkey % 40) WHEN 5 THEN 'Exception' WHEN 6 THEN 'A' || (l_suppkey % 40) ELSE 'K' END AS name
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) l JOIN orders ON l_orderkey = o_orderkey""",
    "c_events": """SELECT 'm::c' || o_custkey || '::f' || o_orderkey AS fn, 'm::c' || o_custkey AS module, 0 AS ord, 'self' AS op, 'self' AS var, CAST(NULL AS STRING) AS type, CAST(NULL AS STRING) AS name, 'm::c' || o_custkey || '::C' || (o_custkey % 40) AS owner FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT 'm::c' || o_custkey || '::f' || o_orderkey, 'm::c' || o_custkey, l_linenumber, CASE (l_linenumber + l_orderkey) % 3 WHEN 0 THEN CASE l_returnflag WHEN 'A' THEN 'annotate' ELSE 'make' END ELSE 'call' END,
    CASE WHEN (l_linenumber + l_orderkey) % 3 = 0 THEN 'v' || (l_partkey % 2) WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN 'self' WHEN l_partkey % 5 = 2 THEN 'lib' || (l_orderkey % 7) ELSE 'v' || (l_partkey % 2) END,
    CASE WHEN (l_linenumber + l_orderkey) % 3 = 0 THEN CASE l_suppkey % 4 WHEN 0 THEN 'C' || (o_custkey % 40) WHEN 1 THEN 'list' WHEN 2 THEN 'K' ELSE 'S' || (l_orderkey % 41) END END,
    CASE WHEN (l_linenumber + l_orderkey) % 3 <> 0 THEN CASE l_suppkey % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'C' || (o_custkey % 40) WHEN 2 THEN 'S' || (l_orderkey % 41) WHEN 3 THEN 'run' ELSE 'stop' END END, NULL
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber) l JOIN orders ON l_orderkey = o_orderkey""",
    "c_methods": """SELECT 'm::n' || s_nationkey || '/s' || s_suppkey || '::S' || (s_suppkey % 40) AS class, 'run' AS name, 'm::n' || s_nationkey || '/s' || s_suppkey || '::S' || (s_suppkey % 40) || '.run' AS id FROM supplier
  UNION ALL SELECT 'm::c' || c_custkey || '::C' || (c_custkey % 40), 'stop', 'm::c' || c_custkey || '::C' || (c_custkey % 40) || '.stop' FROM customer WHERE c_mktsegment <> 'BUILDING'""",
    "c_schemas": "SELECT 't' || n_nationkey AS name, 'db::schema::t' || n_nationkey AS id FROM nation WHERE n_nationkey % 5 <> 4",
    "c_schema_of": """SELECT 'm::n' || s_nationkey || '/s' || s_suppkey || '::S' || (s_suppkey % 40) AS class, 'db::schema::t' || s_nationkey AS schema FROM supplier
  UNION ALL SELECT 'm::c1::C1', 'db::schema::t1' FROM region WHERE r_regionkey = 0""",
    "c_params": "SELECT 'm::c' || o_custkey || '::f' || o_orderkey AS fn, 'row' AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'K' ELSE 'S' || (o_orderkey % 41) END AS type FROM orders",
    "c_db_calls": """SELECT 'm::c' || o_custkey || '::f' || o_orderkey AS fn, 'm::c' || o_custkey AS module, l_linenumber AS ord, CASE l_linenumber % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'row' WHEN 2 THEN 'S' || (o_orderkey % 41) END AS arg,
  CASE WHEN l_linenumber % 4 = 3 THEN CASE WHEN l_suppkey % 7 = 0 THEN 'BEGIN' ELSE 'select * FROM t' || (l_suppkey % 25) || ' x JOIN t' || (l_partkey % 25) || ' y ON x.k = y.k' END END AS sql
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) l JOIN orders ON l_orderkey = o_orderkey""",
    # Orders are domain entries; one in three stands for what an earlier order stands for, some in circles.
    "c_domains": """SELECT 'd' || o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'relationship' WHEN 1 THEN 'relationship' WHEN 2 THEN 'resource' WHEN 3 THEN 'role' WHEN 4 THEN 'attribute' ELSE 'resource' END AS subkind,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'n' || (o_custkey % 25) || '/s' || (o_orderkey % 50) END AS defined_in, CASE WHEN o_orderkey % 6 = 3 THEN 'S' || (o_orderkey % 40) ELSE 't' || (o_orderkey % 50) END AS table_name,
  CASE WHEN o_orderkey % 6 = 0 AND o_orderkey > 6 THEN 'd' || (o_orderkey - 6) WHEN o_orderkey % 6 = 1 THEN 'd' || (o_orderkey + CASE o_orderkey % 4 WHEN 1 THEN 1 ELSE 0 END) ELSE NULL END AS mediated_by FROM orders WHERE o_orderkey % 997 < 300 OR o_orderkey % 6 <> 0""",
    "c_models": "SELECT 'model::' || s_suppkey AS id, 'n' || s_nationkey || '/s' || (s_suppkey % 50) AS file, CASE WHEN s_suppkey % 3 <> 0 THEN 't' || (s_suppkey % 30) END AS tablename, 'S' || (s_suppkey % 40) AS name FROM supplier",
}


def view(spark: SparkSession, sf_dir: str, name: str, texts: dict[str, str] = VIEWS) -> DataFrame:
    used: dict[str, DataFrame] = {}

    def bind(m: re.Match) -> str:
        used.setdefault(m[2], table(spark, sf_dir, m[2]))
        return f"{m[1]} {{{m[2]}}}"

    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", bind, texts[name]), **used)


def with_views(sql: str, *names: str, texts: dict[str, str] = VIEWS) -> str:
    """A SQL statement over some of the views."""
    views = [f"{n} AS ({texts[n].replace('AS STRING)', 'AS VARCHAR)')})" for n in names]
    return f"WITH RECURSIVE {', '.join(views)}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
