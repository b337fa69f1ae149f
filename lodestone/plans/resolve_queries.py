"""Name resolution over the star schema read as source code. Their SQL is written apart from the operators: rounds are unrolled, windows rank candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import resolve as R
from lodestone.storage import cut, release

from .codeview import view, with_views
from .registry import ORACLE, QUERIES


def on_code(sql: str, *names: str) -> Callable:
    """Registers a function of the named views; sql may use the same names."""

    def put(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, n) for n in names])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLE[f.__name__] = with_views(sql, *names)
        return f

    return put


def _rounds(cap: int) -> str:
    """The closure of re-exports, a pair of tables a round."""
    out = [", e0 AS MATERIALIZED (SELECT module, ord, via, name, binding, target FROM c_imports)"]
    for k in range(1, cap + 1):
        chain = f" UNION ALL SELECT e.module, x.name, x.target, 1, e.ord, 1 FROM e{k - 1} e JOIN x{k - 1} x ON x.module = e.target WHERE e.via = 'wildcard' AND e.module IN (SELECT id FROM c_packages) AND x.name[1] <> '_'" if k > 1 else ""
        out.append(
            f"""x{k} AS MATERIALIZED (SELECT module, name, target FROM (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY rank, pos, source, target) AS r FROM (
  SELECT module, binding AS name, target, 0 AS rank, -ord AS pos, 0 AS source FROM e{k - 1} WHERE binding IS NOT NULL AND via <> 'wildcard' AND module IN (SELECT id FROM c_packages)
  UNION ALL SELECT e.module, s.name, s.id, 1, e.ord, 0 FROM e{k - 1} e JOIN c_symbols s ON s.module = e.target WHERE e.via = 'wildcard' AND e.module IN (SELECT id FROM c_packages) AND s.name[1] <> '_'{chain}) o) p WHERE r = 1),
e{k} AS MATERIALIZED (SELECT e.module, e.ord, e.via, e.name, e.binding, CASE WHEN e.via = 'import_from' THEN coalesce(x.target, e.target) ELSE e.target END AS target FROM e{k - 1} e LEFT JOIN x{k} x ON x.module = e.target AND x.name = e.name)"""
        )
    return ",\n".join(out)


CLOSED = _rounds(R.CAP)
NAMES = f", names AS MATERIALIZED (SELECT module, binding AS name, target FROM (SELECT *, row_number() OVER (PARTITION BY module, binding ORDER BY ord DESC, target DESC) AS r FROM e{R.CAP} WHERE binding IS NOT NULL) b WHERE r = 1)\n"
CLASS = "(SELECT id FROM c_symbols WHERE primitive = 'class')"
SHAPED = "(x.{0} LIKE 'external::%' AND len(string_split(x.{0}, '::')) >= 4)"
CONFIDENCE = (
    "CASE WHEN target NOT LIKE 'external::%' THEN 'exact' WHEN target LIKE 'external::pypi::unknown::%' THEN 'unresolved_internal'"
    " WHEN target LIKE 'external::unresolved::%::%' THEN 'unresolved_internal' WHEN target LIKE 'external::unresolved::%' THEN 'unresolved_receiver' ELSE 'external' END"
)
CODE = ("c_packages", "c_symbols", "c_imports")


def _names(packages: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    return R.bindings(R.reexports(imports, symbols, packages))


@on_code(f"{CLOSED} SELECT e.module, e.ord, e.via, e.name, e.binding, e.target, o.target <> e.target AS moved FROM e{R.CAP} e JOIN c_imports o ON o.module = e.module AND o.ord = e.ord AND o.via = e.via AND o.name IS NOT DISTINCT FROM e.name AND o.binding IS NOT DISTINCT FROM e.binding", *CODE)
def reexport_closure(packages: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """JON-33: imports led through chains and circles of packages to what they mean."""
    return R.reexports(imports, symbols, packages)


@on_code(
    f"""{CLOSED}{NAMES}, pre AS (SELECT b.src, b.ord, n.target, row_number() OVER (PARTITION BY b.src, b.ord ORDER BY length(n.name) DESC) AS r FROM c_bases b JOIN names n ON n.module = b.module AND (b.chain = n.name OR starts_with(b.chain, n.name || '.'))),
x AS (SELECT b.src, b.ord, b.name, pre.target AS via, (SELECT max(s.id) FROM c_symbols s WHERE s.module = pre.target AND s.name = b.name AND s.primitive = 'class') AS theirs,
  (SELECT max(s.id) FROM c_symbols s WHERE s.module = b.module AND s.name = b.name AND s.primitive = 'class') AS own, n.target AS bound
  FROM c_bases b LEFT JOIN pre ON pre.src = b.src AND pre.ord = b.ord AND pre.r = 1 LEFT JOIN names n ON n.module = b.module AND n.name = b.name),
t AS (SELECT src, ord, CASE WHEN via LIKE 'external::%' THEN via || '::' || name WHEN theirs IS NOT NULL THEN theirs WHEN own IS NOT NULL THEN own WHEN bound IN {CLASS} OR {SHAPED.format('bound')} THEN bound
  WHEN name IN ({', '.join(f"'{b}'" for b in R.BUILTINS)}) THEN 'external::builtins::' || name ELSE 'external::pypi::unknown::' || name END AS target FROM x)
SELECT src, ord, target, {CONFIDENCE} AS confidence FROM t""",
    *CODE,
    "c_bases",
)
def base_classes(packages: DataFrame, symbols: DataFrame, imports: DataFrame, bases: DataFrame) -> DataFrame:
    """JON-12: the classes that classes extend, by the longest bound prefix, the own module, imports, builtins."""
    return R.base_classes(bases, _names(packages, symbols, imports), symbols)


TYPED = f"""{CLOSED}{NAMES}, own AS (SELECT module, name, id AS target, 0 AS rank FROM c_symbols UNION ALL SELECT module, name, target, 1 FROM names),
meant AS (SELECT module, name, target FROM (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY rank) AS r FROM own) o WHERE r = 1),
x AS (SELECT e.*, m.target AS m FROM c_events e LEFT JOIN meant m ON m.module = e.module AND m.name = e.type),
given AS (SELECT fn, var, ord, CASE WHEN op = 'self' THEN owner WHEN op = 'annotate' AND type IN ({', '.join(f"'{b}'" for b in R.BUILTINS)}) THEN 'external::builtins::' || type WHEN m IN {CLASS} OR {SHAPED.format('m')} THEN m END AS class FROM x WHERE op <> 'call'),
calls AS (SELECT c.fn, c.module, c.ord, c.var, c.name, (SELECT arg_max(g.class, g.ord) FROM given g WHERE g.fn = c.fn AND g.var = c.var AND g.ord < c.ord AND g.class IS NOT NULL) AS class FROM c_events c WHERE c.op = 'call'),
r AS (SELECT c.*, m.target AS bare, n.target AS bound, k.primitive AS bare_kind, o.target AS symbol, ok.primitive AS symbol_kind, me.id AS method FROM calls c
  LEFT JOIN meant m ON m.module = c.module AND m.name = c.name LEFT JOIN (SELECT DISTINCT id, primitive FROM c_symbols) k ON k.id = m.target
  LEFT JOIN names n ON n.module = c.module AND n.name = c.var LEFT JOIN meant o ON o.module = n.target AND o.name = c.name AND o.target NOT LIKE 'external::%' LEFT JOIN (SELECT DISTINCT id, primitive FROM c_symbols) ok ON ok.id = o.target
  LEFT JOIN c_methods me ON me.class = c.class AND me.name = c.name),
t AS (SELECT fn, ord, var, bare AS target, CASE WHEN bare_kind = 'class' THEN 'instantiates' ELSE 'calls' END AS kind, 'function_call' AS via, true AS sure FROM r WHERE var IS NULL AND (bare_kind IN ('class', 'function') OR bare LIKE 'external::%')
  UNION ALL SELECT fn, ord, var, CASE WHEN class LIKE 'external::%' THEN class || '::' || name WHEN method IS NOT NULL THEN method ELSE 'external::unresolved::' || class || '.' || name END, 'calls', 'method_call', false FROM r WHERE var IS NOT NULL AND class IS NOT NULL
  UNION ALL SELECT fn, ord, var, CASE WHEN bound LIKE 'external::%' THEN bound || '::' || name WHEN symbol_kind IN ('class', 'function') THEN symbol ELSE 'external::unresolved::' || var || '.' || name END,
    CASE WHEN bound NOT LIKE 'external::%' AND symbol_kind = 'class' THEN 'instantiates' ELSE 'calls' END, 'method_call', coalesce(bound LIKE 'external::%', false) OR coalesce(symbol_kind IN ('class', 'function'), false) FROM r WHERE var IS NOT NULL AND class IS NULL)
"""


@on_code(f"{TYPED} SELECT fn, ord, target, kind, via, CASE WHEN sure THEN 'exact' ELSE {CONFIDENCE} END AS confidence FROM t", *CODE, "c_events", "c_methods")
def call_edges(packages: DataFrame, symbols: DataFrame, imports: DataFrame, events: DataFrame, methods: DataFrame) -> DataFrame:
    """JON-13: calls of functions, bare, on typed receivers and on imported names."""
    symbols = cut(symbols)
    names = cut(_names(packages, symbols, imports))
    edges = R.call_edges(events, names, symbols, methods)
    release(symbols, names)
    return edges


@on_code(f"{TYPED} SELECT fn, ord, class AS type FROM calls WHERE class IS NOT NULL", *CODE, "c_events", "c_methods")
def receiver_types(packages: DataFrame, symbols: DataFrame, imports: DataFrame, events: DataFrame, methods: DataFrame) -> DataFrame:
    """XTR-06: what a receiver is when it is called, after all typing events before the call."""
    return R.typed(events, _names(packages, symbols, imports), symbols).select("fn", "ord", F.explode("types").alias("type"))


@on_code(
    f"""{CLOSED}{NAMES}, known AS (SELECT n.module, n.name, s.schema FROM names n JOIN c_schema_of s ON s.class = n.target),
x AS (SELECT c.fn, c.ord, coalesce(d.schema, t.schema, '{R.NO_TABLE}') AS target FROM c_db_calls c LEFT JOIN known d ON d.module = c.module AND d.name = c.arg LEFT JOIN c_params p ON p.fn = c.fn AND p.name = c.arg LEFT JOIN known t ON t.module = c.module AND t.name = p.type WHERE c.sql IS NULL
  UNION ALL SELECT fn, ord, '{R.NO_TABLE}' FROM c_db_calls WHERE sql IS NOT NULL AND NOT regexp_matches(sql, '(?i)(from|join)')
  UNION ALL SELECT c.fn, c.ord, coalesce(s.id, 'external::unresolved::table::' || w.word) FROM (SELECT DISTINCT fn, ord, string_split(part, ' ')[2] AS word FROM (SELECT fn, ord, unnest(regexp_extract_all(sql, '(?i)(?:from|join) [a-z0-9]+')) AS part FROM c_db_calls) u) w JOIN c_db_calls c ON c.fn = w.fn AND c.ord = w.ord LEFT JOIN c_schemas s ON s.name = w.word)
SELECT fn, ord, target, CASE WHEN target LIKE 'external::%' THEN 'unresolved_receiver' ELSE 'exact' END AS confidence FROM x""",
    *CODE,
    "c_db_calls",
    "c_schema_of",
    "c_schemas",
    "c_params",
)
def db_access(packages: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, schema_of: DataFrame, schemas: DataFrame, params: DataFrame) -> DataFrame:
    """JON-10: the tables that database calls touch, by class, by a parameter's type or by the words of a SQL text."""
    return R.db_access(calls, _names(packages, symbols, imports), schema_of, schemas, params)


@on_code(
    """, plain AS (SELECT d.id, d.subkind, c.model, c.rank FROM c_domains d LEFT JOIN LATERAL (
    SELECT m.id AS model, CASE WHEN d.subkind = 'resource' AND m.tablename = d.table_name THEN CASE WHEN m.file = d.defined_in THEN 0 ELSE 1 END WHEN d.subkind = 'role' AND m.name = d.table_name AND m.file = d.defined_in THEN 2 ELSE 3 END AS rank
    FROM c_models m WHERE m.file = d.defined_in OR (d.subkind = 'resource' AND m.tablename = d.table_name) ORDER BY 2, 1 LIMIT 1) c ON true WHERE d.subkind <> 'relationship'),
walk AS (SELECT id, mediated_by AS pos, 1 AS hop FROM c_domains WHERE subkind = 'relationship' UNION ALL SELECT w.id, d.mediated_by, w.hop + 1 FROM walk w JOIN c_domains d ON d.id = w.pos AND d.subkind = 'relationship' WHERE w.hop < 3000 AND d.mediated_by <> w.id)
SELECT id, model, CASE WHEN model IS NULL THEN 'not_found' WHEN rank <= 1 THEN 'table_match' WHEN rank = 2 THEN 'class_name_match' ELSE 'defined_in' END AS how FROM plain
UNION ALL SELECT r.id, max(p.model), CASE WHEN max(p.model) IS NULL THEN 'not_found' ELSE 'via_mediated_by' END FROM c_domains r LEFT JOIN walk w ON w.id = r.id LEFT JOIN plain p ON p.id = w.pos WHERE r.subkind = 'relationship' GROUP BY r.id""",
    "c_domains",
    "c_models",
)
def domain_anchors(domains: DataFrame, models: DataFrame) -> DataFrame:
    """JON-23: the model behind each domain entry, through chains of relationships."""
    return R.anchors(domains, models)
