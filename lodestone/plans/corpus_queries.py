"""Queries of code analysis on the star schema read as facts: classification, caveats, ranking, links between families.

Each is also kept on the small code corpus of code_corpus.py, whose goldens the tests hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalars import unquote
from lodestone.operators import rank as R
from lodestone.operators import rules as C

from lodestone.storage import cut

from . import factview
from .code_corpus import CUES, facts, with_facts
from .codeview import view, with_views
from .registry import ORACLE, QUERIES

#: The same functions and SQL on the small corpus, for tests.
FIXED: dict[str, Callable[[SparkSession], DataFrame]] = {}
FIXED_SQL: dict[str, str] = {}


def on_facts(sql: str, *names: str, often: bool = False) -> Callable:
    """Registers a function of the named facts over the star schema; sql may use the same names. often: the facts are read many times, so they are written once."""

    def put(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views = [view(spark, sf_dir, n, factview.VIEWS) for n in names]
            return f(*(map(cut, views) if often else views))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        ORACLE[f.__name__] = with_views(sql, *names, texts=factview.VIEWS)
        FIXED[f.__name__] = lambda spark: f(*[facts(spark, n) for n in names])
        FIXED_SQL[f.__name__] = with_facts(sql, *names)
        return f

    return put


# --- classification ---------------------------------------------------------------------------------------

CLASSIFIED = """, fn AS (SELECT *, string_split(decorators, ',') AS decs, regexp_extract(path, '[^/]*$') AS file, string_split(name, '.')[-1] AS last FROM prims WHERE primitive = 'function'),
v1 AS (
  SELECT id, kind, 0 AS ord FROM prims WHERE kind IS NOT NULL
  UNION SELECT id, 'test', 1 FROM fn WHERE id IN (SELECT src FROM code_edges WHERE kind = 'tests') OR len(list_filter(decs, lambda x: starts_with(x, 'pytest.'))) > 0
    OR ((starts_with(file, 'test_') OR ends_with(file, '_test.py') OR contains(file, '.test.')) AND starts_with(name, 'test'))
  UNION SELECT id, 'hook', 2 FROM fn WHERE regexp_matches(last, '^use[A-Z]') AND id IN (SELECT src FROM code_edges WHERE kind = 'calls' AND dst IN ('external::npm::react::useState', 'external::npm::react::useEffect'))
  UNION SELECT id, 'component', 3 FROM fn WHERE regexp_matches(last, '^[A-Z]') AND returns_jsx
  UNION SELECT id, 'endpoint', 4 FROM fn WHERE list_has_any(decs, ['router.post', 'router.get', 'app.route'])
  UNION SELECT id, 'model', 5 FROM prims WHERE primitive = 'class' AND coalesce(kind, '') <> 'schema' AND id IN (SELECT src FROM code_edges WHERE kind = 'extends' AND string_split(dst, '::')[-1] IN ('Base', 'DeclarativeBase'))
    AND id IN (SELECT src FROM code_edges WHERE kind = 'references' AND via = '__tablename__' AND dst IN (SELECT id FROM prims WHERE kind = 'schema'))),
d1 AS (SELECT id, arg_min(kind, ord) AS kind FROM v1 GROUP BY id),
entries AS (SELECT id FROM d1 WHERE kind = 'endpoint'),
reached AS (SELECT id FROM entries UNION SELECT e.dst FROM reached r JOIN code_edges e ON e.src = r.id AND e.kind = 'calls'),
v2 AS (SELECT * FROM v1 UNION SELECT id, 'service', 6 FROM fn WHERE id IN (SELECT id FROM reached) AND id NOT IN (SELECT id FROM entries)
  AND id IN (SELECT src FROM code_edges WHERE kind IN ('db_access', 'queue_produce', 'webhook_publish', 'notification_send', 'file_storage_access'))),
known AS (SELECT DISTINCT id FROM v2),
below AS (SELECT e.dst AS id FROM known k JOIN code_edges e ON e.src = k.id AND e.kind = 'calls' WHERE e.dst NOT IN (SELECT id FROM known)
  UNION SELECT e.dst FROM below b JOIN code_edges e ON e.src = b.id AND e.kind = 'calls' WHERE e.dst NOT IN (SELECT id FROM known)),
v AS (SELECT * FROM v2 UNION SELECT id, 'util', 7 FROM fn WHERE id IN (SELECT id FROM below)),
d AS (SELECT id, arg_min(kind, ord) AS kind FROM v GROUP BY id),
o AS (SELECT d.id, d.kind, max(v.ord) AS rule_order FROM d JOIN v ON v.id = d.id AND v.kind = d.kind GROUP BY d.id, d.kind),
decided AS (SELECT p.id, o.kind, o.rule_order, coalesce((SELECT string_agg(v.kind, ',' ORDER BY v.ord) FROM v WHERE v.id = o.id AND v.kind <> o.kind AND v.ord > o.rule_order), '') AS conflicts FROM prims p LEFT JOIN o ON o.id = p.id)
"""


def _split(prims: DataFrame) -> DataFrame:
    return prims.withColumn("decorators", F.split("decorators", ","))


@on_facts(CLASSIFIED + "SELECT id, kind, rule_order, conflicts FROM decided", "prims", "code_edges", often=True)
def classify_code(prims: DataFrame, edges: DataFrame) -> DataFrame:
    """CLS-01 to CLS-08: seven rules in order, seeded by extractors' kinds, with conflicts."""
    return C.classify_corpus(_split(prims), edges, CUES)


@on_facts(CLASSIFIED + "SELECT p.id, coalesce(d.kind, p.kind, 'none') AS kind FROM prims p LEFT JOIN decided d ON d.id = p.id AND p.primitive = 'function'", "prims", "code_edges", often=True)
def effective_kinds(prims: DataFrame, edges: DataFrame) -> DataFrame:
    """CLS-10: a function's decision, else the extractor's kind, else none."""
    decided = C.classify_corpus(_split(prims), edges, CUES).select("id", F.col("kind").alias("decided"))
    decided = decided.join(prims.where("primitive = 'function'").select("id"), "id", "left_semi")
    return prims.join(decided, "id", "left").select("id", F.coalesce(C.effective_kind(F.col("decided"), F.col("kind")), F.lit("none")).alias("kind"))


@on_facts(
    """, heirs AS (SELECT src AS id FROM code_edges WHERE kind = 'extends' AND string_split(dst, '::')[-1] IN ('BaseModel', 'RootModel') UNION SELECT e.src FROM heirs h JOIN code_edges e ON e.dst = h.id AND e.kind = 'extends'),
c AS (SELECT p.id, 'pydantic_refs_not_extracted' AS caveat FROM prims p JOIN heirs h ON h.id = p.id WHERE p.primitive = 'class'
  UNION SELECT id, 'fastapi_depends_chain_not_traced' FROM prims WHERE primitive = 'function' AND method <> '' AND route <> ''
  UNION SELECT p.id, 'typed_receiver_unresolved' FROM prims p JOIN code_edges e ON e.src = p.id WHERE e.via = 'method_call' AND starts_with(e.dst, 'external::unresolved::'))
SELECT id, string_agg(caveat, ',' ORDER BY caveat) AS caveats FROM c GROUP BY id""",
    "prims",
    "code_edges",
    often=True,
)
def code_caveats(prims: DataFrame, edges: DataFrame) -> DataFrame:
    """CLS-09: the three detectors, stamped on each primitive."""
    return C.caveats(prims, edges).select("id", F.array_join("caveats", ",").alias("caveats"))


@on_facts("SELECT id, primitive FROM prims WHERE primitive NOT IN ('module', 'package', 'variable')", "prims")
def dossier_eligible(prims: DataFrame) -> DataFrame:
    """FLT-09: primitives that get a dossier."""
    return prims.where("coalesce(primitive, '') NOT IN ('module', 'package', 'variable')").select("id", "primitive")


# --- ranking of candidate processes -----------------------------------------------------------------------

RANK_FACTS = ("rule_claims", "code_nodes", "links", "steps", "flows")
COVERED = """, eps AS (SELECT s.id FROM steps s JOIN code_nodes n ON n.id = s.id WHERE n.kind = 'endpoint' UNION SELECT id FROM flows WHERE role = 'endpoint'),
hop AS (SELECT l.dst AS id FROM links l JOIN eps ON l.src = eps.id), hop2 AS (SELECT l.dst AS id FROM links l JOIN hop ON l.src = hop.id),
covered AS (SELECT id FROM steps UNION SELECT id FROM flows UNION SELECT id FROM hop UNION SELECT id FROM hop2),
w AS (SELECT id AS start, id AS node, 0 AS depth FROM code_nodes UNION SELECT w.start, l.dst, w.depth + 1 FROM w JOIN links l ON l.src = w.node WHERE w.depth < 4),
far AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY start, node HAVING min(depth) > 0),
r AS (SELECT far.*, n.kind AS to_kind FROM far LEFT JOIN code_nodes n ON n.id = far.node),
free AS (SELECT * FROM code_nodes WHERE id NOT IN (SELECT id FROM covered)),
mut AS (SELECT r.* FROM r JOIN code_nodes n ON n.id = r.start WHERE r.depth <= 2 AND n.kind = 'endpoint' AND string_split(n.id, '::')[1] IN ('POST', 'PUT', 'DELETE', 'PATCH'))
"""
SIGNALS = {
    "rank_rule_shape": "SELECT 'rule_shape_mismatch' AS signal, c.rule AS anchor, 0.6e0 + 0.1e0 * (count(DISTINCT n.kind) - 3) AS x, count(*) AS fan_out FROM rule_claims c LEFT JOIN code_nodes n ON n.id = c.id GROUP BY c.rule HAVING count(DISTINCT n.kind) >= 3 AND NOT bool_and(c.id IN (SELECT id FROM covered))",
    "rank_fan_in": "SELECT 'entrypoint_fan_in' AS signal, f.id AS anchor, 0.55e0 + 0.1e0 * (count(DISTINCT s.kind) - 3) + least(0.2e0, count(*) / 100e0) AS x, count(*) AS fan_out FROM free f JOIN links l ON l.dst = f.id LEFT JOIN code_nodes s ON s.id = l.src WHERE f.kind = 'endpoint' GROUP BY f.id HAVING count(DISTINCT s.kind) >= 3",
    "rank_forward_reach": "SELECT 'endpoint_forward_reach' AS signal, start AS anchor, 0.55e0 + 0.1e0 * (count(DISTINCT to_kind) - 3) + 0.15e0 * greatest(0, count(*) FILTER (to_kind = 'model') - 1) AS x, count(*) AS fan_out FROM mut WHERE start IN (SELECT id FROM free) GROUP BY start HAVING (count(DISTINCT to_kind) >= 3 OR count(*) FILTER (to_kind = 'model') >= 2) AND count(DISTINCT to_kind) FILTER (to_kind NOT IN ('test', 'component', 'schema', 'route_call')) >= 2",
    "rank_convergence": "SELECT 'convergence_on_' || f.kind AS signal, f.id AS anchor, CASE f.kind WHEN 'model' THEN 1e0 WHEN 'hook' THEN 0.85e0 WHEN 'service' THEN 0.65e0 ELSE 0.45e0 END * greatest(0.3e0, 1 - abs(count(*) - 5) / 12e0) AS x, count(*) AS fan_out FROM mut JOIN free f ON f.id = mut.node WHERE f.kind IN ('model', 'hook', 'service', 'schema') GROUP BY f.id, f.kind HAVING count(*) BETWEEN 3 AND 15",
    "rank_initiated": "SELECT CASE f.kind WHEN 'hook' THEN 'hook_initiated_flow' ELSE 'page_initiated_flow' END AS signal, f.id AS anchor, CASE f.kind WHEN 'hook' THEN 0.55e0 ELSE 0.75e0 END + 0.1e0 * greatest(0, 3 - min(r.depth) FILTER (r.to_kind = 'endpoint')) AS x, count(*) FILTER (r.to_kind IN ('endpoint', 'model')) AS fan_out FROM free f JOIN r ON r.start = f.id WHERE f.kind = 'hook' OR (f.kind = 'component' AND regexp_matches(f.path, '(^|/)page\\.(tsx|jsx)$')) GROUP BY f.id, f.kind HAVING count(*) FILTER (r.to_kind = 'endpoint') > 0 AND count(*) FILTER (r.to_kind = 'model') > 0",
    "rank_headless": "SELECT 'headless_initiated_flow' AS signal, f.id AS anchor, 0.6e0 + 0.05e0 * count(*) FILTER (r.to_kind = 'model') + CASE WHEN count(*) FILTER (r.to_kind = 'endpoint') > 0 THEN 0.1e0 ELSE 0e0 END AS x, count(*) AS fan_out FROM free f JOIN r ON r.start = f.id AND r.depth <= 3 WHERE coalesce(f.kind, '') NOT IN ('endpoint', 'component', 'test', 'hook', 'schema', 'model') AND f.id NOT IN (SELECT dst FROM links) AND NOT regexp_matches(f.path, '(^|/)tests/|(^|/)client\\.py$') GROUP BY f.id HAVING count(*) FILTER (r.to_kind = 'model') > 0",
}
_OUT = "SELECT signal, anchor, round_even(least(1e0, x), 6) AS confidence, fan_out FROM ("


def _ranking(name: str, doc: str, make: Callable) -> None:
    def run(claims, nodes, links, steps, flows):
        return make(claims, nodes, links, R.covered_ids(steps, flows, nodes, links))

    run.__name__, run.__doc__ = name, doc
    sql = SIGNALS.get(name) or " UNION ALL ".join(SIGNALS.values())
    on_facts(COVERED + _OUT + sql + ") s", *RANK_FACTS, often=True)(run)


_ranking("rank_rule_shape", "PRC-A: rules whose claims span kinds.", lambda c, n, e, own: R.rule_shape(c, n, own))
_ranking("rank_fan_in", "PRC-B: entry points that several kinds depend on.", lambda c, n, e, own: R.fan_in(n, e, own))
_ranking("rank_forward_reach", "PRC-C: entry points whose reach spans kinds or sinks.", lambda c, n, e, own: R.forward_reach(R.mutating_reach(n, e), n, own))
_ranking("rank_convergence", "PRC-D, PRC-E: nodes that a handful of entry points reach.", lambda c, n, e, own: R.convergence(R.mutating_reach(n, e), n, own))
_ranking("rank_initiated", "PRC-F: pages and hooks that start a flow.", lambda c, n, e, own: R.initiated(n, e, own))
_ranking("rank_headless", "PRC-G: jobs that nothing depends on.", lambda c, n, e, own: R.headless(n, e, own))
_ranking("rank_union", "SRT-03: the candidates of all signals.", R.candidates)


# --- links between families -------------------------------------------------------------------------------


@on_facts("SELECT rule, string_agg(DISTINCT process, ',' ORDER BY process) AS processes FROM enforced WHERE rule IS NOT NULL GROUP BY rule", "enforced")
def enforced_in_processes(enforced: DataFrame) -> DataFrame:
    """JON-07: the processes that enforce a rule, themselves or in a step."""
    return enforced.where("rule IS NOT NULL").groupBy("rule").agg(F.array_join(F.array_sort(F.collect_set("process")), ",").alias("processes"))


@on_facts(
    "SELECT l.owner AS src, p.id AS dst, '__tablename__' AS via FROM literals l JOIN prims p ON p.kind = 'schema' AND p.primitive = 'class' AND contains(p.id, '::schema::') AND string_split(p.id, '::schema::')[-1] = regexp_extract(l.value_text, '^[''\"](.*)[''\"]$', 1) WHERE ends_with(l.name, '.__tablename__')",
    "literals",
    "prims",
)
def model_schema_links(literals: DataFrame, prims: DataFrame) -> DataFrame:
    """JON-09: classes linked to the schema that their table name tells."""
    schemas = prims.where("kind = 'schema' AND primitive = 'class'").where(F.col("id").contains("::schema::"))
    schemas = schemas.select(F.col("id").alias("dst"), F.substring_index("id", "::schema::", -1).alias("table"))
    named = literals.where(F.col("name").endswith(".__tablename__")).select(F.col("owner").alias("src"), unquote(F.col("value_text")).alias("table"))
    return named.where("table <> ''").join(schemas, "table").select("src", "dst", F.lit("__tablename__").alias("via"))


@on_facts("SELECT id, string_agg(DISTINCT owner, ',' ORDER BY owner) AS owners FROM (SELECT id, rule AS owner FROM rule_claims UNION ALL SELECT id, process FROM steps) x GROUP BY id", "rule_claims", "steps")
def claims_nested(claims: DataFrame, steps: DataFrame) -> DataFrame:
    """ARR-03: claims of rules and, two levels down, of the steps of processes, by what they claim."""
    nested = steps.groupBy("process").agg(F.collect_list(F.struct("step", F.array("id").alias("claims"))).alias("steps"))
    inner = nested.select("process", F.explode("steps").alias("s")).select(F.explode("s.claims").alias("id"), F.col("process").alias("owner"))
    both = claims.select("id", F.col("rule").alias("owner")).unionByName(inner)
    return both.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("owners"))


@on_facts("SELECT rule, bool_and(id IN (SELECT id FROM code_nodes)) AS all_known, bool_or(id IN (SELECT id FROM code_nodes WHERE kind = 'model')) AS any_model FROM rule_claims GROUP BY rule", "rule_claims", "code_nodes")
def claims_all_any(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """ARR-02: whether all claims of a rule are known, and any is a model."""
    c = claims.join(nodes.select("id", F.coalesce("kind", F.lit("?")).alias("kind")), "id", "left")
    return c.groupBy("rule").agg(F.every(F.col("kind").isNotNull()).alias("all_known"), F.some(F.coalesce(F.col("kind") == "model", F.lit(False))).alias("any_model"))


# --- orders of lists --------------------------------------------------------------------------------------

#: The order of rules by status, of flags by severity.
STATUS, SEVERITY = ("stub", "llm_drafted", "human_reviewed"), ("critical", "high", "medium", "low", "info")


def _place(column: str, order: tuple[str, ...], other: int) -> F.Column:
    return F.coalesce(*[F.when(F.col(column) == v, F.lit(k)) for k, v in enumerate(order)], F.lit(other))


@on_facts("SELECT r.rule, r.status, count(c.id) AS claims, CASE r.status WHEN 'stub' THEN 0 WHEN 'llm_drafted' THEN 1 WHEN 'human_reviewed' THEN 2 ELSE 99 END AS place FROM rules r LEFT JOIN rule_claims c ON c.rule = r.rule GROUP BY r.rule, r.status", "rules", "rule_claims")
def rule_rank(rules: DataFrame, claims: DataFrame) -> DataFrame:
    """SRT-02: rules to author next: by status, then by claims, most first."""
    n = claims.groupBy("rule").agg(F.count("*").alias("claims"))
    ranked = rules.join(n, "rule", "left").select("rule", "status", F.coalesce("claims", F.lit(0)).alias("claims"), _place("status", STATUS, 99).alias("place"))
    return ranked.orderBy("place", F.desc("claims"), "rule")


@on_facts("SELECT coalesce(path, '(no path)') AS path, path IS NULL AS last, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT id, nullif(path, 'schema.sql') AS path FROM prims) p GROUP BY 1, 2", "prims")
def grouped_by_path(prims: DataFrame) -> DataFrame:
    """SRT-09: primitives by path, those without one last."""
    p = prims.select("id", F.nullif("path", F.lit("schema.sql")).alias("path"))
    p = p.groupBy(F.coalesce("path", F.lit("(no path)")).alias("path"), F.col("path").isNull().alias("last")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return p.orderBy("last", "path")


@on_facts("SELECT id, code, severity, row_number() OVER (PARTITION BY id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END, code) AS place FROM (SELECT code, severity, unnest(string_split(affected, ',')) AS id FROM flags) f", "flags")
def warnings_of_nodes(flags: DataFrame) -> DataFrame:
    """FLT-13: the flags that mention a node, the most severe first."""
    from pyspark.sql import Window

    rows = flags.select("code", "severity", F.explode(F.split("affected", ",")).alias("id"))
    return rows.select("id", "code", "severity", F.row_number().over(Window.partitionBy("id").orderBy(_place("severity", SEVERITY, 5), "code")).alias("place"))
