"""Validators, composite reads and change tracking on the graph view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import changes
from lodestone.session import table

from . import graphview as G
from .graph_queries import TIERED_Q
from .registry import query, shared

# --- validators -------------------------------------------------------------------------------------------

shared(
    "primitive_violations",
    "SELECT id, 'missing fields' AS what FROM {nodes} WHERE id IS NULL OR kind IS NULL OR name IS NULL OR hash IS NULL OR repo IS NULL"
    " UNION ALL SELECT id, 'primitive' FROM {nodes} WHERE kind NOT IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders')"
    " UNION ALL SELECT id, 'owner' FROM {nodes} WHERE kind = 'part' AND name LIKE '%.%' AND repo = ''"
    " UNION ALL SELECT src, 'confidence' FROM {edges} WHERE confidence NOT IN ('exact', 'fuzzy', 'external', 'unresolved_internal', 'unresolved_receiver', 'dynamic')",
)
shared("corpus_report", "SELECT 'duplicate' AS what, count(*) AS n FROM (SELECT id FROM {nodes} GROUP BY id HAVING count(*) > 1) d UNION ALL SELECT 'dangling', count(*) FROM {edges} e LEFT JOIN {nodes} n ON n.id = e.dst WHERE n.id IS NULL UNION ALL SELECT 'orphan_claim', count(*) FROM {claims} c LEFT JOIN {nodes} n ON n.id = c.target WHERE n.id IS NULL UNION ALL SELECT 'nodes', count(*) FROM {nodes} UNION ALL SELECT 'edges', count(*) FROM {edges}")
shared("step_transition_ri", "SELECT c.conv_id, c.turn, c.turn + 1 AS to_turn FROM {conversations} c LEFT JOIN {conversations} n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 WHERE n.turn IS NULL")
shared(
    "required_sections",
    "SELECT doc_id, section FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text || chr(10) || '## Plain definition' WHEN doc_id % 4 = 1 THEN text || chr(10) || '## They can' ELSE text END AS text FROM {documents}) d"
    " CROSS JOIN (SELECT '## Plain definition' AS section UNION ALL SELECT '## They can') s WHERE NOT contains(d.text, s.section)",
)

# --- composite reads --------------------------------------------------------------------------------------

shared("code_context", f"WITH {TIERED_Q} SELECT t.id, t.kind, t.tier, e.src, e.kind AS edge_kind, e.confidence FROM tiered t LEFT JOIN {{edges}} e ON e.dst = t.id WHERE t.kind = 'supplier'")
shared("rule_context", "SELECT c.owner_id, n.kind, n.repo, count(*) AS n_claims, count(DISTINCT n.path) AS n_paths FROM {claims} c JOIN {nodes} n ON n.id = c.target GROUP BY c.owner_id, n.kind, n.repo")
shared("direct_dependents_split", "SELECT dst AS id, sum(CASE confidence WHEN 'exact' THEN 1 ELSE 0 END) AS verified, sum(CASE confidence WHEN 'exact' THEN 0 ELSE 1 END) AS probable FROM {edges} GROUP BY dst")
shared("trust_banners", "SELECT kind, CASE WHEN gaps * 1.0E0 / n > 0.3E0 THEN 'low' WHEN gaps > 0 THEN 'medium' ELSE 'high' END AS trust FROM (SELECT kind, count(*) AS n, sum(CASE confidence WHEN 'external' THEN 1 ELSE 0 END) AS gaps FROM {edges} GROUP BY kind) x")
shared("longest_root", "SELECT id, root FROM (SELECT n.id, r.root, row_number() OVER (PARTITION BY n.id ORDER BY length(r.root) DESC, r.root) AS place FROM {nodes} n JOIN (SELECT r_name AS root FROM {region} UNION SELECT substr(r_name, 1, 2) FROM {region}) r ON n.repo LIKE r.root || '%') x WHERE place = 1")
shared("node_titles", "SELECT t.event_id, c.c_name AS title FROM {telemetry} t JOIN {customer} c ON c.c_custkey = t.node_id WHERE t.kind = 'injection'")
shared("windowed_counts", f"SELECT sum(CASE WHEN kind = 'drift' AND ts >= TIMESTAMP '{G.NOW}' - INTERVAL '7' DAY THEN 1 ELSE 0 END) AS drift_7d, sum(CASE WHEN kind = 'injection' AND ts >= TIMESTAMP '{G.NOW}' - INTERVAL '30' DAY THEN 1 ELSE 0 END) AS injections_30d, count(*) AS n FROM {{telemetry}}")
shared("today_delta", f"SELECT event_type, count(*) AS n FROM {{events}} WHERE ts >= date_trunc('day', TIMESTAMP '{G.NOW}' - INTERVAL '2' DAY) GROUP BY event_type")
shared("claim_kinds", "SELECT c.owner_id, count(DISTINCT n.kind) AS kinds, min(n.kind) AS first_kind, max(n.kind) AS last_kind FROM {claims} c JOIN {nodes} n ON n.id = c.target GROUP BY c.owner_id")
shared("health_bundle", "SELECT t.n AS telemetry, c.n AS claims, o.n AS orphans FROM (SELECT count(*) AS n FROM {telemetry}) t CROSS JOIN (SELECT count(*) AS n FROM {claims}) c CROSS JOIN (SELECT count(*) AS n FROM {claims} c LEFT JOIN {nodes} n ON n.id = c.target WHERE n.id IS NULL) o")
shared("commit_summary_topk", "SELECT o_custkey, count(*) AS commits, bround(sum(o_totalprice), 2) AS impact FROM {orders} GROUP BY o_custkey ORDER BY commits DESC, o_custkey LIMIT 10")
shared("recent_history", "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM {orders}) x WHERE place <= 20")
shared("calibration_delta", "SELECT label, q, q - lag(q) OVER (ORDER BY label) AS delta FROM (SELECT label, count(*) AS q FROM {embeddings} GROUP BY label) x")
shared("table_uses", "SELECT 'orders' AS t, kind, count(DISTINCT src) AS users FROM {edges} WHERE src LIKE 'orders::%' GROUP BY kind")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS said FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def transcript_text(spark: SparkSession, d: str) -> DataFrame:
    """CMP-09: what the assistant said in each conversation, in order."""
    said = table(spark, d, "conversations").where("role = 'assistant'")
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return said.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("said"))


@query("SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'changed' ELSE 'same' END AS change FROM (SELECT id, hash FROM nodes WHERE kind <> 'region') o FULL JOIN (SELECT id, CASE WHEN kind = 'nation' THEN md5(name || '!') ELSE hash END AS hash FROM nodes WHERE kind <> 'supplier') n ON o.id = n.id")
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    """SNK-03: what a change-only write has to write."""
    nodes = G.nodes(spark, d)
    old = nodes.where("kind <> 'region'").select("id", "hash")
    new = nodes.where("kind <> 'supplier'").select("id", F.when(F.col("kind") == "nation", F.md5(F.concat("name", F.lit("!")))).otherwise(F.col("hash")).alias("hash"))
    return changes.compare(old, new)


@query("SELECT id, CASE WHEN kind = 'region' THEN 'archived' ELSE 'live' END AS state FROM nodes")
def archived_split(spark: SparkSession, d: str) -> DataFrame:
    """SNK-08: live rows and tombstones."""
    nodes = G.nodes(spark, d)
    live, gone = changes.archive(nodes, nodes.where("kind = 'region'").select("id"), "no longer listed")
    return live.select("id", F.lit("live").alias("state")).unionByName(gone.select("id", F.lit("archived").alias("state")))


@query("SELECT n.id, '# ' || n.name || chr(10) || 'kind: ' || n.kind AS body FROM nodes n WHERE n.kind IN ('supplier', 'nation') AND NOT EXISTS (SELECT 1 FROM claims c WHERE c.target = n.id)")
def dossier_stubs(spark: SparkSession, d: str) -> DataFrame:
    """SNK-09: stubs for nodes that have no dossier."""
    nodes = G.nodes(spark, d).where(F.col("kind").isin("supplier", "nation"))
    return changes.stubs(nodes, G.claims(spark, d).select(F.col("target").alias("id")))
