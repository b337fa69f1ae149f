"""Queries on the graph view: traversal, joins, aggregates, windows, claims, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import claims as C
from lodestone.operators import classify as K
from lodestone.operators import traverse as T
from lodestone.session import table

from . import graphview as G
from .registry import query, shared

TIERED = "tiered AS (SELECT n.id, n.kind, n.name, n.repo, n.path, coalesce(e.c, 0) AS inbound_count, CASE WHEN coalesce(e.c, 0) >= 10 THEN 'A' WHEN coalesce(e.c, 0) >= 3 THEN 'B' ELSE 'C' END AS tier FROM nodes n LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) e ON n.id = e.dst)"
TIERED_Q = TIERED.replace("FROM nodes", "FROM {nodes}").replace("FROM edges", "FROM {edges}")

WALK = """, walk AS (
  SELECT 'region::0' AS node, 0 AS depth, 'region::0' AS path
  UNION ALL SELECT e.src, w.depth + 1, w.path || '>' || e.src FROM walk w JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.dst = w.node WHERE w.depth < 3),
least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
first AS (SELECT w.node, w.depth, min(w.path) AS path FROM walk w JOIN least l ON w.node = l.node AND w.depth = l.depth GROUP BY w.node, w.depth)
"""


def _seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(WALK + "SELECT node, depth, path FROM first", recursive=True)
def impact_depth3(spark: SparkSession, d: str) -> DataFrame:
    """TRV-01, TRV-02, JON-01: what depends on region 0 within three hops, by which path."""
    return T.walk(_seed(spark, "region::0"), G.edges(spark, d), 3)


@query(WALK + "SELECT n.kind, f.depth, count(*) AS n, sum(CASE WHEN f.depth = 1 THEN 1 ELSE 0 END) AS direct FROM first f JOIN nodes n ON n.id = f.node WHERE f.depth > 0 GROUP BY n.kind, f.depth", recursive=True)
def rollup_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """TRV-03: the same by kind and distance."""
    seen = T.walk(_seed(spark, "region::0"), G.edges(spark, d), 3).where("depth > 0")
    known = seen.join(G.nodes(spark, d).select(F.col("id").alias("node"), "kind"), "node")
    return known.groupBy("kind", "depth").agg(F.count("*").alias("n"), F.sum((F.col("depth") == 1).cast("long")).alias("direct"))


@query(", " + TIERED + " SELECT id, kind, inbound_count, tier FROM tiered")
def fan_in_tier(spark: SparkSession, d: str) -> DataFrame:
    """AGG-01, SRC-04: in-degree and tier of every node."""
    return C.tiers(G.nodes(spark, d), G.edges(spark, d)).select("id", "kind", "inbound_count", "tier")


@query("SELECT n.id, count(e.src) AS inbound_count FROM nodes n LEFT JOIN (SELECT * FROM edges WHERE kind <> 'extends') e ON e.dst = n.id GROUP BY n.id")
def inbound_without_containment(spark: SparkSession, d: str) -> DataFrame:
    """AGG-02: in-degree without edges of containment."""
    return C.tiers(G.nodes(spark, d), G.edges(spark, d), skip=("extends",)).select("id", "inbound_count")


@query(""", closed AS (SELECT 'part::' || p_partkey AS node FROM part WHERE p_size = 1 UNION SELECT c.dst FROM closed JOIN calls c ON c.src = closed.node) SELECT node FROM closed""", recursive=True)
def service_closure(spark: SparkSession, d: str) -> DataFrame:
    """TRV-04: all that the entry points (parts of size 1) reach over calls."""
    seeds = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("id"))
    return T.closure(seeds, G.calls(spark, d))


@query(""", closed AS (SELECT 'part::' || p_partkey AS node FROM part WHERE p_size = 1 UNION SELECT c.dst FROM closed JOIN calls c ON c.src = closed.node JOIN part ON 'part::' || p_partkey = c.dst WHERE p_type <> 'PROMO') SELECT node FROM closed WHERE node NOT IN (SELECT 'part::' || p_partkey FROM part WHERE p_size = 1)""", recursive=True)
def util_closure(spark: SparkSession, d: str) -> DataFrame:
    """TRV-05: reached from classified nodes without entering others that are classified already."""
    part = table(spark, d, "part").withColumn("id", F.concat(F.lit("part::"), F.col("p_partkey").cast("string")))
    seeds = part.where("p_size = 1").select("id")
    found = T.closure(seeds, G.calls(spark, d), barrier=part.where("p_type = 'PROMO'").select("id"))
    return found.join(seeds.select(F.col("id").alias("node")), "node", "left_anti")


REACH = """, walk AS (SELECT 'part::' || p_partkey AS start, 'part::' || p_partkey AS node, 0 AS depth FROM part WHERE p_size <= 5
  UNION ALL SELECT w.start, c.dst, w.depth + 1 FROM walk w JOIN calls c ON c.src = w.node WHERE w.depth < 3),
reached AS (SELECT start, node, min(depth) AS depth FROM walk GROUP BY start, node) """


def _reach(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "part").where("p_size <= 5").select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("id"))
    return T.reach(seeds, G.calls(spark, d), 3)


@query(REACH + "SELECT start, node, depth FROM reached", recursive=True)
def multi_source_reach(spark: SparkSession, d: str) -> DataFrame:
    """TRV-06: each entry point's reach within three hops, with the first depth."""
    return _reach(spark, d)


@query(REACH + "SELECT node, count(DISTINCT start) AS n_starts, min(depth) AS nearest FROM reached WHERE depth > 0 GROUP BY node HAVING count(DISTINCT start) > 1", recursive=True)
def convergence(spark: SparkSession, d: str) -> DataFrame:
    """TRV-09: nodes that several entry points meet in."""
    return _reach(spark, d).where("depth > 0").groupBy("node").agg(F.countDistinct("start").alias("n_starts"), F.min("depth").alias("nearest")).where("n_starts > 1")


@query(""", h AS (SELECT 'part::' || p_partkey AS node, 0 AS hop FROM part WHERE p_type = 'PROMO' UNION ALL SELECT c.dst, h.hop + 1 FROM h JOIN calls c ON c.src = h.node WHERE h.hop < 2) SELECT node, min(hop) AS hop FROM h GROUP BY node""", recursive=True)
def coverage_expansion(spark: SparkSession, d: str) -> DataFrame:
    """TRV-07: covered nodes and two hops from them."""
    seeds = table(spark, d, "part").where("p_type = 'PROMO'").select(F.concat(F.lit("part::"), F.col("p_partkey").cast("string")).alias("id"))
    return T.hops(seeds, G.calls(spark, d), 2)


@query(""", up AS (SELECT id AS start, id AS node FROM nodes WHERE kind IN ('customer', 'supplier', 'nation') UNION SELECT u.start, e.dst FROM up u JOIN edges e ON e.src = u.node AND e.kind IN ('extends', 'references')) SELECT DISTINCT up.start FROM up JOIN nodes n ON n.id = up.node WHERE n.kind = 'region' AND n.name = 'ASIA'""", recursive=True)
def inheritance_chain(spark: SparkSession, d: str) -> DataFrame:
    """TRV-08: nodes whose chain of bases ends in ASIA."""
    base = G.nodes(spark, d).where("kind = 'region' AND name = 'ASIA'").select("id")
    up = G.edges(spark, d).where(F.col("kind").isin("extends", "references"))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return T.closure(base, down).join(base.withColumnRenamed("id", "node"), "node", "left_anti").select(F.col("node").alias("start"))


# --- joins ------------------------------------------------------------------------------------------------


@query("SELECT owner_id, target FROM claims c WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = c.target)")
def orphan_edges_anti(spark: SparkSession, d: str) -> DataFrame:
    """JON-03, JON-06: references to nodes that do not exist."""
    return G.claims(spark, d).join(G.nodes(spark, d).select(F.col("id").alias("target")), "target", "left_anti").select("owner_id", "target")


STATE = "states AS (SELECT c.owner_id, c.target, c.remote_hash, n.hash AS current_hash, CASE WHEN n.hash IS NULL THEN 'orphan' WHEN c.remote_hash <> n.hash THEN 'stale' ELSE 'fresh' END AS state FROM claims c LEFT JOIN nodes n ON n.id = c.target)"


@query(", " + STATE + " SELECT owner_id, target, remote_hash, current_hash, state FROM states")
def claims_stale_orphan(spark: SparkSession, d: str) -> DataFrame:
    """JON-05: every claim's state, with the old and the current hash."""
    return C.claim_state(G.claims(spark, d), G.nodes(spark, d)).select("owner_id", "target", "remote_hash", "current_hash", "state")


@query(", " + STATE + " SELECT owner_id, count(*) AS n_claims, sum(CASE state WHEN 'orphan' THEN 1 ELSE 0 END) AS orphans, sum(CASE state WHEN 'stale' THEN 1 ELSE 0 END) AS stale, round_even(100.0 * sum(CASE state WHEN 'fresh' THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS fresh_pct FROM states GROUP BY owner_id")
def health_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AGG-15, AGG-16, AGG-17, JON-30: claims of each rule by state."""
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    return C.claim_state(G.claims(spark, d), G.nodes(spark, d)).groupBy("owner_id").agg(F.count("*").alias("n_claims"), n("orphan").alias("orphans"), n("stale").alias("stale"), F.bround(100.0 * n("fresh") / F.count("*"), 6).alias("fresh_pct"))


@query("SELECT n.repo, n.path, c.owner_id, count(*) AS n_claims FROM claims c JOIN nodes n ON n.id = c.target GROUP BY n.repo, n.path, c.owner_id")
def claims_by_file(spark: SparkSession, d: str) -> DataFrame:
    """JON-08, JON-24: owners of claims by file."""
    at = G.nodes(spark, d).select(F.col("id").alias("target"), "repo", "path")
    return G.claims(spark, d).join(at, "target").groupBy("repo", "path", "owner_id").agg(F.count("*").alias("n_claims"))


@query("SELECT a.id, b.id AS sibling FROM nodes a JOIN nodes b ON a.repo = b.repo AND a.path = b.path AND a.id <> b.id WHERE a.kind = 'supplier' AND b.kind = 'supplier'")
def siblings_self_join(spark: SparkSession, d: str) -> DataFrame:
    """JON-20: other suppliers of the same file."""
    s = G.nodes(spark, d).where("kind = 'supplier'").select("id", "repo", "path")
    return s.join(s.withColumnRenamed("id", "sibling"), ["repo", "path"]).where("id <> sibling").select("id", "sibling")


@query("SELECT s.repo AS src_repo, t.repo AS dst_repo, e.kind, count(*) AS edge_count FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes t ON t.id = e.dst WHERE s.repo <> t.repo GROUP BY s.repo, t.repo, e.kind")
def cross_repo_edges(spark: SparkSession, d: str) -> DataFrame:
    """JON-21, AGG-09: edges between repositories."""
    n = G.nodes(spark, d).select("id", "repo")
    e = G.edges(spark, d).join(n.select(F.col("id").alias("src"), F.col("repo").alias("src_repo")), "src").join(n.select(F.col("id").alias("dst"), F.col("repo").alias("dst_repo")), "dst")
    return e.where("src_repo <> dst_repo").groupBy("src_repo", "dst_repo", "kind").agg(F.count("*").alias("edge_count"))


@query("SELECT n.id, n.repo, n.path FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.id) AND n.kind IN ('customer', 'part', 'supplier')")
def dead_code_anti(spark: SparkSession, d: str) -> DataFrame:
    """JON-26, SRT-10: nodes that nothing depends on."""
    n = G.nodes(spark, d).where(F.col("kind").isin("customer", "part", "supplier"))
    return n.join(G.edges(spark, d).select(F.col("dst").alias("id")), "id", "left_anti").select("id", "repo", "path")


@query("SELECT c.owner_id, c.target FROM claims c WHERE c.target LIKE 'customer::%' AND EXISTS (SELECT 1 FROM nodes m WHERE m.kind = 'customer') AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.id = c.target)")
def domain_orphans_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """JON-28: claims in a kind that has a manifest (semi) without being in it (anti)."""
    n = G.nodes(spark, d)
    claim = G.claims(spark, d).where("target LIKE 'customer::%'").withColumn("kind", F.split_part("target", F.lit("::"), F.lit(1)))
    return claim.join(n.select("kind").distinct(), "kind", "left_semi").join(n.select(F.col("id").alias("target")), "target", "left_anti").select("owner_id", "target")


shared("edge_taxonomy_violations", "SELECT e.src, e.dst, e.kind FROM {edges} e JOIN {nodes} s ON s.id = e.src JOIN {nodes} t ON t.id = e.dst WHERE NOT ((e.kind = 'extends' AND s.kind = 'nation' AND t.kind = 'region') OR (e.kind = 'references' AND t.kind = 'nation') OR (e.kind = 'calls' AND s.kind = 'orders') OR (e.kind = 'reads' AND t.kind = 'supplier' AND e.confidence <> 'external') OR (e.kind = 'instantiates' AND t.kind = 'part'))")
shared("rule_fan_out", "SELECT owner_id, count(*) AS claim_count, CASE WHEN count(*) >= 1000 THEN true ELSE false END AS over FROM {claims} GROUP BY owner_id")
shared("relationships_of_entity", "SELECT dst AS id, 'in' AS direction, src AS other, kind FROM {edges} WHERE dst LIKE 'nation::%' UNION ALL SELECT src, 'out', dst, kind FROM {edges} WHERE src LIKE 'nation::%'")
shared("test_coverage_ratio", "SELECT n.kind, count(*) AS n, sum(CASE WHEN t.target IS NULL THEN 0 ELSE 1 END) AS tested, bround(100.0E0 * sum(CASE WHEN t.target IS NULL THEN 0 ELSE 1 END) / count(*), 6) AS pct FROM {nodes} n LEFT JOIN (SELECT DISTINCT target FROM {claims}) t ON t.target = n.id GROUP BY n.kind")

# --- aggregates -------------------------------------------------------------------------------------------

shared("coverage_matrix", f"WITH {TIERED_Q}, claimed AS (SELECT DISTINCT target FROM {{claims}}) SELECT t.kind, t.tier, CASE WHEN c.target IS NULL THEN 'missing' ELSE 'covered' END AS state, count(*) AS n FROM tiered t LEFT JOIN claimed c ON c.target = t.id GROUP BY t.kind, t.tier, CASE WHEN c.target IS NULL THEN 'missing' ELSE 'covered' END")
shared("coverage_pct", f"WITH {TIERED_Q}, claimed AS (SELECT DISTINCT target FROM {{claims}}) SELECT t.kind, t.tier, count(*) AS n, bround(100.0E0 * count(c.target) / count(*), 6) AS covered_pct FROM tiered t LEFT JOIN claimed c ON c.target = t.id GROUP BY t.kind, t.tier")
shared("confidence_histogram", "SELECT kind, confidence, count(*) AS n, bround(100.0E0 * count(*) / sum(count(*)) OVER (PARTITION BY kind), 6) AS pct FROM {edges} GROUP BY kind, confidence")
shared("gap_groups_topk", "SELECT kind, confidence, count(*) AS n FROM {edges} WHERE confidence <> 'exact' GROUP BY kind, confidence ORDER BY n DESC, kind, confidence LIMIT 10")
shared("repo_summary", f"WITH {TIERED_Q} SELECT repo, count(*) AS node_count, count(DISTINCT kind) AS kinds, sum(CASE WHEN inbound_count = 0 THEN 1 ELSE 0 END) AS dead, bround(100.0E0 * sum(CASE WHEN inbound_count = 0 THEN 1 ELSE 0 END) / count(*), 6) AS dead_pct, sum(CASE WHEN tier = 'A' THEN 1 ELSE 0 END) AS tier_a FROM tiered GROUP BY repo")
shared("repo_rollup", "SELECT s.repo, count(DISTINCT s.path) AS areas, count(DISTINCT t.repo) AS outbound_repos, count(*) AS out_edges, sum(CASE WHEN s.repo <> t.repo THEN 1 ELSE 0 END) AS cross_edges FROM {edges} e JOIN {nodes} s ON s.id = e.src JOIN {nodes} t ON t.id = e.dst GROUP BY s.repo")
shared("kind_summary", f"WITH {TIERED_Q} SELECT kind, count(*) AS n, sum(inbound_count) AS fan_out, max(inbound_count) AS most, count(DISTINCT repo) AS repos FROM tiered GROUP BY kind")
shared("cross_cutting_summary", "SELECT n.path, count(DISTINCT n.repo) AS repos, count(DISTINCT n.kind) AS kinds, count(*) AS n FROM {nodes} n GROUP BY n.path HAVING count(DISTINCT n.kind) > 1")
shared("salient_inbound", "SELECT dst, kind, confidence, n FROM (SELECT dst, kind, confidence, count(*) AS n, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, kind, confidence) AS r FROM {edges} GROUP BY dst, kind, confidence) x WHERE r <= 8")
shared("corpus_probe", "SELECT 'node' AS what, kind, count(*) AS n FROM {nodes} GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM {edges} GROUP BY kind UNION ALL SELECT 'gap', kind, count(*) FROM {edges} WHERE confidence = 'external' GROUP BY kind")
shared("reverse_index", "SELECT dst, count(*) AS n, count(DISTINCT src) AS sources, min(src) AS first_source, max(src) AS last_source FROM {edges} GROUP BY dst")
shared("resolver_hit_rate", "SELECT kind, sum(CASE WHEN confidence = 'external' THEN 0 ELSE 1 END) AS hits, count(*) AS n, bround(sum(CASE WHEN confidence = 'external' THEN 0 ELSE 1 END) * 1.0E0 / count(*), 6) AS rate FROM {edges} GROUP BY kind")


@query("SELECT part, count(DISTINCT p_partkey) AS n_owners FROM (SELECT p_partkey, unnest(string_split(lower(rtrim(trim(split_part(m, '(', 1)), ',')), ' and ')) AS part FROM (SELECT p_partkey, p_type || CASE WHEN p_size % 2 = 0 THEN ' and ' || p_brand ELSE '' END || ' (' || p_brand || ')' AS m FROM part) a) b WHERE trim(part) <> '' GROUP BY part HAVING count(DISTINCT p_partkey) > 1")
def mediation_collision(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, STR-06: mechanisms that several owners name."""
    m = F.concat(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" and "), F.col("p_brand"))).otherwise(""), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    part = table(spark, d, "part").select("p_partkey", m.alias("m"))
    return C.collisions(part.select("p_partkey", F.explode(C.mechanisms("m")).alias("part")), "part", "p_partkey")


@query("SELECT slug, count(DISTINCT id) AS n_owners FROM (SELECT id, regexp_replace(lower(name), '[^a-z]+', '_', 'g') AS slug FROM nodes) x GROUP BY slug HAVING count(DISTINCT id) > 1")
def slug_collision(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14, STR-02: slugs that several nodes share."""
    return C.collisions(G.nodes(spark, d).select("id", F.regexp_replace(F.lower("name"), "[^a-z]+", "_").alias("slug")), "slug", "id")


@query(
    "SELECT id, pinned, current, current - pinned AS delta, round_even(part, 4) AS pct, (current <> pinned AND (abs(current - pinned) >= 3 OR part >= 0.25)) AS drifts FROM"
    " (SELECT *, abs(current - pinned)::DOUBLE / greatest(pinned, 1) AS part FROM (SELECT p_partkey AS id, p_size AS pinned, count(l_orderkey)::INTEGER AS current FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size) x) y"
)
def inbound_drift(spark: SparkSession, d: str) -> DataFrame:
    """AGG-24: change of in-degree against a pinned count."""
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    pairs = table(spark, d, "part").join(n, "p_partkey", "left").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("pinned"), F.coalesce("n", F.lit(0)).cast("int").alias("current"))
    return C.drift(pairs)


# --- windows, sorts, sets ---------------------------------------------------------------------------------

shared("review_queue_prev_next", f"WITH {TIERED_Q} SELECT id, row_number() OVER (PARTITION BY kind, repo ORDER BY inbound_count DESC, id) AS place, lag(id) OVER (PARTITION BY kind, repo ORDER BY inbound_count DESC, id) AS prev, lead(id) OVER (PARTITION BY kind, repo ORDER BY inbound_count DESC, id) AS nxt FROM tiered WHERE tier <> 'C'")
shared("per_kind_cap", "SELECT src, kind, dst, r FROM (SELECT src, kind, dst, row_number() OVER (PARTITION BY src, kind ORDER BY dst) AS r FROM {edges}) x WHERE r <= 5")
# The count is an aggregate of its own: beside row_number it would keep Spark from limiting groups before the shuffle.
shared("per_kind_summary", f"WITH {TIERED_Q} SELECT x.kind, id, inbound_count, n FROM (SELECT kind, id, inbound_count, row_number() OVER (PARTITION BY kind ORDER BY inbound_count DESC, id) AS r FROM tiered) x JOIN (SELECT kind, count(*) AS n FROM {{nodes}} GROUP BY kind) c ON c.kind = x.kind WHERE r <= 3", f"WITH {TIERED_Q} SELECT kind, id, inbound_count, n FROM (SELECT kind, id, inbound_count, row_number() OVER (PARTITION BY kind ORDER BY inbound_count DESC, id) AS r, count(*) OVER (PARTITION BY kind) AS n FROM tiered) x WHERE r <= 3")
shared("dossier_rank_topk", f"WITH {TIERED_Q}, recent AS (SELECT 'customer::' || o_custkey AS id, count(*) AS commits FROM {{orders}} WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' GROUP BY o_custkey) SELECT t.id, t.inbound_count + 2 * coalesce(r.commits, 0) AS score FROM tiered t LEFT JOIN recent r ON r.id = t.id WHERE t.kind IN ('customer', 'supplier') ORDER BY score DESC, t.id LIMIT 50")
shared("hottest3", "SELECT node_id, count(*) AS n FROM {telemetry} WHERE kind = 'injection' GROUP BY node_id ORDER BY n DESC, node_id LIMIT 3")
shared("repo_gallery_order", "SELECT repo, count(*) AS node_count, row_number() OVER (ORDER BY count(*) DESC, repo) AS place FROM {nodes} GROUP BY repo")
shared("live_minus_archived", "SELECT id FROM {nodes} WHERE kind = 'part' EXCEPT SELECT 'part::' || l_partkey FROM {lineitem} WHERE l_returnflag = 'R'")
shared("manifest_except", "SELECT target AS id FROM {claims} EXCEPT SELECT id FROM {nodes}")
shared("claimed_intersect", "SELECT target AS id FROM {claims} INTERSECT SELECT dst FROM {edges}")
shared("union_families", "SELECT id, 'node' AS family FROM {nodes} UNION SELECT owner_id, 'rule' FROM {claims} UNION SELECT 'page::' || page_id, 'page' FROM {pages}")
shared("nontrivial_kinds", "SELECT n.repo, count(DISTINCT n.kind) AS kinds FROM {nodes} n WHERE n.kind NOT IN ('region', 'nation') GROUP BY n.repo")
shared("filter_repo_kind_tier", f"WITH {TIERED_Q} SELECT id, path, inbound_count FROM tiered WHERE repo = 'ASIA' AND kind IN ('customer', 'supplier') AND tier IN ('A', 'B')")
shared("facet_values", "SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM {nodes} GROUP BY kind UNION ALL SELECT 'repo', repo, count(*) FROM {nodes} GROUP BY repo")
shared("fuzzy_edges", "SELECT src, dst, kind FROM {edges} WHERE confidence = 'fuzzy'")
shared("cube_kind_tier_state", f"WITH {TIERED_Q} SELECT coalesce(kind, '*') AS kind, coalesce(tier, '*') AS tier, count(*) AS n FROM tiered GROUP BY CUBE (kind, tier)")
shared("rollup_repo_kind", "SELECT coalesce(repo, '*') AS repo, coalesce(kind, '*') AS kind, count(*) AS n FROM {nodes} GROUP BY ROLLUP (repo, kind)")

# --- flags ------------------------------------------------------------------------------------------------

shared("flag_list", """WITH flags AS (
  SELECT 'orphan_claim' AS kind, 'high' AS severity, c.target AS id FROM {claims} c LEFT JOIN {nodes} n ON n.id = c.target WHERE n.id IS NULL
  UNION ALL SELECT 'stale_claim', 'medium', c.target FROM {claims} c JOIN {nodes} n ON n.id = c.target WHERE c.remote_hash <> n.hash
  UNION ALL SELECT 'dead_code', 'low', n.id FROM {nodes} n LEFT JOIN {edges} e ON e.dst = n.id WHERE e.dst IS NULL AND n.kind <> 'orders')
SELECT kind, severity, count(*) AS n, count(DISTINCT id) AS n_ids, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS place FROM flags GROUP BY kind, severity""")

# --- classification ---------------------------------------------------------------------------------------

CLASS_SQL = """, v AS (
  SELECT 'part::' || p_partkey AS id, 'test' AS kind, 0 AS ord FROM part WHERE p_type = 'PROMO'
  UNION ALL SELECT 'part::' || p_partkey, 'endpoint', 1 FROM part WHERE p_size = 1
  UNION ALL SELECT DISTINCT 'part::' || l_partkey, 'model', 2 FROM lineitem WHERE l_quantity >= 50
  UNION ALL SELECT 'part::' || p_partkey, 'service', 3 FROM part WHERE p_retailprice > 1500),
f AS (SELECT id, arg_min(kind, ord) AS kind, min(ord) AS rule_order FROM v GROUP BY id)
SELECT f.id, f.kind, f.rule_order, coalesce((SELECT string_agg(v.kind, ',' ORDER BY v.ord) FROM v WHERE v.id = f.id AND v.kind <> f.kind), '') AS conflicts FROM f"""


@query(CLASS_SQL)
def classify_with_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """CLS-01 (engine): the first rule that matches decides; later ones that differ are recorded. The rules are stand-ins on parts."""
    part = table(spark, d, "part").withColumn("id", F.concat(F.lit("part::"), F.col("p_partkey").cast("string")))
    heavy = table(spark, d, "lineitem").where("l_quantity >= 50").select(F.concat(F.lit("part::"), F.col("l_partkey").cast("string")).alias("id"))
    rules = [("test", F.col("p_type") == "PROMO"), ("endpoint", F.col("p_size") == 1), ("model", heavy), ("service", F.col("p_retailprice") > 1500)]
    return K.classify(K.verdicts(part, rules))


@query(
    "SELECT c_custkey AS id, CASE WHEN o.n IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'stale' WHEN c_mktsegment = 'MACHINERY' THEN 'unreviewed' WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'llm_drafted' ELSE 'current' END AS state"
    " FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey"
)
def dossier_state(spark: SparkSession, d: str) -> DataFrame:
    """CLS-11: the state machine of a dossier."""
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    pinned = F.when(F.col("c_acctbal") < 0, "old").when(F.col("c_acctbal") < 1000, "").otherwise("new")
    segment = F.col("c_mktsegment")
    status = F.when(segment == "MACHINERY", "unreviewed").when(segment == "BUILDING", "llm_drafted").when(segment == "FURNITURE", "stub")
    state = K.dossier_state(F.col("n").isNotNull(), status, pinned, F.lit("new"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select(F.col("c_custkey").alias("id"), state.alias("state"))


@query(
    "SELECT n.repo, CASE WHEN count(*) = 0 THEN 'empty' WHEN any_value(k.age) IS NULL THEN 'unknown' WHEN any_value(k.age) <= 7 THEN 'active' WHEN any_value(k.age) >= 180 AND sum(coalesce(e.c, 0)) = 0 THEN 'dead-candidate' ELSE 'dormant' END AS activity"
    " FROM (SELECT id, split_part(id, '::', 2) AS repo, kind FROM nodes WHERE kind = 'customer') n LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) e ON e.dst = n.id"
    " LEFT JOIN (SELECT o_custkey::VARCHAR AS repo, datediff('day', CAST(max(o_orderdate) AS DATE), DATE '1998-08-05') AS age FROM orders GROUP BY o_custkey) k ON k.repo = n.repo GROUP BY n.repo"
)
def repo_activity_class(spark: SparkSession, d: str) -> DataFrame:
    """CLS-12: activity class of each repository (customers stand in, their latest order for the last push)."""
    n = G.nodes(spark, d).where("kind = 'customer'").select("id", F.split_part("id", F.lit("::"), F.lit(2)).alias("repo"))
    e = G.edges(spark, d).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("c"))
    age = F.datediff(F.lit("1998-08-05").cast("date"), F.max("o_orderdate").cast("date"))
    k = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("repo")).agg(age.alias("age"))
    r = n.join(e, "id", "left").groupBy("repo").agg(F.count("*").alias("n"), F.sum(F.coalesce("c", F.lit(0))).alias("inbound"))
    return r.join(k, "repo", "left").select("repo", K.activity(F.col("age"), F.col("n"), F.col("inbound")).alias("activity"))


@query(
    "SELECT caveat, count(*) AS n FROM (SELECT DISTINCT dst AS id, 'external_target' AS caveat FROM edges WHERE confidence = 'external' UNION ALL SELECT DISTINCT dst, 'fuzzy_target' FROM edges WHERE confidence = 'fuzzy' UNION ALL SELECT id, 'unclaimed' FROM nodes WHERE id NOT IN (SELECT target FROM claims)) x GROUP BY caveat"
)
def caveat_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by caveat: targets of outside and of fuzzy edges, and what nothing claims."""
    targets = G.edges(spark, d).where("confidence IN ('external', 'fuzzy')").select("dst", F.concat("confidence", F.lit("_target")).alias("caveat")).distinct()
    # NOT IN by sums over equal ids, so no list of targets goes through the driver. As in SQL, a null target leaves no node, and a null id counts only where nothing is claimed.
    claimed = G.claims(spark, d).select(F.col("target").alias("id"), F.lit(1).alias("claim"), F.lit(0).alias("node"))
    return targets.groupBy("caveat").agg(F.count("*").alias("n")).unionByName(C.unclaimed(claimed.unionByName(G.nodes(spark, d).select("id", F.lit(0).alias("claim"), F.lit(1).alias("node")))))
