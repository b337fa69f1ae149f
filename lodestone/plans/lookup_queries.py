"""Lookups of nodes and rules by what a user types, search by modes and scopes, cues of plugins, and numbered rows after a refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import cues, modes, numbering
from lodestone.session import table

from . import graphview as G
from .registry import query


#: Parts that the rows of a key are dealt into.
PARTS = 32


def spread_join(left: DataFrame, right: DataFrame, on: str, deal: str, parts: int = PARTS) -> DataFrame:
    """left and right joined by few keys with many rows: a key's left rows are dealt by a column into parts, and each meets all of its right rows.

    The tables are small and the result is large, so the number of tasks is set: left to their size, all would go to one.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("__part", F.pmod(F.xxhash64(deal), F.lit(parts)).cast("int")).repartition(tasks, on, "__part")
    each = right.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(tasks, on, "__part")
    return dealt.join(each, [on, "__part"]).drop("__part")


@query(
    """, asked AS (SELECT o_orderkey AS ask, CASE o_orderkey % 3 WHEN 0 THEN 'customer::' || o_custkey WHEN 1 THEN r_name || '/' || n_name ELSE 'gone::' || o_custkey END AS target
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'P')
SELECT a.ask, n.id, n.kind FROM asked a JOIN nodes n ON n.id = a.target OR (a.target NOT LIKE '%::%' AND n.repo || '/' || n.path = a.target AND n.kind IN ('supplier', 'nation'))"""
)
def find_nodes(spark: SparkSession, d: str) -> DataFrame:
    """FLT-02: nodes by their id, or by the repository and path that they lie under."""
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name", "n_name")
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(place, "c_nationkey")
    by = F.col("o_orderkey") % 3
    target = F.when(by == 0, F.concat(F.lit("customer::"), "o_custkey")).when(by == 1, F.concat_ws("/", "r_name", "n_name")).otherwise(F.concat(F.lit("gone::"), "o_custkey"))
    asked = o.select(F.col("o_orderkey").alias("ask"), target.alias("target"))
    nodes = G.nodes(spark, d)
    by_id = asked.join(nodes.select(F.col("id").alias("target"), "id", "kind"), "target")
    paths = nodes.where("kind IN ('supplier', 'nation')").select(F.concat_ws("/", "repo", "path").alias("target"), "id", "kind")
    by_path = spread_join(asked.where("NOT contains(target, '::')"), paths, "target", "ask")
    return by_id.unionByName(by_path).select("ask", "id", "kind")


@query(
    """, asked AS (SELECT o_orderkey AS ask, CASE o_orderkey % 3 WHEN 0 THEN 'rule::' || o_orderpriority WHEN 1 THEN 'customer::' || o_custkey ELSE n_name END AS target
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'),
files AS (SELECT DISTINCT n.path AS target, c.owner_id FROM claims c JOIN nodes n ON n.id = c.target WHERE n.kind = 'customer')
SELECT DISTINCT a.ask, x.owner_id AS rule FROM asked a JOIN (SELECT DISTINCT owner_id AS target, owner_id FROM claims UNION SELECT target, owner_id FROM claims UNION SELECT target, owner_id FROM files) x ON x.target = a.target"""
)
def find_rules(spark: SparkSession, d: str) -> DataFrame:
    """FLT-20: rules by their own id, by a node that they claim, or by a file whose nodes they claim."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = table(spark, d, "orders").where("o_orderstatus = 'P'").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, "c_nationkey")
    by = F.col("o_orderkey") % 3
    target = F.when(by == 0, F.concat(F.lit("rule::"), "o_orderpriority")).when(by == 1, F.concat(F.lit("customer::"), "o_custkey")).otherwise(F.col("n_name"))
    claims = G.claims(spark, d).select("target", F.col("owner_id").alias("rule")).distinct()
    files = claims.join(G.nodes(spark, d).where("kind = 'customer'").select(F.col("id").alias("target"), "path"), "target").select(F.col("path").alias("target"), "rule").distinct()
    # Forms of a target: each is an equality of its own, so one index of (target, rule) answers all.
    index = claims.select(F.col("rule").alias("target"), "rule").distinct().unionByName(claims).unionByName(files).distinct()
    return o.select(F.col("o_orderkey").alias("ask"), target.alias("target")).join(index, "target").select("ask", "rule").distinct()


PLUGINS = """, plugins AS (SELECT 'n' || s_nationkey AS scope, 'p' || s_suppkey AS plugin, s_suppkey % 5 AS precedence, s_acctbal > 0 AS detected, CASE WHEN s_suppkey % 2 = 0 THEN 'router.get' ELSE 'app.m' || (s_suppkey % 7) END AS route, 'w' || (s_suppkey % 3) AS w1, 'w' || (s_suppkey % 4) AS w2 FROM supplier),
live AS (SELECT * FROM plugins WHERE (detected OR plugin LIKE '%3') AND plugin NOT LIKE '%7'),
routes AS (SELECT scope, string_agg(DISTINCT r, ',' ORDER BY r) AS routes FROM (SELECT scope, route AS r FROM live UNION ALL SELECT scope, 'common' FROM live) x GROUP BY scope),
weights AS (SELECT scope, name, w FROM (SELECT *, row_number() OVER (PARTITION BY scope, name ORDER BY precedence DESC, plugin DESC) AS r FROM (SELECT scope, plugin, precedence, w1 AS name, precedence + 1 AS w FROM live UNION ALL SELECT scope, plugin, precedence, w2, precedence + 100 FROM live WHERE w2 <> w1) y) z WHERE r = 1)"""


@query(PLUGINS + " SELECT r.scope, r.routes, (SELECT string_agg(name || '=' || w, ',' ORDER BY name) FROM weights w WHERE w.scope = r.scope) AS weights FROM routes r")
def merged_cues(spark: SparkSession, d: str) -> DataFrame:
    """AGG-32, CMP-19, UDF-02: cues of the active plugins of each scope; weights of higher precedence win."""
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey")
    w1, w2 = F.concat(F.lit("w"), key % 3), F.concat(F.lit("w"), key % 4)
    weights = F.map_concat(F.create_map(w1, key % 5 + 1), F.map_filter(F.create_map(F.concat(F.lit("w"), key % 4), key % 5 + 100), lambda k, v: k != w1))
    routes = F.array(F.when(key % 2 == 0, "router.get").otherwise(F.concat(F.lit("app.m"), key % 7)), F.lit("common"))
    plugins = s.select(F.concat(F.lit("n"), "s_nationkey").alias("scope"), F.concat(F.lit("p"), key).alias("plugin"), (key % 5).alias("precedence"), (F.col("s_acctbal") > 0).alias("detected"), routes.alias("routes"), weights.alias("weights"))
    live = cues.active(plugins, plugins.where("plugin LIKE '%3'"), plugins.where("plugin LIKE '%7'"))
    got = cues.merged(live, ("routes",))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("weights")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return got.select("scope", F.array_join("routes", ",").alias("routes"), told.alias("weights"))


@query(
    """, lines AS (SELECT doc_id, unnest(range(len(l))) AS chunk, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) x)
SELECT doc_id, chunk::INTEGER AS chunk, md5(line) AS hash, (row_number() OVER (ORDER BY doc_id, chunk) - 1)::BIGINT AS row FROM (
  SELECT * FROM lines WHERE doc_id % 10 NOT IN (3, 5) UNION ALL SELECT doc_id, 0, 'new ' || doc_id FROM documents WHERE doc_id % 10 = 3) y"""
)
def refreshed_rows(spark: SparkSession, d: str) -> DataFrame:
    """VEC-03: a numbered index of texts' lines after some documents were written anew and some are gone."""
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk", "line")).select("doc_id", "chunk", F.md5("line").alias("hash"), F.lit(0).cast("long").alias("row"))
    fresh = docs.where("doc_id % 10 = 3").select("doc_id", F.lit(0).alias("chunk"), F.md5(F.concat(F.lit("new "), "doc_id")).alias("hash"))
    return numbering.refreshed(lines, fresh, docs.where("doc_id % 10 = 5").select("doc_id"), "doc_id", "doc_id", "chunk")


#: name, query, mode, scopes, whether the query has a vector.
ASKED = (
    ("all", "the onti of", "semantic", (), True), ("words", "the onti of", "semantic", (), False), ("dossiers", "the onti of", "dep", (), True), ("knowledge", "the onti of", "knowledge", (), True),
    ("narrow", "the onti of", "semantic", ("processes", "rules"), True), ("outside", "the onti of", "dep", ("rules",), True), ("names", "customer widget", "lexical", (), True), ("fallback", "supplier brand", "dep", ("code",), False), ("unknown", "the onti of", "other", ("nothing",), True),
)


def _bm25_sql(bag: str, key: str, query: str) -> str:
    terms = " UNION ALL ".join(f"SELECT '{t}' AS term" for t in query.split())
    return f"""(SELECT {key}, sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1.0e0) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS bm25 FROM (
  SELECT *, count(*) OVER (PARTITION BY term)::DOUBLE AS df FROM (SELECT {key}, term, len(b)::DOUBLE AS dl, n, avgdl, len(list_filter(b, lambda w: w = term))::DOUBLE AS tf FROM
    (SELECT *, count(*) OVER ()::DOUBLE AS n, avg(len(b)) OVER () AS avgdl FROM {bag}) g, ({terms}) q) t WHERE tf > 0) u GROUP BY {key})"""


def _mode_sql(name: str, query: str, mode: str, scopes: tuple[str, ...], vector: bool) -> str:
    names = f"SELECT '{name}' AS asked, node_id, 'lexical' AS field, round_even(bm25, 6) AS score FROM {_bm25_sql('nbag', 'node_id', query)} z WHERE round_even(bm25, 6) > 0 ORDER BY score DESC, node_id LIMIT 20"
    if mode == "lexical" or name == "fallback":
        return names
    asked = modes.fields(mode, scopes)
    within = f"field IN ({', '.join(repr(f) for f in asked)})" if asked else "false"
    cosine = "list_dot_product(vector::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))" if vector else "0e0"
    return f"""SELECT '{name}' AS asked, node_id, field, score FROM (SELECT *, round_even(0.4e0 * CASE WHEN mb > 0 THEN coalesce(bm25, 0) / mb ELSE 0 END + 0.6e0 * CASE WHEN mc > 0 THEN cosine / mc ELSE 0 END, 6) AS score FROM (
  SELECT i.*, w.bm25, {cosine} AS cosine, max(w.bm25) OVER () AS mb, max({cosine}) OVER () AS mc FROM idx i LEFT JOIN {_bm25_sql(f"(SELECT * FROM idx WHERE {within})", "row", query)} w ON w.row = i.row WHERE {within}) a) b WHERE score > 0 ORDER BY score DESC, row LIMIT 20"""


INDEX_SQL = """, idx AS (SELECT doc_id AS row, 'doc::' || source AS node_id, CASE doc_id % 7 WHEN 0 THEN 'dossier_body' WHEN 1 THEN 'rule_statement' WHEN 2 THEN 'domain_summary' WHEN 3 THEN 'process_summary' WHEN 4 THEN 'process_step' WHEN 5 THEN 'node_summary' ELSE 'other' END AS field,
  embedding AS vector, regexp_extract_all(lower(concat_ws(' ', text, 'doc::' || source)), '[a-z0-9]+') AS b FROM documents JOIN embeddings ON vec_id = doc_id),
nbag AS (SELECT id AS node_id, regexp_extract_all(lower(concat_ws(' ', id, name, kind, path)), '[a-z0-9]+') AS b FROM nodes)"""


@query(INDEX_SQL + " " + " UNION ALL ".join(f"(SELECT * FROM ({_mode_sql(*a)}) m)" for a in ASKED))
def search_modes(spark: SparkSession, d: str) -> DataFrame:
    """SET-02, TXT-03: nine searches by mode and scope, with and without a vector, and by names where an index has nothing."""
    vectors = table(spark, d, "embeddings")
    kinds = ("dossier_body", "rule_statement", "domain_summary", "process_summary", "process_step", "node_summary", "other")
    field = F.coalesce(*[F.when(F.col("doc_id") % 7 == k, f) for k, f in enumerate(kinds)])
    index = table(spark, d, "documents").join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id")
    index = index.select(F.col("doc_id").alias("row"), F.concat(F.lit("doc::"), "source").alias("node_id"), field.alias("field"), "text", "vector")
    vector = list(vectors.where("vec_id = 0").first()["embedding"])
    out = None
    for name, text, mode, scopes, has in ASKED:
        got = modes.find(index, G.nodes(spark, d), text, vector if has else None, mode, scopes).select(F.lit(name).alias("asked"), "*")
        out = got if out is None else out.unionByName(got)
    return out
