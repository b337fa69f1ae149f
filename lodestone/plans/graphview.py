"""The star schema read as a dependency graph: nodes, edges, claims, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

NOW = "2024-01-31 00:00:00"

#: The same views for SQL engines; every registered SQL may start from them.
SQL_VIEWS = """
nodes AS (
  SELECT 'region::' || r_regionkey AS id, 'region' AS kind, r_name AS name, r_name AS repo, r_name AS path, md5(r_name) AS hash FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, 'nation', n_name, r_name, n_name, md5(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customer::' || c_custkey, 'customer', c_name, r_name, n_name, md5(c_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'supplier::' || s_suppkey, 'supplier', s_name, r_name, n_name, md5(s_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'part::' || p_partkey, 'part', p_name, p_brand, p_type, md5(p_name) FROM part
  UNION ALL SELECT 'orders::' || o_orderkey, 'orders', 'order ' || o_orderkey, r_name, n_name, md5('order ' || o_orderkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
edges AS (
  SELECT 'nation::' || n_nationkey AS src, 'region::' || n_regionkey AS dst, 'extends' AS kind, 'exact' AS confidence FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, 'nation::' || c_nationkey, 'references', 'exact' FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, 'nation::' || s_nationkey, 'references', 'exact' FROM supplier
  UNION ALL SELECT 'orders::' || o_orderkey, 'customer::' || o_custkey, 'calls', 'exact' FROM orders
  UNION ALL SELECT src, dst, kind, CASE conf WHEN 'A' THEN 'exact' WHEN 'N' THEN 'fuzzy' ELSE 'external' END FROM (
    SELECT 'orders::' || l_orderkey AS src, 'supplier::' || l_suppkey AS dst, 'reads' AS kind, min(l_returnflag) AS conf FROM lineitem GROUP BY l_orderkey, l_suppkey
    UNION ALL SELECT 'orders::' || l_orderkey, 'part::' || l_partkey, 'instantiates', min(l_returnflag) FROM lineitem GROUP BY l_orderkey, l_partkey)
),
calls AS (SELECT 'part::' || p_partkey AS src, 'part::' || ((p_partkey * 7 + p_size) % (SELECT count(*) FROM part)) AS dst FROM part),
claims AS (
  SELECT DISTINCT 'rule::' || o_orderpriority AS owner_id, CASE WHEN l_linenumber % 3 = 0 THEN 'customer::' || (o_custkey + CASE WHEN l_linenumber = 3 THEN 100000000 ELSE 0 END) ELSE 'part::' || l_partkey END AS target,
    md5(CASE WHEN l_linenumber % 3 = 0 THEN c_name ELSE p_name END || CASE WHEN l_linenumber % 5 = 0 THEN '?' ELSE '' END) AS remote_hash
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
),
telemetry AS (
  SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'injection' WHEN 'click' THEN 'acknowledgment' ELSE 'drift' END AS kind, user_id AS node_id
  FROM events WHERE event_type IN ('view', 'click', 'error'))
"""


def with_views(sql: str, recursive: bool = False) -> str:
    """A SQL statement over the views."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL_VIEWS.strip()}{sql if sql.lstrip().startswith(',') else ' ' + sql}"


def _id(prefix: str, key) -> F.Column:
    return F.concat(F.lit(prefix + "::"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, kind, name, repo, path, hash."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    # The two smallest tables have a fixed size by their definition.
    place = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name"))
    cust = table(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    order_name = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    parts = [
        region.select(_id("region", "r_regionkey").alias("id"), F.lit("region").alias("kind"), F.col("r_name").alias("name"), F.col("r_name").alias("repo"), F.col("r_name").alias("path")),
        place.select(_id("nation", "n_nationkey"), F.lit("nation"), "n_name", "r_name", "n_name"),
        cust.select(_id("customer", "c_custkey"), F.lit("customer"), "c_name", "r_name", "n_name"),
        table(spark, d, "supplier").join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(_id("supplier", "s_suppkey"), F.lit("supplier"), "s_name", "r_name", "n_name"),
        table(spark, d, "part").select(_id("part", "p_partkey"), F.lit("part"), "p_name", "p_brand", "p_type"),
        table(spark, d, "orders").join(cust.select("c_custkey", "n_name", "r_name"), F.col("o_custkey") == F.col("c_custkey")).select(_id("orders", "o_orderkey"), F.lit("orders"), order_name, "r_name", "n_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("hash", F.md5("name"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, kind, confidence; src depends on dst."""
    exact = F.lit("exact").alias("confidence")
    nation, cust, supp, orders, li = (table(spark, d, t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))
    conf = F.when(F.col("c") == "A", "exact").when(F.col("c") == "N", "fuzzy").otherwise("external").alias("confidence")
    line = lambda kind, prefix, key: li.groupBy("l_orderkey", key).agg(F.min("l_returnflag").alias("c")).select(_id("orders", "l_orderkey").alias("src"), _id(prefix, key).alias("dst"), F.lit(kind).alias("kind"), conf)
    return (
        nation.select(_id("nation", "n_nationkey").alias("src"), _id("region", "n_regionkey").alias("dst"), F.lit("extends").alias("kind"), exact)
        .union(cust.select(_id("customer", "c_custkey"), _id("nation", "c_nationkey"), F.lit("references"), exact))
        .union(supp.select(_id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), F.lit("references"), exact))
        .union(orders.select(_id("orders", "o_orderkey"), _id("customer", "o_custkey"), F.lit("calls"), exact))
        .union(line("reads", "supplier", "l_suppkey"))
        .union(line("instantiates", "part", "l_partkey"))
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: a cyclic call graph over the parts."""
    part = table(spark, d, "part")
    n = F.broadcast(part.agg(F.count("*").alias("n")))  # one row
    return part.crossJoin(n).select(_id("part", "p_partkey").alias("src"), _id("part", (F.col("p_partkey") * 7 + F.col("p_size")) % F.col("n")).alias("dst"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """owner_id, target, remote_hash; some targets are missing and some hashes are stale."""
    li, o, c, p = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "part"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    on_customer = F.col("l_linenumber") % 3 == 0
    key = F.col("o_custkey") + F.when(F.col("l_linenumber") == 3, 100000000).otherwise(0)
    name = F.concat(F.when(on_customer, F.col("c_name")).otherwise(F.col("p_name")), F.when(F.col("l_linenumber") % 5 == 0, "?").otherwise(""))
    return j.select(_id("rule", "o_orderpriority").alias("owner_id"), F.when(on_customer, _id("customer", key)).otherwise(_id("part", "l_partkey")).alias("target"), F.md5(name).alias("remote_hash")).distinct()


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    """event_id, ts, kind (injection, acknowledgment, drift), node_id."""
    kind = F.when(F.col("event_type") == "view", "injection").when(F.col("event_type") == "click", "acknowledgment").otherwise("drift")
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click", "error")).select("event_id", "ts", kind.alias("kind"), F.col("user_id").alias("node_id"))
