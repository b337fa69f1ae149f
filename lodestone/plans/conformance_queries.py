"""Conformance of JSON rows to a schema, and what a write of partitions would change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import schema as V
from lodestone.session import table
from lodestone.sources import sinks

from .registry import query

#: What an event's document must be.
EVENT = {
    "type": "object",
    "required": ["id", "kind", "owner"],
    "properties": {
        "id": {"type": "string", "pattern": "^e[0-9]+$", "maxLength": 5},
        "kind": {"enum": ["view", "click", "purchase"]},
        "value": {"type": "number", "maximum": 40},
        "props": {"type": "object", "required": ["k", "source"], "properties": {"k": {"type": "integer", "minimum": 10}}},
        "owner": {"oneOf": [{"type": "string"}, {"type": "integer", "minimum": 50}]},
    },
}


@query(
    """SELECT event_id, violation FROM (
  SELECT event_id, '$.id: maxLength' AS violation, length('e' || event_id) > 5 AS broken FROM events
  UNION ALL SELECT event_id, '$.kind: enum', event_type NOT IN ('view', 'click', 'purchase') FROM events
  UNION ALL SELECT event_id, '$.value: maximum', value > 40 FROM events
  UNION ALL SELECT event_id, '$.props.source: required', true FROM events
  UNION ALL SELECT event_id, '$.props.k: minimum', CAST(json_extract_string(props, '$.k') AS BIGINT) < 10 FROM events
  UNION ALL SELECT event_id, '$.owner: required', user_id % 7 = 0 FROM events
  UNION ALL SELECT event_id, '$.owner: oneOf', user_id % 7 <> 0 AND user_id < 50 AND event_id % 2 = 0 FROM events) x WHERE broken"""
)
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """VAL-04: every violation of the schema by an event's document, with its path."""
    e = table(spark, d, "events")
    owner = F.when(F.col("user_id") % 7 == 0, "").when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "owner": '), "user_id")).otherwise(F.concat(F.lit(', "owner": "u'), "user_id", F.lit('"')))
    doc = F.concat(F.lit('{"id": "e'), "event_id", F.lit('", "kind": "'), "event_type", F.lit('", "value": '), F.col("value").cast("string"), F.lit(', "props": '), "props", owner, F.lit("}"))
    return e.select("event_id", F.explode(V.conforms(EVENT, doc)).alias("violation"))


@query(
    """, now AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders),
old AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 1000 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE NOT (o_orderpriority = '2-HIGH' AND o_orderstatus = 'F')),
diff AS (SELECT DISTINCT o.o_orderpriority, o.o_orderstatus FROM orders o JOIN old ON old.o_orderkey = o.o_orderkey WHERE old.price <> o.o_totalprice)
SELECT n.o_orderpriority AS repo, n.o_orderstatus AS language, CASE WHEN p.o_orderpriority IS NULL THEN 'added' ELSE 'changed' END AS what FROM now n LEFT JOIN (SELECT DISTINCT o_orderpriority, o_orderstatus FROM old) p ON p.o_orderpriority = n.o_orderpriority AND p.o_orderstatus = n.o_orderstatus
WHERE p.o_orderpriority IS NULL OR EXISTS (SELECT 1 FROM diff d WHERE d.o_orderpriority = n.o_orderpriority AND d.o_orderstatus = n.o_orderstatus)"""
)
def partition_changes(spark: SparkSession, d: str) -> DataFrame:
    """SNK-10: the partitions that a write would touch, by digests of orders now and before."""
    now = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("repo"), F.col("o_orderstatus").alias("language"), "o_totalprice")
    price = F.when((F.col("repo") == "1-URGENT") & (F.col("o_orderkey") % 1000 == 1), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    before = now.where("NOT (repo = '2-HIGH' AND language = 'F')").withColumn("o_totalprice", price)
    return sinks.changes(sinks.digests(now, "repo", "language"), sinks.digests(before, "repo", "language"), "repo", "language")
