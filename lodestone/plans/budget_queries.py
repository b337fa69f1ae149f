"""Queries of bounded answers, structural hashes and first paragraphs on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.hashing import structural_hash
from lodestone.functions.scalars import first_paragraph
from lodestone.operators import budget as B
from lodestone.session import table

from . import graphview as G
from .registry import query


@query(
    "SELECT dst, fuzzy, src, place, greatest(total - 30, 0) AS more FROM (SELECT dst, confidence = 'fuzzy' AS fuzzy, src, row_number() OVER (PARTITION BY dst, confidence = 'fuzzy' ORDER BY src, kind) AS place, count(*) OVER (PARTITION BY dst, confidence = 'fuzzy') AS total FROM edges) x WHERE place <= 30"
)
def dependents_capped(spark: SparkSession, d: str) -> DataFrame:
    """WIN-04: the first 30 dependents of a node, sure and fuzzy ones apart, with how many more there are."""
    rows = G.edges(spark, d).select("dst", (F.col("confidence") == "fuzzy").alias("fuzzy"), "src", "kind")
    return B.capped(rows, ["dst", "fuzzy"], ["src", "kind"]).select("dst", "fuzzy", "src", "place", "more")


@query(
    """, b AS (SELECT l_orderkey AS k, l_linenumber AS o, CAST(l_quantity AS BIGINT) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
run AS (SELECT k, i, n, CAST(o AS VARCHAR) AS admitted, s AS used, 1 AS c FROM b WHERE i = 1
  UNION ALL SELECT r.k, b.i, r.n, CASE WHEN r.used + b.s <= 60 THEN r.admitted || ',' || b.o ELSE r.admitted END, CASE WHEN r.used + b.s <= 60 THEN r.used + b.s ELSE r.used END, CASE WHEN r.used + b.s <= 60 THEN r.c + 1 ELSE r.c END FROM run r JOIN b ON b.k = r.k AND b.i = r.i + 1)
SELECT k AS l_orderkey, admitted, used, n - c AS skipped FROM run WHERE i = n""",
    recursive=True,
)
def budgeted_blocks(spark: SparkSession, d: str) -> DataFrame:
    """WIN-05: blocks of each order that fit a budget, skipping those that do not."""
    got = B.within_budget(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity", 60)
    return got.select("l_orderkey", F.array_join("admitted", ",").alias("admitted"), "used", "skipped")


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_issues(spark: SparkSession, d: str) -> DataFrame:
    """SRT-11: the ten latest errors of the last day that events tell of."""
    events = table(spark, d, "events")
    last = events.agg(F.max("ts").alias("now"))  # one row
    issues = events.where("event_type = 'error'").crossJoin(F.broadcast(last))
    return B.recent_issues(issues, "ts", "event_id", F.col("now")).select("event_id", "ts")


@query("""SELECT p_partkey, sha256('{"body_text": "' || p_type || '", "name": "' || p_name || '", "primitive": "class", "signature": {"brand": "' || p_brand || '", "size": ' || p_size || '}}') AS hash FROM part""")
def structural_hashes(spark: SparkSession, d: str) -> DataFrame:
    """HSH-01, JSN-02: the hash of a primitive's canonical JSON."""
    signature = F.to_json(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")))
    return table(spark, d, "part").select("p_partkey", structural_hash(F.lit("class"), F.col("p_name"), signature, F.col("p_type")).alias("hash"))


@query(
    r"""SELECT doc_id, CASE WHEN length(p) > 280 THEN regexp_replace(substr(p, 1, 279), '\s+$', '') || '…' ELSE p END AS summary FROM (SELECT doc_id, regexp_replace(coalesce(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1], ''), '^#+\s*', '') AS p FROM documents) d"""
)
def first_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """STR-16: the first paragraph of each document, for a list."""
    return table(spark, d, "documents").select("doc_id", first_paragraph(F.col("text")).alias("summary"))
