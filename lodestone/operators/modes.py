"""Search with modes and scopes: which fields of an index are asked, blended with vectors, and names alone where that finds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search

#: The fields that each mode and each scope covers, and modes that fall back on names.
MODES = {
    "semantic": ("dossier_body", "rule_statement", "domain_summary", "process_summary", "process_step", "node_summary"),
    "dep": ("dossier_body", "node_summary"),
    "knowledge": ("rule_statement", "domain_summary", "process_summary", "process_step"),
    "lexical": (),
}
SCOPES = {"dossiers": ("dossier_body",), "rules": ("rule_statement",), "domain": ("domain_summary",), "processes": ("process_summary", "process_step"), "code": ("node_summary",)}
FALLS_BACK = ("semantic", "dep")


def fields(mode: str, scopes: tuple[str, ...] = ()) -> tuple[str, ...]:
    """The fields of a mode, an unknown one being semantic, narrowed by scopes; scopes that are all unknown narrow nothing."""
    of_mode = MODES.get(mode, MODES["semantic"])
    wanted = {f for s in scopes for f in SCOPES.get(s, ())}
    return tuple(f for f in of_mode if f in wanted) if wanted else of_mode


def by_name(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """node_id, field (lexical), score: nodes (id, name, kind, path) by the words of their names alone."""
    bag = nodes.select(F.col("id").alias("node_id"), F.concat_ws(" ", "id", "name", "kind", "path").alias("text"))
    got = search.bm25(bag, query, "node_id").select("node_id", F.lit("lexical").alias("field"), F.bround("bm25", 6).alias("score"))
    return got.where("score > 0").orderBy(F.desc("score"), "node_id").limit(limit)


def find(index: DataFrame, nodes: DataFrame, query: str, vector: list[float] | None = None, mode: str = "semantic", scopes: tuple[str, ...] = (), limit: int = 20) -> DataFrame:
    """node_id, field, score: the best rows of an index (row, node_id, field, text, vector), ties to the smaller row.

    Rows without a vector are not asked. Without a query's vector words alone count. Nothing for a blank query or for scopes outside the mode; by_name()
    in mode lexical, and where semantic or dep find nothing. Words and vectors are each divided by their greatest value among the rows asked.
    """
    none = nodes.select(F.col("id").alias("node_id"), F.lit("").alias("field"), F.lit(0.0).alias("score")).limit(0)
    if not query.strip():
        return none
    if mode == "lexical":
        return by_name(nodes, query, limit)
    asked = fields(mode, scopes)
    if not asked:
        return none
    rows = index.where(F.col("field").isin(*asked) & F.col("vector").isNotNull())
    words = search.bm25(rows.select("row", F.concat_ws(" ", "text", "node_id").alias("text")), query, "row")
    near = search.cosine(rows, vector, "row", "vector") if vector is not None else rows.select("row", F.lit(0.0).alias("cosine"))
    best = search.hybrid(words, near, "row", limit)
    if mode in FALLS_BACK and best.isEmpty():
        return by_name(nodes, query, limit)
    return best.join(rows.select("row", "node_id", "field"), "row").select("node_id", "field", "score")
