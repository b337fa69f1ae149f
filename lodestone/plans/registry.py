"""Registers queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.session import table

from . import graphview

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
VIEWS = {name: getattr(graphview, name) for name in ("nodes", "edges", "calls", "claims", "telemetry")}


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a function under its name; sql may use the graph views."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = graphview.with_views(sql, recursive)
        return f

    return put


def shared(name: str, sql: str, oracle: str | None = None) -> None:
    """A query whose declarative form is plain SQL: {x} names a graph view or a table."""
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, d: str) -> DataFrame:
        frames = {n: VIEWS[n](spark, d) if n in VIEWS else table(spark, d, n) for n in names}
        return spark.sql(sql, **frames)

    run.__name__ = name
    QUERIES[name] = run
    text = re.sub(r"\{(\w+)\}", r"\1", oracle or sql).replace("bround(", "round_even(")
    ORACLE[name] = graphview.with_views((", " + text.strip()[5:]) if text.lstrip().upper().startswith("WITH ") else text)
