"""Classification, ranking and links on the small code corpus: against SQL, and hand-made goldens."""

import pytest

from lodestone.operators import rank as R
from lodestone.operators import rules as C
from lodestone.plans.code_corpus import CUES, FACTS, facts
from lodestone.plans.corpus_queries import FIXED, FIXED_SQL

NAMES = sorted(FIXED)


def test_facts_fit_their_columns():
    assert all(len(r) == len(schema.split(", ")) for rows, schema in FACTS.values() for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, name):
    import duckdb

    got = FIXED[name](spark)
    columns = sorted(got.columns)
    mine = sorted(tuple(str(v) for v in r) for r in got.select(*columns).collect())
    assert mine and mine == sorted(tuple(str(v) for v in r) for r in duckdb.sql(f"SELECT {', '.join(columns)} FROM ({FIXED_SQL[name]}) x").fetchall())


def test_kinds(spark):
    got = {r.id.rpartition("::")[2]: (r.kind, r.conflicts) for r in FIXED["classify_code"](spark).collect()}
    assert got["test_create"] == ("test", "endpoint") and got["probe"] == ("test", "") and got["session"] == ("test", "")
    assert got["helper"] == (None, "") and got["useOrders"] == ("hook", "") and got["Panel.useRow"] == ("hook", "") and got["useLess"] == ("util", "")
    assert got["Orders"] == ("component", "") and got["render"] == (None, "")
    assert got["create"] == ("endpoint", "") and got["listing"] == ("endpoint", "")
    assert got["save"] == ("service", "") and got["notify"] == ("service", "") and got["lonely"] == (None, "")
    assert got["fmt"] == ("util", "") and got["pad"] == ("util", "") and got["dead"] == (None, "")
    assert got["Order"] == ("model", "") and got["Orphan"] == (None, "") and got["Typed"] == (None, "") and got["orders"] == ("schema", "")
    # An extractor's kind stays; a rule that confirms it takes its place, with what came before forgotten.
    assert got["made"] == ("component", "endpoint") and got["known"] == ("endpoint", "")


def test_caveats_follow_bases(spark):
    got = {r.id.rpartition("::")[2]: r.caveats for r in FIXED["code_caveats"](spark).collect()}
    assert got["SubSub"] == "pydantic_refs_not_extracted" and "Order" not in got
    assert got["create"] == "fastapi_depends_chain_not_traced,typed_receiver_unresolved"


def test_empty_corpus(spark):
    empty = {n: spark.createDataFrame([], FACTS[n][1]) for n in FACTS}
    prims = empty["prims"].selectExpr("id", "primitive", "name", "path", "split(decorators, ',') AS decorators", "returns_jsx", "method", "route", "kind")
    assert C.classify_corpus(prims, empty["code_edges"], CUES).count() == 0 and C.caveats(prims, empty["code_edges"]).count() == 0
    own = R.covered_ids(empty["steps"], empty["flows"], empty["code_nodes"], empty["links"])
    assert R.candidates(empty["rule_claims"], empty["code_nodes"], empty["links"], own).count() == 0


def test_signals_all_speak_and_covered_are_silent(spark):
    rows = FIXED["rank_union"](spark).collect()
    assert {r.signal.split("_on_")[0] for r in rows} == {"rule_shape_mismatch", "entrypoint_fan_in", "endpoint_forward_reach", "convergence", "page_initiated_flow", "hook_initiated_flow", "headless_initiated_flow"}
    covered = {r.id for r in R.covered_ids(*[facts(spark, n) for n in ("steps", "flows", "code_nodes", "links")]).collect()}
    assert {"use::5", "DELETE::/api/a3", "POST::/api/a7", "svc::2"} <= covered and not covered & {r.anchor for r in rows}


def test_first_paragraph_and_hash(spark):
    import hashlib

    from pyspark.sql import functions as F

    from lodestone.functions.hashing import structural_hash
    from lodestone.functions.scalars import first_paragraph, is_common_path

    texts = ["---\na: b\n---\n\n## Head line\nmore\n\nnext", "", "  \n \n x ", "y" * 281, "z" * 278 + " " + "z" * 10, None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.p for r in df.select("k", first_paragraph(F.col("t")).alias("p")).orderBy("k").collect()]
    assert got == ["Head line\nmore", "", "x", "y" * 279 + "…", "z" * 278 + "…", ""]
    rows = spark.createDataFrame([("f", "é", '{"b": 1, "a": [null, true]}', None), ("f", 'q"', None, "x\n")], "p string, n string, s string, b string")
    want = ['{"body_text": "", "name": "\\u00e9", "primitive": "f", "signature": {"a": [null, true], "b": 1}}', '{"body_text": "x\\n", "name": "q\\"", "primitive": "f", "signature": {}}']
    assert [r.h for r in rows.select(structural_hash(*map(F.col, "pnsb")).alias("h")).collect()] == [hashlib.sha256(w.encode()).hexdigest() for w in want]
    assert df.where(is_common_path(F.coalesce("t", F.lit("")), ("yy", "zz"))).count() == 2
