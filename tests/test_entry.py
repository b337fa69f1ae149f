"""The entry points: names, SQL, and some queries against DuckDB."""

import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def test_sql_belongs_to_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["impact_depth3", "fan_in_tier", "claims_stale_orphan", "classify_with_conflicts", "dependents_capped", "budgeted_blocks", "recent_issues", "structural_hashes", "first_paragraphs", "telemetry_stats", "mediation_collision", "bm25_topk", "hybrid_topk", "asof_events", "session_window", "reexport_closure", "base_classes", "call_edges", "receiver_types", "db_access", "domain_anchors", "schema_violations", "partition_changes", "classify_code", "code_caveats", "rank_union", "enforced_in_processes", "claims_nested", "find_nodes", "find_rules", "merged_cues", "refreshed_rows", "session_acks", "interval_join_events", "per_kind_summary"])
def test_rows_equal_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = e.queries()[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(tuple(str(v) for v in r) for r in got.select(*columns).collect())
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({e.oracle_sql()[name]}) x")
    assert mine == sorted(tuple(str(v) for v in r) for r in cursor.fetchall())


def test_imports_without_the_optional_subpackage(tmp_path):
    import shutil

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 50"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True).returncode == 0
