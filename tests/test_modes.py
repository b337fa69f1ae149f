"""Modes and scopes of search."""

from lodestone.operators import modes


def test_scopes_narrow_a_mode():
    assert modes.fields("dep") == ("dossier_body", "node_summary") and modes.fields("dep", ("code",)) == ("node_summary",)
    assert modes.fields("dep", ("rules",)) == () and modes.fields("nothing", ("also nothing",)) == modes.MODES["semantic"]
    assert modes.fields("semantic", ("rules", "processes")) == ("rule_statement", "process_summary", "process_step")


def test_blank_and_unmatched_queries(spark):
    index = spark.createDataFrame([(1, "n1", "dossier_body", "pay order", [1.0, 0.0]), (2, "n2", "rule_statement", "pay rule", None)], "row long, node_id string, field string, text string, vector array<float>")
    nodes = spark.createDataFrame([("svc::pay", "pay", "service", "a/pay.py"), ("svc::ship", "ship", "service", None)], "id string, name string, kind string, path string")
    ask = lambda *a, **k: [(r.node_id, r.field) for r in modes.find(index, nodes, *a, **k).collect()]
    assert ask("  ") == [] and ask("order") == [("n1", "dossier_body")] and ask("rule", mode="knowledge") == []
    assert ask("ship") == [("svc::ship", "lexical")] and ask("pay", mode="lexical") == [("svc::pay", "lexical")] and ask("ship", mode="dep", scopes=("rules",)) == []
