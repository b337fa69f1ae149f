"""Small graphs, goldens and round trips for the graph library."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import commands
from lodestone.functions import scalars as S
from lodestone.operators import claims, classify, ddl, search, traverse
from lodestone.sources import documents, python_code, sinks


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src string, dst string, kind string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_walk_keeps_the_least_shortest_path(spark):
    e = edges(spark, [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "c"), ("a", "d")])
    got = {r.node: (r.depth, r.path) for r in traverse.walk(ids(spark, "a"), e, 3).collect()}
    assert got == {"a": (0, "a"), "b": (1, "a>b"), "c": (1, "a>c"), "d": (2, "a>b>d")}


def test_closure_ends_on_cycles_and_stops_at_barriers(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")])
    assert {r.node for r in traverse.closure(ids(spark, "a"), e).collect()} == set("abcde")
    assert {r.node for r in traverse.closure(ids(spark, "a"), e, ids(spark, "d")).collect()} == set("abc")
    assert traverse.closure(ids(spark, "zz"), e).count() == 1


def test_walk_equals_a_queue_on_random_graphs(spark):
    r = random.Random(4)
    pairs = [(str(r.randrange(12)), str(r.randrange(12))) for _ in range(25)]
    depth = {"0": 0}
    front = ["0"]
    for k in range(1, 4):
        front = sorted({a for a, b in pairs if b in front} - depth.keys())
        depth |= {n: k for n in front}
    got = {x.node: x.depth for x in traverse.walk(ids(spark, "0"), edges(spark, pairs), 3).collect()}
    assert got == depth


def test_claim_states_and_drift(spark):
    nodes = spark.createDataFrame([("n1", "h1"), ("n2", "h2")], "id string, hash string")
    c = spark.createDataFrame([("r", "n1", "h1"), ("r", "n2", "old"), ("r", "n3", "x"), ("r", "n1", None)], "owner_id string, target string, remote_hash string")
    assert sorted(r.state for r in claims.claim_state(c, nodes).collect()) == ["fresh", "orphan", "stale", "unpinned"]
    pairs = spark.createDataFrame([(0, 1), (10, 12), (10, 13), (100, 110), (5, 5)], "pinned int, current int")
    assert [r.drifts for r in claims.drift(pairs).orderBy("pinned", "current").collect()] == [True, False, False, True, True]


def test_mechanism_parts(spark):
    rows = spark.createDataFrame([("T (x)",), ("a and B,",), ("",)], "m string")
    assert [r[0] for r in rows.select(claims.mechanisms("m")).collect()] == [["t"], ["a", "b"], []]


def test_classification_records_conflicts(spark):
    v = spark.createDataFrame([("n", "test", 0), ("n", "model", 2), ("n", "test", 3), ("m", "util", 6)], "id string, kind string, ord int")
    assert {r.id: (r.kind, r.conflicts) for r in classify.classify(v).collect()} == {"n": ("test", "model"), "m": ("util", "")}


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    lit = lambda x: one.select(F.lit(x).alias("x"))
    assert val(S.normalize_url(F.lit("/a/{id}/b/:q?x=1"))) == "/a/<var>/b/<var>"
    assert val(S.normalize_url(F.lit("/a/x<var>"))) == "/a/x"
    assert lit("a::b::c").select(S.slugify("x")).first()[0] == "a__b__c"
    assert lit("a-b").select(S.slugify("x")).first()[0].startswith("a_b_")
    assert lit("external::unresolved::A::b").select(S.external_confidence("x")).first()[0] == "unresolved_internal"
    assert val(S.commit_action(F.lit("fix(core): x"))) == "fix" and val(S.commit_action(F.lit("hello"))) == "edit"
    assert val(S.section(F.lit("## A\none\n## B\ntwo"), "A")) == "one\n"
    assert val(S.frontmatter(F.lit("---\na: 1\n---\nbody"))) == {"a": " 1"}
    assert val(S.unquote(F.lit("'x'"))) == "x"
    assert "hunter2" not in val(S.redact(F.lit("password: hunter2"), F.lit("m"), F.lit(1)))


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/*.py", "a/b.py", True), ("**/*.py", "b.py", True), ("*.py", "a/b.py", False), ("src/**", "src/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("/src/*.py", "src/a.py", True), ("src\\*.py", "src/a.py", True), ("a/**/b", "a//b", True)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(S.glob_regex(glob), path)) is hit


RM, PUSH, SUDO = "rm with -r/-f flags", "git push (real, not dry-run)", "sudo (privileged execution)"


@pytest.mark.parametrize(("command", "want"), [
    ("rm -rf /tmp/x && git push --force", [RM, PUSH]), ("rm a; rm --force b", [RM]), ("echo 'rm -rf /'", []), (None, []), ("echo 'open", []),
    ("sudo -u me rm -f x", [SUDO, RM]), ("sudo ls", [SUDO]), ("git push --dry-run", []), ("git commit --amend", ["git commit --amend (rewrites history)"]),
    ("git checkout -- .", ["git checkout -- . (discards changes)"]), ("git rebase --abort", []), ("git clean -xf|cat", ["git clean -f"]), ("grep 'git push' f", []),
    ("curl -XPOST u -d x", ["curl with mutating verb", "curl with --data (POST-shaped)"]), ("curl -X get u", []), ("psql -c ' drop table x'", ["psql mutating SQL"]),
    ("gcloud compute instances delete a", ["gcloud mutating command"]), ("aws s3api delete-object", ["aws mutating command"]), ("dd if=a of=b", ["dd (raw disk write)"]),
    ("docker rm a", ["docker destructive command"]), ("kubectl delete pod a", ["kubectl mutating command"]), ("systemctl --user stop a", ["systemctl --user service control"]),
    ("npm publish", ["npm publish"]), ("pip install --dry-run a", []), ("make deploy", ["deploy / release target"]), ("cat a > /dev/sda", ["redirection to block device"]),
])
def test_irreversible_commands(command, want):
    assert commands.findings(command) == want


def test_scalars_as_specified(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    routes = {"/a/:id/b?x=1": "/a/<var>/b", "/u/{p:path/x}": "/u/<var>", "/x/{}": "/x/{}", "<var>": "", "/a<var>": "/a", "/a/<var>": "/a/<var>", "a:b": "a<var>", "": ""}
    assert {k: one(S.normalize_url(F.lit(k))) for k in routes} == routes
    ids = spark.createDataFrame([("r::a/b.py::Foo",), ("r::v4-mini",), ("---",)], "i string")
    assert [r.s for r in ids.select(S.slugify("i").alias("s")).collect()] == ["r__a_b_py__Foo", "r__v4_mini_" + hashlib.sha1(b"r::v4-mini").hexdigest()[:8], hashlib.sha1(b"---").hexdigest()[:8]]
    kinds = {"external::pypi::unknown::x": "unresolved_internal", "external::npm::left": "external", "r::a": "external", "external::dynamic::g::1": "dynamic", "external::unresolved::db.query": "unresolved_receiver", "external::unresolved::r::a": "unresolved_internal", "external::builtins::len": "external"}
    rows = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", S.external_confidence("t").alias("c")).collect()
    assert {r.t: r.c for r in rows} == kinds
    lines = {"- **db** password `x`": "- **db** ", "password: null": None, "password: hunter2": "", "# see https://u:p@h/": "# ", "token = 'abcdefgh'": "", "tokens are fine": None}
    for line, marker in lines.items():
        got = one(S.redact(F.lit(line), F.lit("m.md"), F.lit(3)))
        assert got == (line if marker is None else f"{marker}REDACTED — see canonical memory at `m.md` (line 3)")
    for subject, fix in {"fix: a": True, "Fixed b": True, "prefix c": False, "fix(x): d": True, "fixture": False}.items():
        assert one(S.says(F.lit(subject), S.FIX_WORDS)) is fix


def test_ddl_replay():
    got = ddl.replay([
        "CREATE TABLE IF NOT EXISTS s.a (id INT PRIMARY KEY, b_id INT REFERENCES b(id), PRIMARY KEY (id)); -- note\nCREATE TABLE b (id INT)",
        "ALTER TABLE a ADD COLUMN size INT; CREATE INDEX ix ON a (size, id)",
        "ALTER TABLE a RENAME COLUMN size TO length; ALTER TABLE b RENAME TO c",
    ])
    assert got["a"] == {"columns": ["id", "b_id", "length"], "fks": {"b_id": ("c", "id")}, "indexes": {"ix": ["length", "id"]}}
    after = ddl.replay(["CREATE TABLE a (x INT REFERENCES b(id)); CREATE TABLE b (id INT); DROP TABLE b; ALTER TABLE a DROP COLUMN x"])
    assert after == {"a": {"columns": [], "fks": {}, "indexes": {}}}
    assert ddl.tables_in_sql("SELECT * FROM s.t JOIN u ON 1=1; INSERT INTO t VALUES (1)") == ["t", "u"]


def test_chunks():
    assert search.chunk("") == [] and search.chunk("  x  ") == ["  x  "] and search.chunk("x" * 1800) == ["x" * 1800]
    two = search.chunk("x" * 1801)
    assert len(two) == 2 and two[1] == "x" * 401
    late = "a" * 1000 + "\n\n" + "b" * 1500
    assert search.chunk(late)[0] == "a" * 1000 + "\n\n" and search.chunk("a" * 900 + "\n\n" + "b" * 1500)[0] == "a" * 900 + "\n\n"
    assert search.chunk("a" * 899 + ". " + "b" * 1500)[0] == "a" * 899 + "." and len(search.chunk("a" * 898 + ". " + "b" * 1500)[0]) == 1800
    early = "a" * 100 + "\n\n" + "b" * 2500
    assert len(search.chunk(early)[0]) == 1800
    assert search.chunk("a" * 100 + "\n\n" + "b" * 1000 + ". " + "c" * 2000)[0].endswith("b.")


def test_json_scans(spark, tmp_path):
    (tmp_path / "_skip").mkdir()
    node = {"id": "r::p::x", "schema_version": 2, "edges_out": [{"target": "r::p::y", "kind": "calls"}]}
    (tmp_path / "a.json").write_text(json.dumps(node))
    (tmp_path / "old.json").write_text(json.dumps(node | {"id": "old", "schema_version": 1}))
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "_skip" / "b.json").write_text(json.dumps(node | {"id": "no"}))
    now, rest = documents.current(documents.nodes(spark, str(tmp_path)))
    assert [r.id for r in now.collect()] == ["r::p::x"] and [r.id for r in rest.collect()] == ["old"]
    assert [(r.src, r.dst, r.kind) for r in documents.edges(now).collect()] == [("r::p::x", "r::p::y", "calls")]
    for k, wrapped in enumerate((False, True)):
        index = {"y": [{"source": "x", "kind": "calls"}]}
        path = tmp_path / f"i{k}.txt"
        path.write_text(json.dumps({"by_target": index} if wrapped else index))
        assert [(r.dst, r.src) for r in documents.dependents(spark, str(path)).collect()] == [("y", "x")]


def test_event_log_and_dossiers(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"ts": "2024-01-02T00:00:00Z", "kind": "injection", "node_id": "a"}\nnot json\n{"ts": "2023-01-01T00:00:00Z", "kind": "injection"}\n')
    assert documents.events(spark, str(log)).count() == 2
    assert documents.events(spark, str(log), "2024-01-01").count() == 1
    (tmp_path / "d.md").write_text("---\nnode_id: a\nstatus: ok\n---\nBody")
    row = documents.dossiers(spark, str(tmp_path)).first()
    assert row.fm == {"node_id": "a", "status": "ok"} and row.body == "Body"
    (tmp_path / "package.json").write_text('{"dependencies": {"x": "1"}, "devDependencies": {"y": "2"}}')
    (tmp_path / "requirements.txt").write_text("Flask==1\n# note\nnumpy\n")
    got = documents.packages(spark, [str(tmp_path / "package.json"), str(tmp_path / "requirements.txt")])
    assert sorted(r.package for r in got.collect()) == ["flask", "numpy", "x", "y"]
    sinks.append_events(spark.createDataFrame([("t", "k")], "ts string, kind string"), str(tmp_path / "out"))
    sinks.append_events(spark.createDataFrame([("t", "k")], "ts string, kind string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_python_code(spark):
    files = [
        ("r", "pkg/__init__.py", ""),
        ("r", "pkg/base.py", "class Base:\n    def run(self):\n        pass\n\ndef helper():\n    return 1\n"),
        ("r", "pkg/use.py", "import os\nfrom .base import Base, helper\nfrom pkg import base\n\nclass Child(Base):\n    pass\n\ndef go():\n    helper()\n    Child()\n    os.path.join('a')\n"),
        ("r", "bad.py", "def ("),
    ]
    found = python_code.extract(spark.createDataFrame(files, "repo string, path string, text string"))
    got = {(r.src.removeprefix("r::"), r.dst.removeprefix("r::"), r.kind, r.confidence) for r in python_code.resolve(found).collect()}
    assert ("pkg/use.py::Child", "pkg/base.py::Base", "extends", "exact") in got
    assert ("pkg/use.py::go", "pkg/base.py::helper", "calls", "exact") in got
    assert ("pkg/use.py::go", "pkg/use.py::Child", "instantiates", "exact") in got
    assert ("pkg/use.py::go", "external::pypi::os::path.join", "calls", "external") in got
    assert ("pkg/base.py::Base", "pkg/base.py::Base.run", "defines", "exact") in got
    assert ("pkg/use.py", "external::pypi::os", "imports", "external") in got


def test_streams_equal_batches(spark, tmp_path):
    from lodestone.streaming import telemetry as T

    rows = [(i, f"2024-01-0{1 + i % 9}T0{i % 6}:00:00", ["injection", "acknowledgment"][i % 2], i % 3) for i in range(40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "ts", "kind", "node_id"), r))) for r in rows) + "\nbroken\n")
    T.drain(T.acknowledged(T.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {(r.event_id, r.ack_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = spark.read.schema(T.EVENT).option("mode", "DROPMALFORMED").json(str(tmp_path / "in"))
    i, a = batch.where("kind = 'injection'"), batch.where("kind = 'acknowledgment'")
    want = i.alias("i").join(a.alias("a"), F.expr("i.node_id = a.node_id AND a.ts BETWEEN i.ts AND i.ts + INTERVAL 6 HOURS")).select("i.event_id", F.col("a.event_id").alias("ack_id"))
    assert got == {(r.event_id, r.ack_id) for r in want.collect()} and got


def test_closure_of_a_long_chain_takes_few_hops(spark, monkeypatch):
    hops = []
    counted = traverse._counted
    monkeypatch.setattr(traverse, "_counted", lambda df: hops.append(1) or counted(df))
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(2000)] + [("n7", "x"), ("x", "n3"), ("n2000", "n1990"), ("z0", "z1"), ("z1", "z0")]
    got = {r.node for r in traverse.closure(ids(spark, "n0"), edges(spark, pairs)).collect()}
    assert got == {f"n{i}" for i in range(2001)} | {"x"} and len(hops) < 60
    assert {r.node for r in traverse.closure(ids(spark, "n0"), edges(spark, pairs), ids(spark, "n1500")).collect()} == {f"n{i}" for i in range(1500)} | {"x"}


@pytest.mark.parametrize(("command", "want"), [
    ("nohup rm -rf build", ["rm with -r/-f flags"]), ("env A=1 -u B git push", ["git push (real, not dry-run)"]), ("sudo -u root env X=y git reset --hard", ["sudo (privileged execution)", "git reset --hard"]),
    ("timeout -k 1 5 rm -f a", ["rm with -r/-f flags"]), ("nice -n 5 npm publish", ["npm publish"]), ("sudo -u", ["sudo (privileged execution)"]), ("env rm", []), ("ls | xargs -n 1 rm -f", ["rm with -r/-f flags"]),
])
def test_wrapped_commands(command, want):
    from lodestone.functions import commands

    assert commands.findings(command) == want


def test_numbers_are_dense_whatever_the_ranges(spark):
    from lodestone.operators import numbering

    rows = [(i * 7 % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int")
    got = {(x.k, x.i): x.row for x in numbering.numbered(df, "k", "i").collect()}
    assert got == {r: n for n, r in enumerate(sorted(rows))}
    assert numbering.numbered(df.limit(0), "k").count() == 0
