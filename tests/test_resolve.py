"""Name resolution: chains, circles and caps of re-exports, prefixes, typed receivers in order, anchors, and all of it on Python files."""

import random

from lodestone.operators import resolve as R
from lodestone.sources import python_code

IMPORTS = "module string, ord int, via string, name string, binding string, target string"


def closed(spark, imports, symbols, packages, cap=R.CAP):
    got = R.reexports(spark.createDataFrame(imports, IMPORTS), spark.createDataFrame(symbols, "module string, name string, id string"), spark.createDataFrame([(p,) for p in packages], "id string"), cap)
    return {(r.module, r.ord): (r.target, r.moved) for r in got.collect()}


def walked(imports, symbols, packages, cap=R.CAP):
    """The same by rounds over dictionaries."""
    rows = [list(r) for r in sorted(imports, key=lambda r: (r[0], r[1]))]
    of = {}
    for module, name, i in symbols:
        of.setdefault(module, {})[name] = i
    before = {}
    for _ in range(cap):
        offers = {}
        for p in packages:
            named = {r[4]: r[5] for r in rows if r[0] == p and r[2] != "wildcard" and r[4]}
            for r in rows:
                if r[0] == p and r[2] == "wildcard":
                    for name, i in [*of.get(r[5], {}).items(), *before.get(r[5], {}).items()]:
                        if name[0] != "_":
                            named.setdefault(name, i)
            offers[p] = named
        moved = False
        for r in rows:
            to = offers.get(r[5], {}).get(r[3]) if r[2] == "import_from" else None
            if to and to != r[5]:
                r[5], moved = to, True
        if not moved and offers == before:
            break
        before = offers
    start = {(r[0], r[1]): r[5] for r in imports}
    return {(r[0], r[1]): (r[5], r[5] != start[r[0], r[1]]) for r in rows}


def test_reexports_through_chains_circles_and_the_cap(spark):
    chain = [(f"p{i}", 1, "wildcard", None, None, f"p{i + 1}") for i in range(14)] + [("m0", 1, "import_from", "x", "x", "p6"), ("m0", 2, "import_from", "x", "x", "p0"), ("m0", 3, "import_from", "_y", "_y", "p13")]
    symbols = [("p14", "x", "p14::x"), ("p14", "_y", "p14::_y")]
    packages = [f"p{i}" for i in range(15)]
    got = closed(spark, chain, symbols, packages)
    assert got == walked(chain, symbols, packages)
    assert got["m0", 1] == ("p14::x", True) and got["m0", 2] == ("p0", False) and got["m0", 3] == ("p13", False)
    assert closed(spark, chain, symbols, packages, 20)["m0", 2] == ("p14::x", True)
    circle = [("a", 1, "import_from", "n", "n", "b"), ("b", 1, "import_from", "n", "n", "a"), ("m", 1, "import_from", "n", "n", "a"), ("a", 2, "wildcard", None, None, "b")]
    assert closed(spark, circle, [], ["a", "b"], 3) == walked(circle, [], ["a", "b"], 3)


def test_reexports_equal_rounds_over_dictionaries(spark):
    r = random.Random(8)
    packages, leaves, names = [f"p{i}" for i in range(6)], ["l0", "l1"], ["x", "y", "_z", "w"]
    symbols = [(m, n, f"{m}::{n}") for m in leaves for n in names if r.random() < 0.7]
    for _ in range(3):
        rows = []
        for m in packages + ["m0", "m1"]:
            for k in range(4):
                via, to, n = r.choice(["import_from", "import_from", "wildcard", "import"]), r.choice(packages + leaves), r.choice(names)
                rows.append((m, k, via, n if via == "import_from" else None, None if via == "wildcard" else r.choice([n, "q"]), to))
        assert closed(spark, rows, symbols, packages) == walked(rows, symbols, packages)


def test_longest_prefix_wins(spark):
    uses = spark.createDataFrame([(1, "m", "a.b.c"), (2, "m", "a.x"), (3, "m", "z"), (4, "n", "a.b"), (5, "m", None), (6, "m", "a.bc"), (7, "m", "")], "k int, module string, chain string")
    names = spark.createDataFrame([("m", "a", "A"), ("m", "a.b", "AB"), ("n", "a.b.c", "no")], "module string, name string, target string")
    got = {r.k: (r.target, r.parts) for r in R.longest_prefix(uses, names, ["k"], "chain").collect()}
    assert got == {1: ("AB", 2), 2: ("A", 1), 3: (None, None), 4: (None, None), 5: (None, None), 6: ("A", 1), 7: (None, None)}


def test_anchors_through_long_chains_and_circles(spark):
    rows = [(f"r{i}", "relationship", None, None, f"r{i + 1}") for i in range(300)] + [("r300", "resource", "f", "t", None), ("c0", "relationship", None, None, "c1"), ("c1", "relationship", None, None, "c2"), ("c2", "relationship", None, None, "c1"), ("s", "relationship", None, None, "s"), ("g", "relationship", None, None, "gone"), ("n", "relationship", None, None, None), ("role", "role", "f", "B", None), ("at", "attribute", "f", None, None), ("far", "resource", "g", "u", None)]
    models = [("m2", "f", "t", "A"), ("m1", "f", None, "B"), ("m0", "x", "u", "C")]
    got = {x.id: (x.model, x.how) for x in R.anchors(spark.createDataFrame(rows, "id string, subkind string, defined_in string, table_name string, mediated_by string"), spark.createDataFrame(models, "id string, file string, tablename string, name string")).collect()}
    assert len(got) == len(rows) and got["r0"] == got["r299"] == ("m2", "via_mediated_by") and got["r300"] == ("m2", "table_match")
    assert all(got[k] == (None, "not_found") for k in ("c0", "c1", "c2", "s", "g", "n"))
    assert got["role"] == ("m1", "class_name_match") and got["at"] == ("m1", "defined_in") and got["far"] == ("m0", "table_match")


FILES = {
    "pkg/__init__.py": "from .api import *\nfrom sqlalchemy.orm import Session as Db\nfrom .db import Lost\n",
    "pkg/api/__init__.py": "from .impl import Client, _hidden\nfrom .impl import helper\n",
    "pkg/api/impl.py": "import requests\n\nclass Base:\n    def close(self):\n        pass\n\nclass Client(Base):\n    def send(self):\n        self.flush()\n        return requests.post('x')\n    def flush(self):\n        pass\n    @staticmethod\n    def make(c):\n        c.flush()\n\ndef helper():\n    pass\n\ndef _hidden():\n    pass\n",
    "pkg/db.py": "from sqlalchemy.orm import Session\nimport sqlalchemy.orm\n\nclass Row(sqlalchemy.orm.Mapped):\n    pass\n\nclass Mine(Exception):\n    pass\n",
    "var.py": "LIMIT: int = 3\nNAMES = OTHER = []\n\ndef look(x):\n    global LIMIT\n    LIMIT = x\n    y = NAMES\n    return LIMIT + y\n\ndef Row():\n    pass\n",
    "use.py": "import pkg\nimport pkg.api.impl as impl\nfrom pkg import Client, Db, helper, Nothing\n\ndef deco(f):\n    return f\n\n@deco\ndef go(c: Client, d: 'Db | None', n: list):\n    c.send()\n    d.query()\n    n.append(1)\n    e = c\n    e.send()\n    e = Client()\n    e.close()\n    e.flush()\n    if True:\n        with Client() as e:\n            e.send()\n        if True:\n            with Client() as w:\n                pass\n    w.send()\n    helper()\n    impl.helper()\n    a.b.c()\n\ndef test_it():\n    assert helper()\n",
}


def test_python_files(spark):
    rows = [("r", p, t) for p, t in FILES.items()]
    found = python_code.extract(spark.createDataFrame(rows, "repo string, path string, text string"))
    got = {(x.src.removeprefix("r::"), x.dst.replace("r::", ""), x.kind, x.confidence) for x in python_code.resolve(found).collect()}
    client, go = "pkg/api/impl.py::Client", "use.py::go"
    for want in [
        ("use.py", client, "imports", "exact"), ("use.py", "external::pypi::sqlalchemy::Session", "imports", "external"), ("use.py", "pkg/api/impl.py::helper", "imports", "exact"), ("use.py", "pkg/__init__.py", "imports", "exact"), ("pkg/__init__.py", "pkg/db.py", "imports", "exact"),
        ("pkg/__init__.py", "pkg/api/__init__.py", "imports", "fuzzy"), (client, "pkg/api/impl.py::Base", "extends", "exact"), ("pkg/db.py::Row", "external::pypi::sqlalchemy::Mapped", "extends", "external"), ("pkg/db.py::Mine", "external::builtins::Exception", "extends", "external"),
        (f"{client}.send", f"{client}.flush", "calls", "exact"), (f"{client}.send", "external::pypi::requests::post", "calls", "exact"), (f"{client}.make", "external::unresolved::c.flush", "calls", "unresolved_receiver"),
        (go, f"{client}.send", "calls", "exact"), (go, "external::pypi::sqlalchemy::Session::query", "calls", "external"), (go, "external::builtins::list::append", "calls", "external"), (go, client, "instantiates", "exact"),
        (go, f"external::unresolved::{client}.close", "calls", "unresolved_internal"), (go, f"{client}.flush", "calls", "exact"), (go, "pkg/api/impl.py::helper", "calls", "exact"), ("use.py::deco", go, "decorates", "exact"),
        ("use.py::test_it", "pkg/api/impl.py::helper", "tests", "exact"), ("pkg/api/impl.py", client, "defines", "exact"),
        ("var.py::look", "var.py::LIMIT", "reads", "exact"), ("var.py::look", "var.py::LIMIT", "assigns", "exact"), ("var.py::look", "var.py::NAMES", "reads", "exact"), ("var.py", "var.py::OTHER", "defines", "exact"),
    ]:
        assert want in got, want
    # The breadth-first order: a binding that lies deeper than the call comes after it; e is typed by its assignment before any call.
    assert (go, "external::unresolved::w.send", "calls", "unresolved_receiver") in got and not any(x[1].endswith("::e.send") for x in got)
    assert not any(x[1] == "var.py::OTHER" and x[2] != "defines" for x in got) and ("var.py::look", "var.py::NAMES", "assigns", "exact") not in got
    assert not any("c()" in x[1] or x[1].endswith("a.b.c") for x in got)
