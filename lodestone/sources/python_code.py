"""Symbols and edges of Python source files: facts per file in parallel, names resolved by the joins of operators/resolve.py."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import resolve as R

FACTS = "what string, repo string, path string, id string, primitive string, name string, owner string, line int, target string, module string, level int, ord int, var string"


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else ""
    return ""


def _type_names(node: ast.AST | None) -> list[str]:
    """Names at the root of an annotation, one for each branch of a union; what a container holds is left out."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            node = ast.parse(node.value, mode="eval").body
        except SyntaxError:
            return []
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr):
        return _type_names(node.left) + _type_names(node.right)
    if isinstance(node, ast.Subscript) and (head := _dotted(node.value).rpartition(".")[2]) in ("Optional", "Union", "Annotated"):
        inner = node.slice.elts if isinstance(node.slice, ast.Tuple) else [node.slice]
        return [n for x in (inner[:1] if head == "Annotated" else inner) for n in _type_names(x)]
    if isinstance(node, ast.Subscript):
        return _type_names(node.value)
    return [node.id] if isinstance(node, ast.Name) else []


def _events(fn: ast.AST, in_class: bool) -> Iterator[tuple[str, int, str | None, str | None, int]]:
    """(op, place, variable, name, line) of what types variables and of calls, breadth first: what lies deeper comes later."""
    every = [*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs, *filter(None, (fn.args.vararg, fn.args.kwarg))]
    for a in every:
        for n in _type_names(a.annotation):
            yield "annotate", 0, a.arg, n, fn.lineno
    static = any(_dotted(d) == "staticmethod" for d in fn.decorator_list)
    if in_class and fn.args.args and not static:
        yield "self", 1, fn.args.args[0].arg, None, fn.lineno
    made = lambda v: v.func.id if isinstance(v, ast.Call) and isinstance(v.func, ast.Name) else None
    for at, node in enumerate(ast.walk(fn), 2):
        if isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            for n in _type_names(node.annotation):
                yield "annotate", at, node.target.id, n, node.lineno
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and made(node.value):
            yield "make", at, node.targets[0].id, made(node.value), node.lineno
        elif isinstance(node, ast.NamedExpr) and made(node.value):
            yield "make", at, node.target.id, made(node.value), node.lineno
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                if isinstance(item.optional_vars, ast.Name) and made(item.context_expr):
                    yield "make", at, item.optional_vars.id, made(item.context_expr), node.lineno
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            yield "call", at, None, node.func.id, node.lineno
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Name):
            yield "call", at, node.func.value.id, node.func.attr, node.lineno
        elif isinstance(node, ast.Call) and (d := _dotted(node.func)):
            yield "chain", at, d.partition(".")[0], d.partition(".")[2], node.lineno


def facts(repo: str, path: str, text: str) -> list[tuple]:
    """Rows of FACTS: symbols, imports, bases, decorators, asserted calls, the module's variables that functions read and assign, and the events of functions; none for a file that does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    here = f"{repo}::{path}"
    out = [("symbol", repo, path, here, "module", path, None, 1, None, None, 0, 0, None)]

    def put(what, id_, line, primitive=None, name=None, owner=None, target=None, module=None, level=0, ord_=0, var=None):
        out.append((what, repo, path, id_, primitive, name, owner, line, target, module, level, ord_, var))

    # Variables of the module: what its own statements assign; the first line of each counts.
    variables: dict[str, int] = {}
    for statement in tree.body:
        targets = statement.targets if isinstance(statement, ast.Assign) else [statement.target] if isinstance(statement, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Name):
                variables.setdefault(t.id, statement.lineno)
    for name, line in variables.items():
        put("symbol", f"{here}::{name}", line, "variable", name, here)

    def visit(node: ast.AST, owner: str, prefix: str, inside: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}{child.name}"
                me = f"{here}::{name}"
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                put("symbol", me, child.lineno, kind, name, owner)
                for at, b in enumerate(getattr(child, "bases", [])):
                    if d := _dotted(b):
                        chain, _, last = d.rpartition(".")
                        put("base", me, child.lineno, name=last, owner=owner, target=chain or None, ord_=at)
                for d in child.decorator_list:
                    if n := _dotted(d.func if isinstance(d, ast.Call) else d):
                        put("decorator", me, child.lineno, name=n.partition(".")[0], owner=owner, target=n)
                if kind == "function" and inside != "function":
                    for op, at, var, called, line in _events(child, inside == "class"):
                        put(op, me, line, name=called, owner=owner, ord_=at, var=var)
                    for x in ast.walk(child):
                        if isinstance(x, ast.Name) and x.id in variables and isinstance(x.ctx, (ast.Load, ast.Store)):
                            put("load" if isinstance(x.ctx, ast.Load) else "store", me, x.lineno, name=x.id, owner=owner)
                    for check in (x for x in ast.walk(child) if isinstance(x, ast.Assert)):
                        for c in ast.walk(check.test):
                            if isinstance(c, ast.Call) and isinstance(c.func, ast.Name):
                                put("asserted", me, c.lineno, name=c.func.id, owner=owner)
                visit(child, me, name + ".", kind)
                continue
            if isinstance(child, ast.Import):
                for a in child.names:
                    put("import", here, child.lineno, name=a.asname or a.name, module=a.name)
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    put("star" if a.name == "*" else "from", here, child.lineno, name=a.asname or a.name, target=a.name, module=child.module or "", level=child.level)
            visit(child, owner, prefix, inside)

    visit(tree, here, "", "module")
    return out


def extract(files: DataFrame) -> DataFrame:
    """FACTS of rows (repo, path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [f for r, p, t in zip(pdf["repo"], pdf["path"], pdf["text"]) for f in facts(r, p, t or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.select("repo", "path", "text").mapInPandas(run, FACTS)


def symbols(found: DataFrame) -> DataFrame:
    return found.where("what = 'symbol'").select("id", "repo", "path", "primitive", "name", "owner", "line")


def imports(found: DataFrame) -> DataFrame:
    """What imports say before packages are seen through, as operators/resolve.py takes it: module, ord, via, name, binding, target."""
    bare = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", "")
    module = found.where("what = 'symbol' AND primitive = 'module'").select("repo", F.regexp_replace(bare, "/", ".").alias("full"), F.col("id").alias("module_id"))
    # The package that a relative import starts from: as many parts off the file's path as the level says.
    parts = F.split("path", "/")
    package = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - F.col("level"), F.lit(0))), ".")
    full = F.when(F.col("level") > 0, F.concat_ws(".", F.when(package != "", package), F.when(F.col("module") != "", F.col("module")))).otherwise(F.col("module"))
    imp = found.where("what IN ('import', 'from', 'star')").withColumn("full", full)
    # `from package import module`: the name may be a module of its own.
    own = module.select("repo", F.col("full").alias("whole"), F.col("module_id").alias("sub_id"))
    imp = imp.withColumn("whole", F.when(F.col("what") == "from", F.concat_ws(".", F.when(F.col("full") != "", F.col("full")), "target")))
    imp = imp.join(module, ["repo", "full"], "left").join(own, ["repo", "whole"], "left")
    symbol = symbols(found).where("primitive <> 'module'").select(F.col("id").alias("wanted"), F.lit(True).alias("known"))
    imp = imp.withColumn("wanted", F.when(F.col("what") == "from", F.concat_ws("::", "module_id", "target"))).join(symbol, "wanted", "left")
    root = F.concat(F.lit("external::pypi::"), F.coalesce(F.nullif(F.split_part("full", F.lit("."), F.lit(1)), F.lit("")), F.lit("unknown")))
    outside = F.when(F.col("what") == "from", F.concat_ws("::", root, "target")).otherwise(root)
    target = F.when(F.col("known"), F.col("wanted")).when(F.col("sub_id").isNotNull(), F.col("sub_id")).otherwise(F.coalesce("module_id", outside))
    via = F.when(F.col("what") == "star", "wildcard").when(F.col("what") == "from", "import_from").otherwise("import")
    rows = imp.select(F.col("id").alias("module"), F.col("line").alias("ord"), via.alias("via"), F.when(F.col("what") == "from", F.col("target")).alias("name"), F.when(F.col("what") != "star", F.col("name")).alias("binding"), target.alias("target"), "level")
    # A relative wildcard that leads nowhere says nothing.
    return rows.where("via <> 'wildcard' OR level = 0 OR NOT startswith(target, 'external::')").drop("level")


def resolve(found: DataFrame) -> DataFrame:
    """src, dst, kind, confidence: imports (seen through packages), bases, calls with typed receivers, reads and assignments of a module's variables, decorators, asserted calls and containment."""
    sym = symbols(found)
    top = sym.alias("s").join(sym.where("primitive = 'module'").select(F.col("id").alias("owner")), "owner", "left_semi").select(F.col("owner").alias("module"), "name", "id", "primitive")
    packages = sym.where("primitive = 'module' AND path RLIKE '(^|/)__init__[.]py$'").select("id")
    led = R.reexports(imports(found), top, packages)
    # A module's bindings, and the first part of a dotted one.
    names = R.bindings(led)
    at_module = found.withColumn("module_id", F.concat_ws("::", "repo", "path"))
    bases = at_module.where("what = 'base'").select(F.col("id").alias("src"), F.col("module_id").alias("module"), "ord", F.col("target").alias("chain"), "name")
    own = sym.where("primitive = 'class'").select(F.col("id").alias("owner"), F.lit(True).alias("in_class"))
    events = at_module.where("what IN ('annotate', 'make', 'self', 'call')").join(own, "owner", "left")
    events = events.select(F.col("id").alias("fn"), F.col("module_id").alias("module"), "ord", F.col("what").alias("op"), "var", F.when(F.col("what").isin("annotate", "make"), F.col("name")).alias("type"), F.when(F.col("what") == "call", F.col("name")).alias("name"), F.when(F.col("in_class"), F.col("owner")).alias("owner"))
    methods = sym.join(own.select(F.col("owner")), "owner", "left_semi").select(F.col("owner").alias("class"), F.substring_index("name", ".", -1).alias("name"), "id")
    sure = F.when(R.is_external("dst"), R.confidence(F.col("dst"))).otherwise("exact")
    meant = top.select("module", "name", F.col("id").alias("target"), F.lit(0).alias("rank")).unionByName(names.select("module", "name", "target", F.lit(1).alias("rank"))).groupBy("module", "name").agg(F.min_by("target", "rank").alias("dst"))
    use = at_module.where("what IN ('decorator', 'asserted')").select(F.col("id").alias("src"), F.col("module_id").alias("module"), "name", "what").join(meant, ["module", "name"])
    inside = use.join(sym.where("primitive IN ('class', 'function')").select(F.col("id").alias("dst"), F.col("primitive").alias("dst_kind")), "dst")
    parts = [
        led.select(F.col("module").alias("src"), F.col("target").alias("dst"), F.lit("imports").alias("kind"), F.when(R.is_external("target"), "external").when(F.col("via") == "wildcard", "fuzzy").otherwise("exact").alias("confidence")),
        R.base_classes(bases, names, top).select("src", F.col("target").alias("dst"), F.lit("extends").alias("kind"), "confidence"),
        R.call_edges(events, names, top, methods).select(F.col("fn").alias("src"), F.col("target").alias("dst"), "kind", "confidence"),
        # A chain of names says something only if it begins outside.
        at_module.where("what = 'chain'").select(F.col("id").alias("src"), F.col("module_id").alias("module"), F.col("name").alias("rest"), F.col("var").alias("name")).join(names.where(R.is_external("target")), ["module", "name"]).select("src", F.concat_ws("::", "target", "rest").alias("dst"), F.lit("calls").alias("kind"), F.lit("external").alias("confidence")),
        # What decorates points at what it decorates.
        inside.where("what = 'decorator'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("decorates").alias("kind"), F.lit("exact").alias("confidence")),
        at_module.where("what IN ('load', 'store')").select(F.col("id").alias("src"), F.concat_ws("::", "module_id", "name").alias("dst"), F.when(F.col("what") == "load", "reads").otherwise("assigns").alias("kind"), F.lit("exact").alias("confidence")),
        inside.where("what = 'asserted' AND dst_kind = 'function'").select("src", "dst", F.lit("tests").alias("kind"), sure.alias("confidence")),
        sym.where("owner IS NOT NULL").select(F.col("owner").alias("src"), F.col("id").alias("dst"), F.lit("defines").alias("kind"), F.lit("exact").alias("confidence")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
