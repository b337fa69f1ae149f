"""The schema compiler against a walk over parsed values, sinks that leave alone what did not change, and keyed state over restarts."""

import json
import os
import random

from pyspark.sql import functions as F

from lodestone.operators import schema as V
from lodestone.sources import sinks

SCHEMA = {
    "type": "object", "required": ["id", "kind", "source"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+::", "minLength": 4, "maxLength": 12}, "kind": {"enum": ["a", "b", 1, None]}, "n": {"type": "integer", "minimum": 0, "maximum": 9},
        "source": {"type": "object", "required": ["path"], "properties": {"path": {"type": "string"}, "line": {"type": ["integer", "null"]}}},
        "edges": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "required": ["to"], "properties": {"to": {"type": "string", "pattern": "::"}}}},
        "who": {"oneOf": [{"type": "string"}, {"type": "integer", "minimum": 5}]}, "any": {"anyOf": [{"const": True}, {"type": "number"}]}, "no": {"not": {"type": "string"}}, "all": {"allOf": [{"minimum": 1}, {"maximum": 3}]},
    },
}


def walked(schema, v, path="$"):
    import re

    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    is_ = {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "boolean": isinstance(v, bool), "null": v is None, "number": number, "integer": number and float(v).is_integer()}
    same = lambda a, b: json.dumps(a) == json.dumps(b)
    out = []
    put = lambda bad, k, at=path: out.append(f"{at}: {k}") if bad else None
    types = schema.get("type", [])
    put(types and not any(is_[t] for t in ([types] if isinstance(types, str) else types)), "type")
    put("enum" in schema and not any(same(v, x) for x in schema["enum"]), "enum")
    put("const" in schema and not same(v, schema["const"]), "const")
    if is_["string"]:
        put("pattern" in schema and not re.search(schema["pattern"], v), "pattern")
        put(len(v) < schema.get("minLength", 0), "minLength")
        put(len(v) > schema.get("maxLength", 1e9), "maxLength")
    if number:
        put(v < schema.get("minimum", -1e99), "minimum")
        put(v > schema.get("maximum", 1e99), "maximum")
    if is_["object"]:
        for k in schema.get("required", ()):
            put(k not in v, "required", f"{path}.{k}")
        for k, x in v.items():
            if k in schema.get("properties", {}):
                out += walked(schema["properties"][k], x, f"{path}.{k}")
            else:
                put(schema.get("additionalProperties") is False, "additionalProperties", f"{path}.{k}")
    if is_["array"]:
        put(len(v) < schema.get("minItems", 0), "minItems")
        put(len(v) > schema.get("maxItems", 1e9), "maxItems")
        for i, x in enumerate(v):
            out += walked(schema.get("items", {}), x, f"{path}[{i}]")
    for s in schema.get("allOf", ()):
        out += walked(s, v, path)
    fits = lambda options: sum(not walked(s, v, path) for s in options)
    put("anyOf" in schema and not fits(schema["anyOf"]), "anyOf")
    put("oneOf" in schema and fits(schema["oneOf"]) != 1, "oneOf")
    put("not" in schema and fits([schema["not"]]), "not")
    return out


def test_violations_equal_a_walk(spark):
    r = random.Random(7)
    value = lambda: r.choice(["a", "b::c", "ab::x", "", 1, 7, 12, -1, 2.5, 3.0, True, False, None, [], [1], {}, {"path": "p"}, {"path": 3, "line": None}, {"path": "p", "line": 1.5}, [{"to": "a::b"}, {"to": "a"}, {}], [{"to": "::"}] * 4])
    docs = [{k: value() for k in [*SCHEMA["properties"], "odd", "an odd one"] if r.random() < 0.7} for _ in range(400)] + [{}, [], "x", 3]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, "{bad"), (-2, None)], "i int, t string")
    got = {x.i: sorted(x.v) for x in df.select("i", V.conforms(SCHEMA, F.col("t")).alias("v")).collect()}
    assert got.pop(-1) == got.pop(-2) == ["$: json"]
    assert got == {i: sorted(walked(SCHEMA, d)) for i, d in enumerate(docs)}


def files(folder):
    return sorted((os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, names in os.walk(folder) for f in names)


def test_only_changed_partitions_are_written(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"r{i % 4}", ["py", "ts", None][i % 3], i, f"v{i}") for i in range(60)]
    make = lambda rows: spark.createDataFrame(rows, "repo string, lang string, id long, `a.b` string").repartition(3)
    back = lambda: [tuple(x) for x in sinks.read_current(spark, folder).collect()] if sinks.read_current(spark, folder) else []
    key = lambda r: (r[0], r[1] or "")
    assert sinks.read_current(spark, folder) is None
    assert {x.what for x in sinks.write_changed(make(rows), folder, "repo", "lang").collect()} == {"added"} and sorted(back(), key=str) == sorted(rows, key=str)
    before = files(folder)
    assert sinks.write_changed(make(rows[::-1]), folder, "repo", "lang").count() == 0 and files(folder) == before
    new = [r if r[2] != 5 else (*r[:3], "other") for r in rows if key(r) != ("r1", "ts")] + [("r9", None, 1, None), ("r9", None, 1, None)]
    got = {(x.repo, x.lang): x.what for x in sinks.write_changed(make(new), folder, "repo", "lang").collect()}
    assert got == {("r1", None): "changed", ("r1", "ts"): "removed", ("r9", None): "added"}
    assert sorted(back(), key=str) == sorted(new, key=str) and {x for x in before if "/part-" in x[0]} <= set(files(folder))
    one_less = new[:-1]
    assert [x.what for x in sinks.write_changed(make(one_less), folder, "repo", "lang").collect()] == ["changed"] and len(back()) == len(one_less)
    sinks.write_changed(make([]), folder, "repo", "lang")
    assert back() == []


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    from lodestone.streaming import telemetry as T

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "node_id long, content_hash string, ts timestamp, text string"
    known = spark.createDataFrame([(1, "a"), (9, "z")], "node_id long, content_hash string")

    def run(n, rows):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("node_id", "content_hash", "ts", "text"), r))) for r in rows))
        stream = spark.readStream.schema(schema).json(str(source))
        got = []
        q = T.changed(stream, known).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend((r.node_id, r.content_hash, r.was) for r in df.collect())).start()
        q.awaitTermination()
        return sorted(got, key=str)

    day = "2024-01-0{}T00:00:00Z".format
    assert run(1, [(1, "a", day(1), "x"), (2, "b", day(1), "y"), (3, "c", day(1), "z"), (3, "d", day(2), "z2")]) == [(2, "b", None), (3, "d", None)]
    assert run(2, [(1, "a2", day(3), "x2"), (2, "b", day(3), "y"), (3, "c", day(4), "z"), (9, "z", day(3), "w")]) == [(1, "a2", "a"), (3, "c", "d")]
    assert run(3, [(1, "a2", day(5), "x2")]) == []
