"""JSON-schema conformance as columns: a schema is compiled once into an expression that lists each violation with its path.

Understands type, enum, const, required, properties, additionalProperties (false), pattern, minLength, maxLength, minimum, maximum,
items, minItems, maxItems, allOf, anyOf, oneOf and not. As in JSON schema, a keyword speaks only of values of its type. The expression runs in the JVM in one
pass over a variant; nothing is parsed twice and no function of Python is called.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a type's values are called by the engine.
_PREFIXES = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")}
NONE = "array<string>"


def _named(path: Column, name: str) -> Column:
    return F.concat(path, F.lit("." + name))


def _is(kind: Column, type_: str) -> Column:
    if type_ == "integer":
        return kind.startswith("BIGINT") | kind.rlike(r"^DECIMAL\([0-9]+,0\)$")
    tests = [kind.startswith(p) for p in _PREFIXES[type_]]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def violations(schema: dict, v: Column, path: Column | None = None) -> Column:
    """array<string> of `path: keyword` for a variant; a missing value (null) violates nothing, what requires it says so."""
    path = F.lit("$") if path is None else path
    kind = F.schema_of_variant(v)
    simple: list[Column] = []
    nested: list[Column] = []

    def say(broken: Column, keyword: str, at: Column = path) -> None:
        simple.append(F.when(v.isNotNull() & broken, F.concat(at, F.lit(": " + keyword))))

    if "type" in schema:
        types = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        fits = F.lit(False)
        for t in types:
            fits = fits | _is(kind, t)
        say(~fits, "type")
    for keyword, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if values is not None:
            # Compared as JSON texts, so that 1 and "1" differ.
            say(~F.to_json(v).isin(*[json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in values]), keyword)
    of_string, of_number, of_object, of_array = (_is(kind, t) for t in ("string", "number", "object", "array"))
    if "pattern" in schema:
        say(of_string & ~_text(v).rlike(schema["pattern"]), "pattern")
    for keyword, test in (("minLength", lambda n: F.length(_text(v)) < n), ("maxLength", lambda n: F.length(_text(v)) > n)):
        if keyword in schema:
            say(of_string & test(schema[keyword]), keyword)
    number = F.try_variant_get(v, "$", "double")
    for keyword, test in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
        if keyword in schema:
            say(of_number & test(schema[keyword]), keyword)
    members = schema.get("properties", {})
    get = lambda name: F.try_variant_get(v, "$['" + name + "']", "variant")
    for name in schema.get("required", ()):
        say(of_object & get(name).isNull(), "required", _named(path, name))
    for name, inner in members.items():
        nested.append(violations(inner, get(name), _named(path, name)))
    if schema.get("additionalProperties") is False:
        odd = F.array_sort(F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*map(F.lit, members)).cast(NONE)))
        nested.append(F.transform(odd, lambda k: F.concat(path, F.lit("."), k, F.lit(": additionalProperties"))))
    parts = F.try_variant_get(v, "$", "array<variant>")
    for keyword, test in (("minItems", lambda n: F.size(parts) < n), ("maxItems", lambda n: F.size(parts) > n)):
        if keyword in schema:
            say(of_array & test(schema[keyword]), keyword)
    if "items" in schema:
        nested.append(F.flatten(F.transform(parts, lambda x, i: violations(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    for inner in schema.get("allOf", ()):
        nested.append(violations(inner, v, path))
    fitting = lambda options: sum((F.when(F.size(violations(o, v, path)) == 0, 1).otherwise(0) for o in options), F.lit(0))
    if "anyOf" in schema:
        say(fitting(schema["anyOf"]) < 1, "anyOf")
    if "oneOf" in schema:
        say(fitting(schema["oneOf"]) != 1, "oneOf")
    if "not" in schema:
        say(fitting([schema["not"]]) == 1, "not")
    own = F.array_compact(F.array(*simple)) if simple else F.array().cast(NONE)
    return F.concat(own, *[F.coalesce(n, F.array().cast(NONE)) for n in nested])


def conforms(schema: dict, text: Column) -> Column:
    """violations() of a JSON text; one that does not parse, or is missing, violates `$: json`."""
    v = F.try_parse_json(text)
    return F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(violations(schema, v))
