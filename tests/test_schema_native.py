"""The compiled schema against a plain validator on random documents."""

import json
import random
import re

import pytest

from strandlake.functions import schema_native

SCHEMA = {
    "type": "object",
    "required": ["a", "kind"],
    "minProperties": 2,
    "maxProperties": 5,
    "properties": {
        "a": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/$defs/value"}},
        "kind": {"enum": ["x", 2, None, True]},
        "n": {"type": ["integer", "null"], "minimum": -1, "exclusiveMaximum": 3},
        "d": {"oneOf": [{"type": "number"}, {"minimum": 2}, {"type": "string", "pattern": "b+$"}]},
        "e": {"not": {"type": "string"}, "allOf": [{"maximum": 5}, {"const": 1.5}]},
    },
    "additionalProperties": {"anyOf": [{"type": "boolean"}, {"type": "object", "additionalProperties": False, "properties": {"z": {"$ref": "#/$defs/value"}}}]},
    "$defs": {"value": {"type": ["string", "object", "number"], "minLength": 1, "maxLength": 2, "required": ["q"], "exclusiveMinimum": 0, "x-note": 1}},
}


def is_(v, kind):
    if kind in ("number", "integer"):
        return isinstance(v, (int, float)) and not isinstance(v, bool) and (kind == "number" or float(v).is_integer())
    return isinstance(v, {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}[kind])


def same(v, e):
    return type(v) is type(e) and v == e if isinstance(e, (bool, str, type(None))) or isinstance(v, bool) else is_(v, "number") and v == e


def plain(schema, v, at="$", root=SCHEMA):
    if "$ref" in schema:
        schema = root["$defs"][schema["$ref"].rsplit("/", 1)[1]]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(is_(v, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    out, fits = [], lambda s: not plain(s, v, at, root)
    if "enum" in schema and not any(same(v, e) for e in schema["enum"]):
        out.append(f"{at}: not one of the listed values")
    if "const" in schema and not same(v, schema["const"]):
        out.append(f"{at}: not the listed value")
    if isinstance(v, str):
        out += [f"{at}: too short"] * (len(v) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(v) > schema.get("maxLength", 99)) + [f"{at}: does not match the pattern"] * (not re.search(schema.get("pattern", ""), v))
    if is_(v, "number") and (v < schema.get("minimum", v) or v > schema.get("maximum", v) or v <= schema.get("exclusiveMinimum", v - 1) or v >= schema.get("exclusiveMaximum", v + 1)):
        out.append(f"{at}: out of range")
    if isinstance(v, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}: {n} is required" for n in schema.get("required", []) if n not in v]
        out += [f"{at}: too few properties"] * (len(v) < schema.get("minProperties", 0)) + [f"{at}: too many properties"] * (len(v) > schema.get("maxProperties", 99))
        out += [x for n, s in known.items() if n in v for x in plain(s, v[n], f"{at}.{n}", root)]
        for n in sorted(v):
            if n not in known and more is not True:
                out += [f"{at}: {n} is not allowed"] if more is False else plain(more, v[n], f"{at}.{n}", root)
    if isinstance(v, list):
        out += [f"{at}: too few items"] * (len(v) < schema.get("minItems", 0)) + [f"{at}: too many items"] * (len(v) > schema.get("maxItems", 99))
        out += [x for i, y in enumerate(v) for x in plain(schema.get("items", {}), y, f"{at}[{i}]", root)]
    for s in schema.get("allOf", []):
        out += plain(s, v, at, root)
    if "anyOf" in schema and not any(map(fits, schema["anyOf"])):
        out.append(f"{at}: fits none of the alternatives")
    if "oneOf" in schema and (n := sum(map(fits, schema["oneOf"]))) != 1:
        out.append(f"{at}: fits {n} of the alternatives, not one")
    if "not" in schema and fits(schema["not"]):
        out.append(f"{at}: fits what is ruled out")
    return out


def test_random_documents(spark):
    rng = random.Random(5)

    def value(depth=0):
        kind = rng.randrange(8 if depth < 2 else 6)
        if kind == 6:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        if kind == 7:
            return {rng.choice("qzab"): value(depth + 1) for _ in range(rng.randrange(3))}
        return [None, True, rng.randrange(-2, 5), rng.choice([1.5, 2.0, -0.5]), rng.choice(["", "x", "xb", "long b"]), "é"][kind]

    docs = [{n: value() for n in rng.sample(["a", "kind", "n", "d", "e", "f", "g"], rng.randrange(8))} for _ in range(250)] + [value() for _ in range(20)]
    docs += [{"a": [{"q": 1}, "x"], "kind": "x", "e": 1.5, "f": {"z": 1}}, {"a": ["x"], "kind": 2}]
    df = spark.createDataFrame([(n, json.dumps(d)) for n, d in enumerate(docs)] + [(-1, "no json"), (-2, None)], "n long, doc string")
    got = {r.n: r.e for r in df.select("n", schema_native.compiled(SCHEMA)("doc").alias("e")).collect()}
    assert got.pop(-1) is None and got.pop(-2) is None
    for n, doc in enumerate(docs):
        assert got[n] == plain(SCHEMA, doc), doc
    assert {len(x) == 0 for x in got.values()} == {True, False}
    plan = df.select(schema_native.compiled(SCHEMA)("doc"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_schemas_that_cannot_be_compiled():
    assert schema_native.unchecked(SCHEMA) == ["schema keyword x-note is not checked"]
    loop = {"$defs": {"n": {"properties": {"next": {"$ref": "#/$defs/n"}}}}, "$ref": "#/$defs/n"}
    with pytest.raises(ValueError, match="refers to itself"):
        schema_native.unchecked(loop)
