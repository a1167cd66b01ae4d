"""A JSON schema compiled to one native expression over a variant: no Python runs where the documents are.

compiled(schema) gives a function of a column of JSON texts; its result is the array of violations with the places they
stand at, outer ones first. A schema is expanded where it is used, so the expression grows with the schema, and schemas
that refer to themselves are refused. Patterns are searched anywhere, as Java regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that are checked, and those that describe and never fail.
KEYWORDS = set("type enum const required properties additionalProperties minProperties maxProperties items minItems maxItems minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum anyOf oneOf allOf not $ref".split())
NOTES = set("$schema $id title description default examples $defs definitions".split())


def _resolved(schema: dict | bool, root: dict, open_: tuple[str, ...]) -> tuple[dict | bool, tuple[str, ...]]:
    """The schema that stands for a reference, and the references being followed."""
    while isinstance(schema, dict) and "$ref" in schema:
        name = schema["$ref"]
        if not name.startswith("#"):
            raise ValueError(f"{name} is not in the schema")
        if name in open_:
            raise ValueError(f"{name} refers to itself, and no expression has an end to that")
        open_ += (name,)
        schema = root
        for part in name[1:].split("/")[1:]:
            schema = schema[part.replace("~1", "/").replace("~0", "~")]
    return schema, open_


def unchecked(schema: dict | bool, root: dict | None = None, open_: tuple[str, ...] = ()) -> list[str]:
    """Warnings about keywords of the schema, and of all inside it, that are not checked."""
    root = schema if root is None else root
    schema, open_ = _resolved(schema, root, open_)
    if not isinstance(schema, dict):
        return []
    inner = [*schema.get("properties", {}).values(), *[s for k in ("anyOf", "oneOf", "allOf") for s in schema.get(k, [])], *[schema[k] for k in ("items", "not", "additionalProperties") if k in schema]]
    found = {f"schema keyword {k} is not checked" for k in schema if k not in KEYWORDS | NOTES}
    return sorted(found.union(*[unchecked(s, root, open_) for s in inner]))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _none() -> Column:
    return F.array().cast("array<string>")


def _said(bad: Column, at: Column, what: str) -> Column:
    return F.when(bad, F.array(F.concat(at, F.lit(f": {what}")))).otherwise(_none())


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    named = F.when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null")
    return named.otherwise("number")


def _equals(v: Column, k: Column, value: object) -> Column:
    if value is None:
        return k == "null"
    if isinstance(value, bool):
        return (k == "boolean") & (_get(v, "boolean") == value)
    if isinstance(value, (int, float)):
        return (k == "number") & (_get(v, "double") == float(value))
    if isinstance(value, str):
        return (k == "string") & (_get(v, "string") == value)
    raise ValueError("listed values have to be plain")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _node(schema: dict | bool, root: dict, v: Column, at: Column, open_: tuple[str, ...] = ()) -> Column:
    schema, open_ = _resolved(schema, root, open_)
    if schema is True or schema == {}:
        return _none()
    if schema is False:
        return F.array(F.concat(at, F.lit(": nothing is allowed here")))
    down = lambda s, x, place: _node(s, root, x, place, open_)
    fits = lambda s: F.size(down(s, v, at)) == 0

    def of(k: Column) -> Column:
        out, number, text = [], _get(v, "double"), _get(v, "string")
        if "enum" in schema:
            out.append(_said(~_any([_equals(v, k, e) for e in schema["enum"]]), at, "not one of the listed values"))
        if "const" in schema:
            out.append(_said(~_any([_equals(v, k, schema["const"])]), at, "not the listed value"))
        if "minLength" in schema:
            out.append(_said((k == "string") & (F.length(text) < schema["minLength"]), at, "too short"))
        if "maxLength" in schema:
            out.append(_said((k == "string") & (F.length(text) > schema["maxLength"]), at, "too long"))
        if "pattern" in schema:
            out.append(_said((k == "string") & ~text.rlike(schema["pattern"]), at, "does not match the pattern"))
        ranges = {"minimum": lambda m: number < m, "maximum": lambda m: number > m, "exclusiveMinimum": lambda m: number <= m, "exclusiveMaximum": lambda m: number >= m}
        beyond = [f(float(schema[key])) for key, f in ranges.items() if key in schema]
        if beyond:
            out.append(_said((k == "number") & _any(beyond), at, "out of range"))
        if {"required", "properties", "additionalProperties", "minProperties", "maxProperties"} & set(schema):
            out.append(F.when(k == "object", _once(_get(v, "map<string,variant>"), fields)).otherwise(_none()))
        if {"items", "minItems", "maxItems"} & set(schema):
            out.append(F.when(k == "array", _once(_get(v, "array<variant>"), elements)).otherwise(_none()))
        out += [down(s, v, at) for s in schema.get("allOf", [])]
        if "anyOf" in schema:
            out.append(_said(~_any([fits(s) for s in schema["anyOf"]]), at, "fits none of the alternatives"))
        if "oneOf" in schema:
            n = sum((fits(s).cast("int") for s in schema["oneOf"]), F.lit(0))
            out.append(_once(n, lambda c: F.when(c != 1, F.array(F.concat(at, F.lit(": fits "), c.cast("string"), F.lit(" of the alternatives, not one")))).otherwise(_none())))
        if "not" in schema:
            out.append(_said(fits(schema["not"]), at, "fits what is ruled out"))
        found = F.concat(*out) if out else _none()
        kinds = schema.get("type")
        if not kinds:
            return found
        kinds = [kinds] if isinstance(kinds, str) else kinds
        right = _any([(k == "number") & (number == F.floor(number)) if x == "integer" else k == x for x in kinds])
        return F.when(~right, F.array(F.concat(at, F.lit(f": not of type {' or '.join(kinds)}")))).otherwise(found)

    def fields(m: Column) -> Column:
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out = [_said(~F.map_contains_key(m, name), at, f"{name} is required") for name in schema.get("required", [])]
        if "minProperties" in schema:
            out.append(_said(F.size(m) < schema["minProperties"], at, "too few properties"))
        if "maxProperties" in schema:
            out.append(_said(F.size(m) > schema["maxProperties"], at, "too many properties"))
        for name, inner in known.items():
            out.append(F.when(F.map_contains_key(m, name), down(inner, F.element_at(m, F.lit(name)), F.concat(at, F.lit(f".{name}")))).otherwise(_none()))
        if more is not True and more != {}:
            others = F.array_sort(F.filter(F.map_keys(m), lambda key: ~key.isin(*known) if known else F.lit(True)))
            if more is False:
                out.append(F.transform(others, lambda key: F.concat(at, F.lit(": "), key, F.lit(" is not allowed"))))
            else:
                out.append(F.flatten(F.transform(others, lambda key: down(more, F.element_at(m, key), F.concat(at, F.lit("."), key)))))
        return F.concat(*out) if out else _none()

    def elements(a: Column) -> Column:
        out = []
        if "minItems" in schema:
            out.append(_said(F.size(a) < schema["minItems"], at, "too few items"))
        if "maxItems" in schema:
            out.append(_said(F.size(a) > schema["maxItems"], at, "too many items"))
        if "items" in schema:
            out.append(F.flatten(F.transform(a, lambda x, i: down(schema["items"], x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))))
        return F.concat(*out) if out else _none()

    return _once(_kind(v), of)


def compiled(schema: dict) -> Callable[[Column | str], Column]:
    """A function of a column of JSON texts that gives the violations of each; null for null and unreadable texts."""

    def check(doc: Column | str) -> Column:
        parsed = F.try_parse_json(F.col(doc) if isinstance(doc, str) else doc)
        return F.when(parsed.isNotNull(), _once(parsed, lambda v: _node(schema, schema, v, F.lit("$"))))

    return check
