"""A JSON-schema check as a vectorised function, for the keywords instance schemas use."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
KEYWORDS = {"type", "required", "properties", "items", "enum", "minItems", "minLength", "minimum", "maximum", "additionalProperties"}
#: Keywords that describe and never fail.
NOTES = {"$schema", "$id", "title", "description", "default", "examples"}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[kind])


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """Every violation of the schema by a parsed JSON value, outer ones first, with the place it stands at."""
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the listed values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {name} is required" for name in schema.get("required", []) if name not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}: {name} is not allowed" for name in value if name not in known]
        for name, inner in known.items():
            if name in value:
                out += violations(value[name], inner, f"{at}.{name}")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: too few items")
        for i, item in enumerate(value):
            out += violations(item, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
    elif _is(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{at}: out of range")
    return out


def unknown(schema: dict) -> list[str]:
    """Warnings about the schema's keywords that are not checked."""
    found = {k for k in schema if k not in KEYWORDS | NOTES}
    inner = [*schema.get("properties", {}).values(), *([schema["items"]] if isinstance(schema.get("items"), dict) else [])]
    return sorted({f"schema keyword {k} is not checked" for k in found}.union(*map(unknown, inner)))


def checker(schema: dict):
    """A function of a column of JSON texts that gives the violations of each; null and unreadable texts have none."""

    @F.pandas_udf("array<string>")
    def check(texts: pd.Series) -> pd.Series:
        def of(text: object) -> list[str]:
            try:
                return violations(json.loads(text), schema)  # type: ignore[arg-type]
            except (TypeError, ValueError):
                return []

        return texts.map(of)

    return check
