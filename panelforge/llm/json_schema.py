"""Strict JSON values and their validation against JSON Schemas, for one text or value at a time.

A text is a value only if it has a canonical form: numbers are finite, strings are Unicode without lone surrogates,
and brackets nest no deeper than ``NESTING``, the limit that this reader, as any, sets.  Of equal keys the last counts.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction

#: Brackets within brackets that a text may have.
NESTING = 200
STRING = re.compile(r'"(?:[^"\\]++|\\.)*+"?', re.S)
SURROGATE = re.compile("[\ud800-\udfff]")
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no(constant: str) -> float:
    raise ValueError(constant)


def _finite(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _no(text)


def _deep(text: str) -> bool:
    if text.count("[") + text.count("{") <= NESTING:
        return False
    depth = 0
    for c in re.sub(r"[^\[\]{}]+", "", STRING.sub("", text)):
        depth += 1 if c in "[{" else -1
        if depth > NESTING:
            return True
    return False


def read(text: str) -> object:
    """The value of a text; ``ValueError`` where it is none."""
    if _deep(text):
        raise ValueError("nested too deep")
    value = json.loads(text, parse_constant=_no, parse_float=_finite)
    if "\\u" in text and SURROGATE.search(canonical(value)):
        raise ValueError("lone surrogate")
    return value


def _is(value: object, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, TYPES.get(kind, ()))


def _same(a: object, b: object) -> bool:
    """Equal as JSON: true is not 1, 1.0 is 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _multiple(value: int | float, of: int | float) -> bool:
    """Exactly, as the numbers are written: 0.3 is a multiple of 0.1."""
    return of > 0 and (Fraction(repr(value) if isinstance(value, float) else value) / Fraction(repr(of) if isinstance(of, float) else of)).denominator == 1


#: Keywords of schemas that are looked at, and those that say nothing about a value.
KEYWORDS = frozenset(
    """
    type const enum minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern minItems maxItems uniqueItems minProperties
    maxProperties properties required additionalProperties prefixItems items allOf anyOf oneOf not
    """.split()
)
SILENT = frozenset("$schema $id $comment title description default examples deprecated readOnly writeOnly format contentMediaType contentEncoding".split())


def checked(schema: dict | bool) -> dict | bool:
    """The schema itself; ValueError if it has a keyword that would go unseen, such as ``$ref`` or ``if``."""
    if isinstance(schema, bool):
        return schema
    if not isinstance(schema, dict):
        raise ValueError(f"a schema is an object or a boolean, not {schema!r}")
    if unknown := sorted(set(schema) - KEYWORDS - SILENT):
        raise ValueError(f"keywords of a schema that are not supported: {', '.join(unknown)}")
    parts = [*schema.get("properties", {}).values(), *schema.get("prefixItems", ()), *(schema[k] for k in ("additionalProperties", "items", "not") if k in schema)]
    for part in [*parts, *(x for way in ("allOf", "anyOf", "oneOf") for x in schema.get(way, ()))]:
        checked(part)
    return schema


def _bounds(value, schema: dict) -> list[str]:
    """Names of the bounds of a number, or of a length, that are not kept."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        kept = {"minimum": lambda b: value >= b, "maximum": lambda b: value <= b, "exclusiveMinimum": lambda b: value > b, "exclusiveMaximum": lambda b: value < b, "multipleOf": lambda b: _multiple(value, b)}
    elif isinstance(value, str):
        kept = {"minLength": lambda b: len(value) >= b, "maxLength": lambda b: len(value) <= b, "pattern": lambda b: re.search(b, value) is not None}
    elif isinstance(value, list):
        kept = {"minItems": lambda b: len(value) >= b, "maxItems": lambda b: len(value) <= b, "uniqueItems": lambda b: not b or len(set(map(canonical, value))) == len(value)}
    elif isinstance(value, dict):
        kept = {"minProperties": lambda b: len(value) >= b, "maxProperties": lambda b: len(value) <= b}
    else:
        return []
    return [name for name, keeps in kept.items() if name in schema and not keeps(schema[name])]


def errors(value: object, schema: dict | bool, at: str = "") -> list[str]:
    """What is wrong with a value, each with its place (``a.b[0]``), sorted at the top."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at or 'arguments'} is not allowed"]
    name, wrong = at or "arguments", []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return [f"{name} is no {' or '.join(kinds)}"]
    if "const" in schema and not _same(value, schema["const"]):
        wrong.append(f"{name} is not the constant")
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        wrong.append(f"{name} is none of its values")
    wrong += [f"{name} breaks {bound}" for bound in _bounds(value, schema)]
    if isinstance(value, dict):
        inner = lambda key: f"{at}.{key}" if at else key
        known = schema.get("properties", {})
        wrong += [f"missing {inner(p)}" for p in schema.get("required", ()) if p not in value]
        for key, x in value.items():
            if key in known:
                wrong += errors(x, known[key], inner(key))
            elif (other := schema.get("additionalProperties", True)) is False:
                wrong.append(f"unknown {inner(key)}")
            else:
                wrong += errors(x, other, inner(key))
    if isinstance(value, list):
        first = schema.get("prefixItems", ())
        for k, x in enumerate(value):
            wrong += errors(x, first[k] if k < len(first) else schema.get("items", True), f"{at}[{k}]")
    for part in schema.get("allOf", ()):
        wrong += errors(value, part, at)
    fits = {way: sum(not errors(value, part, at) for part in schema[way]) for way in ("anyOf", "oneOf") if way in schema}
    if fits.get("anyOf", 1) == 0 or fits.get("oneOf", 1) != 1:
        wrong.append(f"{name} fits none or too many of its forms")
    if "not" in schema and not errors(value, schema["not"], at):
        wrong.append(f"{name} is of an excluded form")
    return wrong if at else sorted(set(wrong))
