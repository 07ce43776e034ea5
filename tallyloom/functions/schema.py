"""A JSON-Schema subset compiled to Column predicates over typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checks(schema: dict, path: str = "") -> list[tuple[Column, str]]:
    """(broken, message) for a schema of type object: required, properties with const, enum, minimum, maximum,
    exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern, minItems, maxItems, items, allOf, anyOf, oneOf, and
    nested objects. A null value breaks only ``required``."""
    out: list[tuple[Column, str]] = []
    for name in schema.get("required", []):
        at = f"{path}{name}"
        out.append((F.col(at).isNull(), f"{at}: required"))
    for name, rule in schema.get("properties", {}).items():
        at = f"{path}{name}"
        out += _value(F.col(at), rule, at)
        if rule.get("type") == "object":
            out += [(F.col(at).isNotNull() & broken, m) for broken, m in checks(rule, f"{at}.")]
    return out


def _value(c: Column, rule: dict, at: str) -> list[tuple[Column, str]]:
    out: list[tuple[Column, str]] = []

    def add(key: str, broken: Column) -> None:
        out.append((c.isNotNull() & F.coalesce(broken, F.lit(False)), f"{at}: {key}"))

    if "const" in rule:
        add("const", c != F.lit(rule["const"]))
    if "enum" in rule:
        add("enum", ~c.isin(*rule["enum"]))
    if "minimum" in rule:
        add("minimum", c < rule["minimum"])
    if "maximum" in rule:
        add("maximum", c > rule["maximum"])
    if "exclusiveMinimum" in rule:
        add("exclusiveMinimum", c <= rule["exclusiveMinimum"])
    if "exclusiveMaximum" in rule:
        add("exclusiveMaximum", c >= rule["exclusiveMaximum"])
    if "minLength" in rule:
        add("minLength", F.length(c) < rule["minLength"])
    if "maxLength" in rule:
        add("maxLength", F.length(c) > rule["maxLength"])
    if "pattern" in rule:
        add("pattern", ~c.rlike(rule["pattern"]))
    if rule.get("format") == "date-time":
        add("date-time", ~c.cast("string").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"))
    if "minItems" in rule:
        add("minItems", F.size(c) < rule["minItems"])
    if "maxItems" in rule:
        add("maxItems", F.size(c) > rule["maxItems"])
    if "items" in rule:
        add("items", F.exists(c, lambda x: _any(_value(x, rule["items"], at))))
    for key, fits in (("allOf", lambda bad: _any(bad)), ("anyOf", None), ("oneOf", None)):
        if key not in rule:
            continue
        each = [_any(_value(c, r, at)) for r in rule[key]]
        good = sum((F.when(b, 0).otherwise(1) for b in each), F.lit(0))
        add(key, good < len(each) if key == "allOf" else good < 1 if key == "anyOf" else good != 1)
    return out


def _any(broken: list[tuple[Column, str]]) -> Column:
    total = F.lit(False)
    for b, _ in broken:
        total = total | b
    return total


def broken_rules(schema: dict) -> Column:
    """Array of the messages of all broken rules."""
    return F.array_compact(F.array(*[F.when(b, F.lit(m)) for b, m in checks(schema)]))
