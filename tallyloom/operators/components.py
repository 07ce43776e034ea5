"""Rules on web components and scripts: unused parts, copies, size, passed-through calls, caught and dropped errors, residue.

A component is one text with an optional template and script. Rules read the script with comments blanked; what is
declared and what is used are compared by name. Rules on a corpus (unused exports) are joins over the rows of all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes from which a component is too large, and lines from which equal bodies count as a copy.
LINES, FIELDS, METHODS, BODY_LINES = 800, 30, 30, 3
_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_TEMPLATE = re.compile(r"<template\b[^>]*>(.*)</template>", re.S)
_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script>", re.S)
_PARTS = re.compile(r"\bcomponents\s*:\s*\{([^{}]*)\}")
_FUNCTION = re.compile(r"(?:^|[\s,{;])(?:async\s+)?(?:function\s+)?([A-Za-z_$][\w$]*)\s*\(([^()]*)\)\s*\{", re.M)
_CATCH = re.compile(r"\bcatch\s*(?:\([^()]*\))?\s*\{([^{}]*)\}|\.catch\(\s*(?:\([^()]*\)|\w+)?\s*=>\s*\{([^{}]*)\}\s*\)")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "function", "return"}


def _blank(code: str) -> str:
    return _COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), code)


def _dashed(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()


def _block(code: str, at: int) -> int:
    """Where the block that opens before ``at`` closes."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.start()
    return len(code)


def functions(script: str) -> list[tuple[str, str, str, int]]:
    """(name, parameters, body, place) of functions and methods that do not stand in another one."""
    out, end = [], -1
    for m in _FUNCTION.finditer(script):
        if m.start() < end or m.group(1) in _KEYWORDS:
            continue
        end = _block(script, m.end())
        out.append((m.group(1), m.group(2), script[m.end() : end], m.start(1)))
    return out


def _fields(script: str) -> int:
    m = re.search(r"\bdata\s*(?:\(\)|:\s*function\s*\(\))\s*\{\s*return\s*\{", script)
    if not m:
        return 0
    depth, n = 0, 0
    for t in re.compile(r"[{}\[\](),]|[\w$]+\s*:").finditer(script, m.end(), _block(script, m.end())):
        if t.group()[0] in "{[(":
            depth += 1
        elif t.group()[0] in "}])":
            depth -= 1
        elif t.group() != "," and not depth:
            n += 1
    return n


def component_rules(text: str) -> list[tuple[str, str, str, int]]:
    """(rule, severity, name, line)."""
    template = _TEMPLATE.search(text)
    script = _SCRIPT.search(text)
    base = script.start(1) if script else 0
    code = _blank(script.group(1) if script else text)
    at = lambda i: text.count("\n", 0, base + i) + 1
    out = []
    shown = template.group(1) if template else ""
    for m in _PARTS.finditer(code):
        for name in re.findall(r"([A-Za-z_$][\w$]*)\s*(?::\s*[\w$]+)?\s*(?:,|$)", m.group(1).strip()):
            if not re.search(rf"<(?:{re.escape(name)}|{re.escape(_dashed(name))})[\s/>]", shown) and len(re.findall(rf"\b{re.escape(name)}\b", code)) <= 2:
                out.append(("UNUSED-COMPONENT", "MEDIUM", name, at(m.start())))
    found = functions(code)
    # Bodies without the functions that only hold others (setup, data and the like hold no copies of each other).
    inner = [f for name, _, body, place in found for f in ([(n, p, b, place + 1) for n, p, b, _ in functions(body)] or [(name, "", body, place)])]
    first: dict[str, str] = {}
    for name, _, body, place in inner:
        lines = [x.strip() for x in body.splitlines() if x.strip()]
        key = "\n".join(lines)
        if len(lines) >= BODY_LINES and first.setdefault(key, name) != name:
            out.append(("DUP-COMPUTED", "MEDIUM", name, at(place)))
    if text.count("\n") + 1 > LINES or _fields(code) > FIELDS or len(inner) > METHODS:
        out.append(("HUGE-COMPONENT", "LOW", "", 1))
    for name, parameters, body, place in found:
        m = re.fullmatch(r"\s*return\s+([\w$.]+)\(([^()]*)\)\s*;?\s*", body)
        if m and parameters.split() and [x.strip() for x in m.group(2).split(",")] == [x.strip() for x in parameters.split(",")] and "." in m.group(1):
            out.append(("API-WRAPPER-PASSTHRU", "LOW", name, at(place)))
    for m in _CATCH.finditer(code):
        if not (m.group(1) or m.group(2) or "").strip():
            out.append(("EMPTY-CATCH", "HIGH", "", at(m.start())))
    out += [("DEBUG-RESIDUE", "LOW", "", at(m.start())) for m in re.finditer(r"\bconsole\.(?:log|debug)\(|\bdebugger\b", code)]
    out += [("TODO-MARKER", "LOW", "", text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"\b(?:TODO|FIXME|XXX)\b", text)]
    return out


def scan(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rule, severity, name, line) of each text; null texts break nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch["key"], batch["text"], strict=True) for r in component_rules(t or "")]
            yield pd.DataFrame(rows, columns=["key", "rule", "severity", "name", "line"])

    return files.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {dict(files.dtypes)[key]}, rule string, severity string, name string, line int")


def unused_exports(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name): names that a text exports and no import of any text names. Default exports are left out."""
    t = F.coalesce(F.col(text), F.lit(""))
    exported = files.select(key, F.explode(F.regexp_extract_all(t, F.lit(r"\bexport\s+(?:async\s+)?(?:const|let|var|function|class)\s+([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))).alias("name")).distinct()
    groups = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"\bimport\s*\{([^{}]*)\}"), F.lit(1)), lambda g: F.split(g, ",")))
    imported = files.select(F.explode(F.transform(groups, lambda n: F.regexp_extract(n, r"([A-Za-z_$][A-Za-z0-9_$]*)", 1))).alias("name")).distinct()
    return exported.join(imported, "name", "left_anti").select(key, "name")
