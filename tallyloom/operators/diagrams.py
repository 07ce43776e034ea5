"""Flow diagrams as node and edge rows: parser, lint, isolated nodes, drift, longest path."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An id is anything without spaces and marks of the language, so that ids that are not allowed are seen too.
_ID = r"[^\s\[\](){}|&;:,\"<>~=\-.]+"
_NODE = rf"({_ID})(?:\s*(?:\[+|\(+|\{{+)(\"[^\"]*\"|[^\]}}]*?)(?:\]+|\)+|\}}+))?"
_EDGE = re.compile(rf"^\s*{_NODE}\s*(-->|---|-\.->|==>|~~~)(?:\|[^|]*\|)?\s*{_NODE}\s*;?\s*$")
_ALONE = re.compile(rf"^\s*{_NODE}\s*;?\s*$")
_SKIPPED = re.compile(r"\s*(?:%%|classDef|class|style|linkStyle|direction|click)\b|\s*%%")
_HEAD = re.compile(r"\s*(?:flowchart|graph)\b[ \t]*(TD|TB|LR|RL|BT)?")
#: Budgets of a figure.
MAX_NODES, MAX_EDGES, MAX_LABEL, MAX_LR_LAYERS, TB_CHAIN = 12, 14, 26, 7, 8
RESERVED = ("end", "graph", "o", "x")
_SAFE_TAG = re.compile(r"</?(?:br|span|b|i|sub|sup|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>\s-][^>]*>")
_CODE = re.compile(r"\w+\.(?:java|kt|ts|tsx|js|jsx|mjs|py|go|vue|xml|yml|yaml|sql|md|json)\b|\w+::\w+|https?://|\b(?:SELECT|UPDATE|INSERT|DELETE)\s+[A-Z_]{2,}", re.I)
_NAME_LIKE = re.compile(r"\b(?=\w{7,})[A-Za-z]\w*[a-z][A-Z][a-z]\w*|\b[a-z]+_[A-Z_]{3,}")
_BARE_BRACKETS = re.compile(r"[A-Za-z_]\w*\[(?![/(])[^\"\]\n]*[()（）][^\"\]\n]*\]")


def parse_figure(dsl: str) -> dict:
    """Direction, nodes (id -> label) in order of appearance, edges (from, to, invisible), the subgraph of each node."""
    nodes: dict[str, str] = {}
    edges: list[tuple[str, str, bool]] = []
    inside: dict[str, str | None] = {}
    direction, subs, depth = None, [], 0
    for line in dsl.splitlines():
        if head := _HEAD.match(line):
            direction = head.group(1) or direction
            continue
        if m := re.match(r"\s*subgraph\s+(.*)$", line):
            depth += 1
            subs.append(f"{depth}:{m.group(1).strip()}")
            continue
        if subs and re.match(r"\s*end\s*;?\s*$", line):
            subs.pop()
            continue
        if _SKIPPED.match(line):
            continue
        here = subs[-1] if subs else None
        if m := _EDGE.match(line):
            a, la, kind, b, lb = m.groups()
            for n, label in ((a, la), (b, lb)):
                if label or n not in nodes:
                    nodes[n] = (label or nodes.get(n, n)).strip('"')
                inside.setdefault(n, here)
            edges.append((a, b, kind == "~~~"))
        elif m := _ALONE.match(line):
            n, label = m.groups()
            nodes[n] = (label or nodes.get(n, n)).strip('"')
            inside.setdefault(n, here)
    return {"direction": direction, "nodes": nodes, "edges": edges, "inside": inside}


def parse_flow(dsl: str) -> tuple[list[tuple[str, str]], list[tuple[str, str, bool]]]:
    """Nodes (id, label) in order of appearance and edges (from, to, invisible)."""
    found = parse_figure(dsl)
    return list(found["nodes"].items()), found["edges"]


def lint_figure(dsl: str) -> list[tuple[str, str]]:
    """(rule, where) of everything a figure breaks; a figure that is no flowchart is held to its labels only."""
    out: list[tuple[str, str]] = []
    lines = dsl.splitlines()
    for i, line in enumerate(lines, 1):
        if any(not _SAFE_TAG.fullmatch(t) for t in _TAG.findall(line)):
            out.append(("P05", f"line {i}"))
    flow = any(line.strip() for line in lines) and bool(_HEAD.match(next(line for line in lines if line.strip())))
    found = parse_figure(dsl) if flow else {"nodes": {str(i): x for i, x in enumerate(re.findall(r"\"([^\"]{2,})\"", dsl))}}
    for n, label in found["nodes"].items():
        where = f"node {n}"
        if _CODE.search(label):
            out.append(("P11", where))
        if _NAME_LIKE.search(label):
            out.append(("P12", where))
        if max((len(x) for x in re.split(r"<br\s*/?>", label)), default=0) > MAX_LABEL:
            out.append(("P04", where))
    if not flow:
        return out
    nodes, edges, inside = found["nodes"], found["edges"], found["inside"]
    seen = [(a, b) for a, b, hidden in edges if not hidden]
    if not found["direction"]:
        out.append(("P01", "head"))
    out += [("P13", f"node {n}") for n in nodes if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n)]
    out += [("P14", f"node {n}") for n in nodes if n in RESERVED]
    out += [("P06", f"line {i}") for i, line in enumerate(lines, 1) if _BARE_BRACKETS.search(line)]
    out += [("P02", "figure")] * (len(nodes) > MAX_NODES) + [("P03", "figure")] * (len(seen) > MAX_EDGES)
    out += [("P07", f"{a} {b}") for a, b in seen if inside.get(a) != inside.get(b)]
    linked = {n for a, b, _ in edges for n in (a, b)}
    out += [("P08", f"node {n}") for n in nodes if n not in linked]
    layers = longest_path(list(nodes), seen)
    branches = sum(n > 1 for n in Counter(a for a, _ in seen).values())
    if found["direction"] == "LR" and layers > MAX_LR_LAYERS:
        out.append(("P09", "figure"))
    if found["direction"] in ("TB", "TD", None) and layers >= TB_CHAIN and not branches:
        out.append(("P10", "figure"))
    return out


def read_flows(rows: DataFrame, key: str, dsl: str) -> DataFrame:
    """(key, nodes, edges) with arrays of structs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch["key"], batch["dsl"], strict=True):
                nodes, edges = parse_flow(text or "")
                out.append((k, [{"id": a, "label": b} for a, b in nodes], [{"a": a, "b": b, "hidden": h} for a, b, h in edges]))
            yield pd.DataFrame(out, columns=["key", "nodes", "edges"])

    schema = f"key {dict(rows.dtypes)[key]}, nodes array<struct<id:string,label:string>>, edges array<struct<a:string,b:string,hidden:boolean>>"
    return rows.select(F.col(key).alias("key"), F.col(dsl).alias("dsl")).mapInPandas(run, schema)


def isolated(flows: DataFrame) -> DataFrame:
    """(key, id): nodes at no edge."""
    nodes = flows.select("key", F.explode("nodes.id").alias("id"))
    ends = flows.select("key", F.explode(F.concat("edges.a", "edges.b")).alias("id"))
    return nodes.join(ends, ["key", "id"], "left_anti")


def lint(rows: DataFrame, key: str, dsl: str) -> DataFrame:
    """(key, rule, where, layers): one row for each thing a figure breaks; ``layers`` is the figure's longest path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch["key"], batch["dsl"], strict=True):
                found = parse_figure(text or "")
                layers = longest_path(list(found["nodes"]), [(a, b) for a, b, hidden in found["edges"] if not hidden])
                out += [(k, rule, where, layers) for rule, where in lint_figure(text or "")]
            yield pd.DataFrame(out, columns=["key", "rule", "where", "layers"])

    return rows.select(F.col(key).alias("key"), F.col(dsl).alias("dsl")).mapInPandas(run, f"key {dict(rows.dtypes)[key]}, rule string, where string, layers int")


def drift(modules: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(name, side): modules no node shows (``drift``) and nodes without a module (``stale``), in one grouped pass."""
    both = modules.select(name, F.lit(1).alias("m"), F.lit(0).alias("n")).unionByName(nodes.select(name, F.lit(0).alias("m"), F.lit(1).alias("n")))
    sides = both.groupBy(name).agg(F.max("m").alias("m"), F.max("n").alias("n")).where("m != n")
    return sides.select(name, F.when(F.col("m") == 1, "drift").otherwise("stale").alias("side"))


def longest_path(nodes: list[str], edges: list[tuple[str, str]]) -> int:
    """Number of layers of one figure; edges that close a cycle are not followed."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    depth: dict[str, int] = {}
    open_: set[str] = set()
    for root in nodes:
        stack = [(root, iter(after.get(root, ())))]
        if root in depth:
            continue
        open_.add(root)
        best = {root: 1}
        while stack:
            node, more = stack[-1]
            for nxt in more:
                if nxt in open_:
                    continue
                if nxt in depth:
                    best[node] = max(best[node], 1 + depth[nxt])
                    continue
                open_.add(nxt)
                best[nxt] = 1
                stack.append((nxt, iter(after.get(nxt, ()))))
                break
            else:
                stack.pop()
                open_.discard(node)
                depth[node] = best[node]
                if stack:
                    above = stack[-1][0]
                    best[above] = max(best[above], 1 + depth[node])
    return max(depth.values(), default=0)
