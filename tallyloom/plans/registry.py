"""Collects the queries of the core; the training-data queries add themselves in the entry file."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package with a QUERIES and a SQL table.
MODULES = ("telemetry", "findings", "texts", "scores", "structures", "routing", "snapshots", "evaluation", "descriptions", "extras", "files")


def core_queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"tallyloom.plans.{m}").QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"tallyloom.plans.{m}").SQL.items()}
