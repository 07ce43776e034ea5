"""All queries of this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_percentiles", "q_packing", "q_survivors", "q_texts", "q_sentences")

QUERIES = {k: f for m in MODULES for k, f in import_module(f"tallyloom.llm.{m}").QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in import_module(f"tallyloom.llm.{m}").SQL.items()}
