"""All registered queries of the engine proper and their SQL."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("operators.structured", "operators.relational", "operators.temporal", "operators.retrieval", "operators.search_queries", "operators.quality", "operators.store", "operators.answers", "functions.queries", "sources.queries")


def _gather(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f".{m}", __package__), name).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
