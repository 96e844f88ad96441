"""The corpus queries and their SQL, for __spark_entry__."""

from __future__ import annotations

import importlib

MODULES = ("op1_decontaminate", "op2_substrings", "op3_quality", "op4_revisit", "op5_licence", "op6_quotes", "op7_mixing", "op8_langid", "op9_mixing", "op10_simhash", "op11_merkle", "op12_urls", "op13_infill")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in importlib.import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in importlib.import_module(f".{m}", __package__).SQL.items()}
