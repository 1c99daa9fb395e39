"""Queries of this subpackage for the driver's entry module."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_url_filter": ("url_filter", "OP1_SQL"),
    "op2_decontaminate": ("decontaminate", None),
    "op3_pii": ("pii", None),
    "op4_secrets": ("secrets", None),
    "op5_packing": ("packing", None),
    "op6_token_counts": ("token_counts", None),
    "op7_quality": ("quality", None),
    "op8_fingerprints": ("fingerprints", None),
    "op9_near_dedup": ("near_dedup", None),
    "op10_line_dedup": ("line_dedup", "OP10_SQL"),
}


def queries():
    return {name: getattr(import_module(f"textloom.llm.{module}"), name) for name, (module, _) in _QUERIES.items()}


def oracle_sql():
    return {name: getattr(import_module(f"textloom.llm.{module}"), sql) for name, (module, sql) in _QUERIES.items() if sql}
