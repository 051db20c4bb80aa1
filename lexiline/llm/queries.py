"""Queries of this subpackage for __spark_entry__.py: each applies an operator to its whole table."""

from __future__ import annotations

import importlib

NAMES = ("op1_packing", "op10_suffix_dedup", "op11_spelling", "op12_token_counts", "op13_ball_kmeans", "op2_near_dedup", "op3_chat_format", "op4_warc", "op5_substring_dedup", "op6_license_scan", "op7_decontaminate", "op8_token_output", "op9_quality")


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"lexiline.llm.{name}"), name) for name in NAMES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"lexiline.llm.{name}"), "ORACLE_SQL", None) for name in NAMES}
    return {name: sql for name, sql in found.items() if sql}
