"""All queries of the package, by name, with the SQL they are held against."""

from __future__ import annotations

import importlib

MODULES = tuple(f"lexiline.operators.{m}" for m in ("segment", "intervals", "clean", "aggregate", "retrieval", "metrics", "compile", "store", "checks", "files", "review", "inventory", "search", "source_index", "patch", "bundle", "inspection", "views", "shards", "evaluation", "portfolio", "repairs")) + ("lexiline.streaming.stateful", "lexiline.sources.transcripts")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        more = getattr(importlib.import_module(name), what)
        assert not found.keys() & more.keys(), f"{name}: {found.keys() & more.keys()}"
        found |= more
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
