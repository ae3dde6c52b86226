"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("toxicity", "quality", "decontaminate", "jaccard", "pii", "urls", "packing", "sharding", "training_order", "html")


def collect() -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"heliograph.llm.{name}")
        queries |= module.QUERIES
        sql |= module.ORACLES
    return queries, sql
