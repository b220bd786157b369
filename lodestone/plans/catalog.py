"""All queries of the engine; importing it fills the registry."""

from __future__ import annotations

import importlib

from lodestone.plans.registry import ORACLE, QUERIES

MODULES = ["trace_queries", "telemetry_queries", "kv_queries", "block_queries", "misc_queries", "io_queries"]
for _name in MODULES:
    importlib.import_module(f"lodestone.plans.{_name}")

__all__ = ["ORACLE", "QUERIES"]
