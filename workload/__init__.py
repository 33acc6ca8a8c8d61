"""Bindings of the operators to the test tables, each next to the SQL that states the same result."""

from __future__ import annotations

from importlib import import_module

from workload.registry import ORACLE, QUERIES

for _module in ("events", "series", "text", "link", "quality", "web", "evidence", "ratios", "pit", "scoring", "plans"):
    import_module(f"workload.{_module}")

__all__ = ["ORACLE", "QUERIES"]
