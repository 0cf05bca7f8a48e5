"""Registered queries."""

from importlib import import_module

from tidemark.plans.registry import ORACLES, QUERIES

for _area in ["panel", "filings", "signal", "diagnostics", "risk", "book", "statistics", "source", "learning", "linear"]:
    import_module(f"tidemark.plans.{_area}_queries")

__all__ = ["ORACLES", "QUERIES"]
