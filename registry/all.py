"""Everything registered."""

from __future__ import annotations

from importlib import import_module

from registry.build import ORACLES, QUERIES

for _module in ("basics", "spells", "ledgers", "assembly", "measures", "tables", "study"):
    import_module(f"registry.{_module}")

__all__ = ["ORACLES", "QUERIES"]
