"""Queries over the given tables, one per operator, with oracle SQL."""

import importlib
import pkgutil

from termweave.catalog.registry import ORACLES, QUERIES

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
