"""The query catalogue: each module has QUERIES (name to function) and, where SQL can say the same, ORACLE."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    for m in sorted((m for m in pkgutil.iter_modules(__path__) if m.name[0] != "_"), key=lambda m: m.name):
        yield importlib.import_module(f"{__name__}.{m.name}")


def queries() -> dict:
    return {k: f for m in _modules() for k, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in getattr(m, "ORACLE", {}).items()}
