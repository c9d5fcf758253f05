"""Registered queries and their oracle SQL, one module per family of operators.

A family module holds ``QUERIES`` (name -> callable) and ``ORACLE`` (name -> SQL).
"""

from __future__ import annotations

import importlib
import pkgutil


def _families():
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]


def queries() -> dict:
    return {k: v for m in _families() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _families() for k, v in m.ORACLE.items()}
