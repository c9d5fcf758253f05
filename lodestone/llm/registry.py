"""Queries and oracle SQL of the training-data operators, gathered from every module here that has them.

``pipeline_query`` is apart: it needs ``corpus_pipeline`` from the repository's top.
"""

from __future__ import annotations

import importlib
import pkgutil

import lodestone.llm as _home


def _modules():
    names = sorted(m.name for m in pkgutil.iter_modules(_home.__path__) if m.name not in ("registry", "pipeline_query"))
    return [importlib.import_module(f"{_home.__name__}.{n}") for n in names]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in getattr(m, "ORACLE", {}).items()}
