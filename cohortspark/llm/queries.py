"""Registered queries of this package and their SQL."""

from __future__ import annotations

import importlib

from cohortspark.llm import entries

_MODULES = entries.MODULES


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in importlib.import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in getattr(importlib.import_module(m), "ORACLES", {}).items()}
