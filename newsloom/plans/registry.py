"""All queries and their SQL: the core's own, and those of the subpackage ``llm`` where it is installed."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CORE_MODULES = tuple(f"newsloom.plans.{m}_queries" for m in ("timestamp", "text", "retrieval", "domain", "filing", "state", "search"))
EXTRA_PACKAGE = "newsloom.llm"


def _modules() -> list:
    found = [importlib.import_module(m) for m in CORE_MODULES]
    try:
        found.append(importlib.import_module(f"{EXTRA_PACKAGE}.queries"))
    except ModuleNotFoundError as e:
        if not (e.name or "").startswith(EXTRA_PACKAGE):
            raise
    return found


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
