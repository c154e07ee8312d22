"""The registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from docloom.session import shipped

#: Modules with QUERIES and ORACLES, in order.
MODULES = [f"docloom.plans.{name}" for name in ("retrieval", "texts", "relational", "windows", "control", "answers", "metrics", "evaluation", "documents", "streams")]

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        out |= {k: shipped(f) for k, f in import_module(name).QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(name).ORACLES
    return out
