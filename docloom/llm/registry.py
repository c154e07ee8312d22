"""The queries of the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from docloom.session import shipped

MODULES = ["packing", "language_id", "sharding", "embedding_dedup", "quality", "order_minhash", "license_scan", "toxicity", "sentencepiece_nbest", "media", "decontamination", "collocations", "filter_audit"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name in MODULES:
        out |= {k: shipped(f) for k, f in import_module(f"docloom.llm.{name}").QUERIES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= import_module(f"docloom.llm.{name}").ORACLES
    return out
