"""Settings of retrieval, with the checks that loading them makes."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RetrievalConfig:
    k: int = 10
    candidates: int = 20
    k1: float = 1.2
    b: float = 0.75
    rrf_constant: int = 60
    dense_weight: float = 1.0
    lexical_weight: float = 1.0
    least_score: float = 0.5
    max_rows: int = 6
    max_tokens: int = 5000
    mode: str = "hybrid"

    def __post_init__(self):
        if self.mode not in ("dense", "bm25", "hybrid", "constraint_rerank"):
            raise ValueError(f"unknown mode {self.mode}")
        if not 0 < self.k <= self.candidates:
            raise ValueError("k must be from 1 to candidates")
        if not (self.k1 > 0 and 0 <= self.b <= 1 and self.rrf_constant > 0):
            raise ValueError("k1, b or rrf_constant is out of range")


def load_config(path: str, required: tuple[str, ...] = ("mode", "k", "candidates")) -> RetrievalConfig:
    """A JSON object with at least the required keys and no unknown ones."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    missing, unknown = set(required) - set(given), set(given) - {f.name for f in fields(RetrievalConfig)}
    if missing or unknown:
        raise ValueError(f"missing {sorted(missing)}, unknown {sorted(unknown)}")
    return RetrievalConfig(**given)


def preflight(spark: SparkSession, chunks: DataFrame, vectors: DataFrame, chunk_key: str, vector_key: str, column: str, dims: int) -> None:
    """Fails unless every chunk has one vector of the wanted size and no vector is without a chunk."""
    odd = chunks.join(vectors, F.col(chunk_key) == F.col(vector_key), "left_anti").limit(1).count()
    extra = vectors.join(chunks, F.col(chunk_key) == F.col(vector_key), "left_anti").limit(1).count()
    wrong = vectors.where(F.col(column).isNull() | (F.size(column) != dims)).limit(1).count()
    if odd or extra or wrong:
        raise ValueError(f"chunks without vectors: {bool(odd)}, vectors without chunks: {bool(extra)}, vectors of another size: {bool(wrong)}")
