"""What a Spark session needs before queries run."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Python workers get batches of whole texts; Spark's own bound of 64 MB a batch is much beside what a worker has.
BATCH_BYTES, BATCH_BYTES_KEY = "2m", "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it; once for each application.

    Sessions that bound the bytes of Arrow batches themselves keep their bound.
    """
    if spark.conf.get(BATCH_BYTES_KEY, None) in (None, "67108864b", "64m"):
        spark.conf.set(BATCH_BYTES_KEY, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent.parent
    with tempfile.TemporaryDirectory() as folder:
        package = shutil.copytree(root / "docloom", Path(folder) / "zip" / "docloom", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(str(Path(folder) / "docloom_package"), "zip", package.parent)
        kept = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom_package.zip"
        shutil.copy(archive, kept)
    context.addPyFile(str(kept))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after ship()."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
