"""Recognition of what arrives in a folder: each shard once, failures tried again a bounded number of times, the rest set apart.

All attempts are one table, `{folder}/tried/shard=i/attempt=j`. What a shard has tried is not tried again
after a restart: the stream's checkpoint skips whole shards, and within the shard at which a run broke off
the attempts that were written whole are read instead. Results and dead letters are filters of that table.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = "result string, error string"


def guarded(one: Callable[[str], str], value: Column) -> Column:
    """struct<result, error> of a function of texts: what it raises is the row's error, and no other row's. Null is given as it is."""

    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            try:
                out.append((one(x), None))
            except Exception as e:  # whatever a recogniser raises belongs to its row
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["result", "error"])

    return F.pandas_udf(run, OUTCOME)(value)


def _whole(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _empty(df: DataFrame) -> bool:
    return not df.take(1)


def recognise_stream(stream: DataFrame, value: str, one: Callable[[str], str], folder: str, attempts: int = 3) -> DataFrame:
    """Run a stream to the end of its input and return the table of attempts.

    stream: rows of any columns; how many files make a shard is its source's maxFilesPerTrigger. An attempt
    takes the rows of the shard that failed before, in one job; the last of `attempts` leaves dead letters.
    """
    if attempts < 1:
        raise ValueError("attempts must be at least 1")
    clash = {"shard", "attempt", "result", "error"} & {c.lower() for c in stream.columns}
    if clash:
        raise ValueError(f"columns of the outcome are taken: {sorted(clash)}")
    spark, columns = stream.sparkSession, stream.columns

    def shard(rows: DataFrame, i: int) -> None:
        for j in range(1, attempts + 1):
            path = f"{folder}/tried/shard={i}/attempt={j}"
            if not _whole(spark, path):
                outcome = rows.withColumn("_outcome", guarded(one, F.col(value)))
                outcome.select(*columns, "_outcome.*").write.mode("overwrite").parquet(path)
            failed = spark.read.schema(tried_schema).parquet(path).where("error is not null")
            if _empty(failed):
                return
            rows = failed.select(*columns)

    tried_schema = stream.limit(0).select(*columns, F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("error")).schema
    query = stream.writeStream.foreachBatch(shard).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query.start().awaitTermination()
    return tried(spark, folder, tried_schema)


def tried(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All attempts; none if nothing has arrived yet."""
    known = spark.createDataFrame([], schema).select("*", F.lit(0).alias("shard"), F.lit(0).alias("attempt")).schema
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/tried")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(known).parquet(f"{folder}/tried") if there else spark.createDataFrame([], known)


def recognised(attempts: DataFrame) -> DataFrame:
    """The rows that came through, whichever attempt they took."""
    return attempts.where("error is null").drop("error")


def dead_letters(attempts: DataFrame, last: int) -> DataFrame:
    """The rows that failed for the last time, with what they failed on."""
    return attempts.where((F.col("attempt") == last) & F.col("error").isNotNull()).drop("result")
