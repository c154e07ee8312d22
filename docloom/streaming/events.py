"""Event-time streams. Each runs to the end of its input once (availableNow) and returns what its sink holds.

The sink is a table in shared storage; on a cluster, set spark.checkpoint.dir.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.storage import new_path


def table_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A folder or file of Parquet as a stream; `files` at most in each batch."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema)
    if files:
        source = source.option("maxFilesPerTrigger", files)
    return source.parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", name).parquet(folder)


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream, with ts as a timestamp: watermarks reject those without a zone."""
    return table_stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream once into Parquet. In complete mode the last batch is the result."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, "stream")
    if mode == "complete":
        query = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows"))
    else:
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/rows")
    query.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def tumbling(events: DataFrame, width: str, by: list[str]) -> DataFrame:
    return events.groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, slide: str) -> DataFrame:
    return events.groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, by: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), by, "n")


def deduplicated(events: DataFrame, key: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) whenever a key has new events: state of one's own, kept between batches and rounds of the stream."""
    import pandas as pd

    def update(keys, batches, state):
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [round(total, 4)]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def last_of_each(stream: DataFrame, key: str, order: str) -> DataFrame:
    """Run a stream in update mode to its end and return the last row of each key: the one of the highest `order`."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, "stream")
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("append").parquet(f"{out}/rows"))
    query.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{out}/rows")
    others = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*")


def with_watermark(events: DataFrame, late: str, aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An aggregate whose state is dropped once events are later than `late`."""
    return aggregate(events.withWatermark("ts", late))
