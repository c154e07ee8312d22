"""What the training-data operators share: tables, hashing, ranks, components."""

from __future__ import annotations

import ctypes
import functools
import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.storage import materialize

#: Where the public tokenizers are unless a caller gives another folder.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test layout; read by Spark alone, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus: a split that any engine can repeat."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def gapless_ranks(rows: DataFrame, group: str, row_id: str, order: list[str], out: str, rows_per_bucket: int = 100_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, however large a group is.

    rows must be materialized with a row_id. Each group is split into buckets by that id; counts of
    (group, bucket) are summed up to where each bucket starts, and only a bucket is ever sorted.
    """
    n = rows.count()
    buckets = max(64, -(-n // rows_per_bucket))
    split = rows.withColumn("_bucket", F.pmod(F.xxhash64(row_id), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order, row_id)
    ranked = split.withColumn("_at", F.row_number().over(inside).cast("long") - 1)
    return ranked.join(starts, [group, "_bucket"]).withColumn(out, F.col("_start") + F.col("_at")).drop("_bucket", "_start", "_at")


@functools.cache
def _trim():
    """glibc's malloc_trim, or nothing where there is none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


#: In a Python worker: what empties its memories, and the module whose tasks it ran last.
_FORGET: list = []
_RAN: list[str] = []


def remembered(make):
    """functools.cache for what a worker keeps from task to task, until it turns to the tasks of another module."""
    kept = functools.cache(make)
    _FORGET.append(kept.cache_clear)
    return kept


def _turn_to(module: str) -> None:
    if _RAN != [module]:
        for forget in _FORGET:
            forget()
        _RAN[:] = [module]


def returning(run):
    """run for mapInArrow, after which the worker gives free memory back: workers live on, and the next stage's tasks share an executor with them."""
    module = run.__module__

    def whole(batches):
        import pyarrow as pa

        _turn_to(module)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return whole


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) and the smallest node of each one's component, within memory."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):
        rx, ry = parent[x], parent[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        open_ = lo != hi
        if not open_.any():
            break
        x, y, lo, hi = x[open_], y[open_], lo[open_], hi[open_]
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return nodes, nodes[parent]


def _forest(batches):
    """Arrow batches of edges (u, v) to at most one edge per node: v to the smallest node of its part."""
    import pyarrow as pa

    held_u, held_v, n = [], [], 0

    def fold():
        nodes, roots = union_find(np.concatenate(held_u), np.concatenate(held_v))
        keep = nodes != roots
        return nodes[keep], roots[keep]

    for batch in batches:
        held_u.append(batch.column(0).to_numpy(zero_copy_only=False))
        held_v.append(batch.column(1).to_numpy(zero_copy_only=False))
        n += batch.num_rows
        if n > 1_000_000:
            u, v = fold()
            held_u, held_v, n = [u], [v], len(u)
            if n > 500_000:  # mostly distinct nodes: folding on gains nothing
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                held_u, held_v, n = [], [], 0
    if n:
        u, v = fold()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


#: Edges that one task of a round of connected_components takes.
EDGES_A_TASK = 250_000


def connected_components(edges: DataFrame, a: str = "u", b: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that is reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014) on edges that each partition
    first reduces to a forest. Every round is materialized in shared storage. A node of very many
    edges is safe: minima are taken by partial aggregates, and the join back to the edges is one
    that adaptive execution splits.
    """
    spark = edges.sparkSession
    schema = "u long, v long"
    now = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").mapInArrow(returning(_forest), schema)
    now = materialize(now, "cc")
    size = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = size(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # as many tasks and files as the edges need: a round is over soon, however many partitions a session has
        now = materialize(small.coalesce(max(1, -(-seen[0] // EDGES_A_TASK))), "cc")
        before, seen = seen, size(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")
