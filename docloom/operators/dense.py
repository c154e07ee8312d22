"""Exact dense search: products of matrices, block against block, with the best of each task merged."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of queries that go to every task; beyond that both sides are dealt into blocks of so many.
MOST_BYTES = 64 << 20
#: Products that a task holds at once.
PORTION = 4_000_000


class _Best:
    """The k best rows so far for each query of a block: by score in six decimals, then by key."""

    def __init__(self, ids, vectors, k: int, exclude_self: bool):
        self.ids, self.k, self.exclude = np.asarray(ids), k, exclude_self
        sizes = np.array([-1 if v is None else len(v) for v in vectors], dtype=np.int64)
        self.groups = [(np.flatnonzero(sizes == d), np.array([vectors[i] for i in np.flatnonzero(sizes == d)], dtype=np.float64)) for d in np.unique(sizes[sizes > 0])]
        self.held: dict[int, list] = {}

    def add(self, keys, vectors) -> None:
        sizes = np.array([-1 if v is None else len(v) for v in vectors], dtype=np.int64)
        keys = np.asarray(keys)
        for d, (at, queries) in enumerate(self.groups):
            rows = np.flatnonzero(sizes == queries.shape[1])
            if not len(rows):
                continue
            block = np.array([vectors[i] for i in rows], dtype=np.float64)
            step = max(1, PORTION // len(rows))
            for a in range(0, len(at), step):
                self._merge((d, a), self.ids[at[a : a + step]], keys[rows], np.round(queries[a : a + step] @ block.T, 6))

    def _merge(self, place, ids, keys, scores) -> None:
        if self.exclude:
            scores[ids[:, None] == keys[None, :]] = -np.inf
        scores[np.isnan(scores)] = -np.inf
        row, column = np.nonzero(scores >= self._kth(scores)[:, None])
        new = [row, keys[column], scores[row, column]]
        if place in self.held:
            new = [np.concatenate(x) for x in zip(self.held[place][1], new)]
        row, key, score = new
        order = np.lexsort((key, -score, row))
        row, key, score = row[order], key[order], score[order]
        first = np.searchsorted(row, row)
        keep = (np.arange(len(row)) - first < self.k) & np.isfinite(score)
        self.held[place] = (ids, [row[keep], key[keep], score[keep]])

    def _kth(self, scores) -> np.ndarray:
        """The k-th best score of each row: no lower one can be among the k best, all equal ones may."""
        n = scores.shape[1]
        return np.full(len(scores), -np.inf) if n <= self.k else np.partition(scores, n - self.k, axis=1)[:, n - self.k]

    def rows(self):
        """query, key and score of all that is held."""
        parts = [(ids[row], key, score) for ids, (row, key, score) in self.held.values()]
        return [np.concatenate(x) for x in zip(*parts)] if parts else [[], [], []]


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", exclude_self: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(query, rank, key, score) by inner product, then key. Exact: the stated queries against all rows.

    Queries of up to most_bytes together go to every task, which reads its vectors once and passes on k
    rows a query. Beyond that both sides are dealt into as many blocks as their bytes need, and each
    pair of blocks is one task's work. Vectors that are null, or of another size than a query, are not
    found by it; without queries or vectors there are no rows.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    rows, asked = vectors.select(key, column), queries.select(F.col(key).alias("query"), F.col(column).alias("_q"))
    schema = f"query {dict(asked.dtypes)['query']}, `{key}` {dict(rows.dtypes)[key]}, score double"
    bytes_of = lambda df, name: int(df.agg(F.coalesce(F.sum(8 * F.coalesce(F.size(name), F.lit(0)) + 64), F.lit(0))).first()[0])
    held = bytes_of(asked, "_q")
    names = ["query", key, "score"]

    def table(best, query_type, key_type):
        q, found, score = best.rows()
        return pa.RecordBatch.from_arrays([pa.array(q, query_type), pa.array(found, key_type), pa.array(score, pa.float64())], names=names)

    if held <= most_bytes:
        block = asked.toArrow()
        sent = spark.sparkContext.broadcast((block["query"].to_pylist(), block["_q"].to_pylist()))
        query_type = block["query"].type

        def scan(batches):
            best = None
            for batch in batches:
                best = best or _Best(*sent.value, k, exclude_self)
                best.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                key_type = batch.column(0).type
            if best is not None:
                yield table(best, query_type, key_type)

        scored = rows.mapInArrow(scan, schema)
    else:
        n_q, n_v = -(-held // most_bytes), max(1, -(-bytes_of(rows, column) // most_bytes))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        left = rows.select(F.col(key), F.col(column), deal(key, n_v).alias("_v"), every(n_q).alias("_b"))
        right = asked.select("query", "_q", deal("query", n_q).alias("_qb"), every(n_v).alias("_qv"))

        def meet(_, ours, theirs):
            best = _Best(theirs["query"].to_pylist(), theirs["_q"].to_pylist(), k, exclude_self)
            for batch in ours.to_batches(max_chunksize=4096):
                best.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            return pa.Table.from_batches([table(best, theirs["query"].type, ours[key].type)])

        scored = left.groupBy("_b", "_v").cogroup(right.groupBy("_qb", "_qv")).applyInArrow(meet, schema)
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", key, "score")
