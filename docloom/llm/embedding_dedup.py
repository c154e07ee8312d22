"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are one class from the start, so a vector that a third of the rows share costs one
representative. Two vectors of cosine c agree in the sign of a random projection with probability
1 - acos(c) / pi; the number of tables follows from that and the wanted recall of a link at the
threshold. Buckets larger than a block are compared block against block, in tasks of bounded size.
A pair is counted in the first table in which it meets, so it counts once; tasks emit link counts
and a spanning forest, never the pairs.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import connected_components, materialize, returning, table, union_find


def tables_for(threshold: float, bits: int, recall: float) -> int:
    """Tables of `bits` signs in one of which a pair at the threshold meets with probability `recall`."""
    meets = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-meets)) if meets < 1 else 1)


@cache
def planes(dims: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims, tables, bits]).standard_normal((dims, tables * bits))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in doubles; scaled first so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def signatures(x: np.ndarray, tables: int, bits: int, seed: int, first: int | None = None) -> np.ndarray:
    """For each row and table, or each of the first few tables, its signs as one number."""
    first = tables if first is None else first
    signs = (x @ planes(x.shape[1], tables, bits, seed)[:, : first * bits]) > 0
    return signs.reshape(len(x), first, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _bodies(kind: str):
    """Digest and bytes of each usable vector; null where one is null, empty, zero, or has null or non-finite parts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            values = flat.cast(pa.float64(), safe=False).fill_null(np.nan).to_numpy()
            # flatten() leaves out what null lists cover
            lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lengths)
            ends = np.cumsum(lengths)
            digests, bodies = [None] * len(lengths), [None] * len(lengths)
            for i, (a, b) in enumerate(zip(ends - lengths, ends)):
                x = values[a:b]
                if b > a and np.isfinite(x).all() and x.any():
                    bodies[i] = (x + 0.0).astype(kind).tobytes()
                    digests[i] = hashlib.blake2b(bodies[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], names=["vec_id", "digest", "body"])

    return run


def bucket_keys(sig: np.ndarray, dims: int) -> np.ndarray:
    """For each row and table, a 64-bit key of table, dimension and signs. Two buckets of one key, which is rare, are compared together."""
    table = np.arange(sig.shape[1], dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (sig.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) + table + np.uint64(dims) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


#: Products of rows and planes that a task holds at once, however many tables there are.
PRODUCTS = 4_000_000


def _spread(kind: str, tables: int, bits: int, seed: int):
    """A row for each class and table: its bucket."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bodies, nodes = batch.column("body").to_pylist(), batch.column("node").to_numpy()
            size = np.array([len(b) for b in bodies])
            for n in np.unique(size):
                same = np.flatnonzero(size == n)
                for rows in np.array_split(same, -(-len(same) * tables * bits // PRODUCTS)):
                    x = unit(np.frombuffer(b"".join(bodies[i] for i in rows), kind).reshape(len(rows), -1))
                    keys = bucket_keys(signatures(x, tables, bits, seed), x.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(nodes[rows], tables))], names=["bucket", "node"])

    return run


def _compare(kind: str, threshold: float, tables: int, bits: int, seed: int):
    """Sorted rows of bucket parts to link counts (node, links, null) and forest edges (u, null, v)."""

    def group(bucket, i, j, node, copies, part, bodies, counted, edges):
        size = np.array([len(b) for b in bodies])
        for n in np.unique(size):  # of one size, unless two keys agree by chance
            rows = np.flatnonzero(size == n)
            if len(rows) > 1:
                one_size(bucket, i, j, node[rows], copies[rows], part[rows], bodies[rows], counted, edges)

    def one_size(bucket, i, j, node, copies, part, bodies, counted, edges):
        x = unit(np.frombuffer(b"".join(bodies), kind).reshape(len(node), -1))
        near = x @ x.T >= threshold
        if i == j:
            near = np.triu(near, 1)
        else:
            near &= (part == i)[:, None] & (part == j)[None, :]
        a, b = np.nonzero(near)
        if len(a):
            # a pair counts in the first table in which it meets
            table = int((bucket_keys(signatures(x[:1], tables, bits, seed), x.shape[1])[0] == bucket).argmax())
            used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            keys = signatures(x[used], tables, bits, seed, table)
            u, v = at[: len(a)], at[len(a) :]
            fresh = np.concatenate([(keys[u[k : k + 65536]] != keys[v[k : k + 65536]]).all(1) for k in range(0, len(a), 65536)])
            a, b = a[fresh], b[fresh]
        if not len(a):
            return
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        has = links > 0
        counted.append((node[has], links[has].astype(np.int64)))
        nodes, roots = union_find(node[a], node[b])
        edges.append((nodes[nodes != roots], roots[nodes != roots]))

    def flush(counted, edges):
        import pyarrow as pa

        if not counted:
            return None
        ids, at = np.unique(np.concatenate([r for r, _ in counted]), return_inverse=True)
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, at, np.concatenate([n for _, n in counted]))
        u, v = np.concatenate([u for u, _ in edges]), np.concatenate([v for _, v in edges])
        none_u, none_i = pa.nulls(len(u), pa.int64()), pa.nulls(len(ids), pa.int64())
        columns = [pa.array(np.concatenate([ids, u])), pa.concat_arrays([pa.array(links), none_u]), pa.concat_arrays([none_i, pa.array(v)])]
        return pa.RecordBatch.from_arrays(columns, names=["u", "links", "v"])

    def run(batches):
        held, counted, edges = None, [], []
        names = ("bucket", "i", "j", "node", "copies", "part")
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names] + [np.array(batch.column("body").to_pylist(), dtype=object)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            n = len(now[0])
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in now[:3]])) + 1
            starts = [0, *change.tolist()]
            for a, b in zip(starts, starts[1:]):
                group(now[0][a], now[1][a], now[2][a], *(c[a:b] for c in now[3:]), counted, edges)
            held = [c[starts[-1] : n] for c in now]
            if sum(len(r) for r, _ in counted) > 100_000:
                yield flush(counted, edges)
                counted, edges = [], []
        if held is not None and len(held[0]):
            group(held[0][0], held[1][0], held[2][0], *held[3:], counted, edges)
        last = flush(counted, edges)
        if last is not None:
            yield last

    return run


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", threshold: float = 0.95, recall: float = 0.9995, block: int = 1024, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, by cosine >= threshold in doubles.

    Vectors that are null, empty, zero, or hold null or non-finite parts link with nothing, as do
    those without an id; vectors of different dimension do not link. Repeated rows count each.
    Rows that share an id but not the vector have links and a component each. An empty table stays
    empty; other columns are not looked at.
    """
    kind = "<f4" if dict(vectors.dtypes)[column] == "array<float>" else "<f8"
    narrow = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    rows = materialize(narrow.mapInArrow(returning(_bodies(kind)), "vec_id long, digest binary, body binary"), "vectors")
    usable = rows.where("digest is not null and vec_id is not null")
    classes = materialize(usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("body").alias("body")), "classes", "node")
    n = classes.count()
    # so many signs that few vectors meet by chance: only those that meet another have to travel
    bits = min(48, math.ceil(math.log2(max(n, 2))) + 4)
    tables = tables_for(threshold, bits, recall)
    # signs cost less to take twice than to store
    placed = classes.select("node", "body").mapInArrow(returning(_spread(kind, tables, bits, seed)), "bucket long, node long")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("parts", F.ceil(F.col("_n") / block).cast("int")).drop("_n")
    met = placed.join(sizes, "bucket").join(classes.select("node", "copies", "body"), "node")
    put = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    put = put.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    put = put.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "copies", "part", "body")
    key = ["bucket", "i", "j"]
    found = put.repartition(*key).sortWithinPartitions(*key).mapInArrow(returning(_compare(kind, threshold, tables, bits, seed)), "u long, links long, v long")
    found = materialize(found, "links")
    links = found.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    known = classes.select("digest", "rep", "copies", "node").join(links, "node", "left").join(connected_components(found.where("v is not null").select("u", "v")), "node", "left")
    known = materialize(known.select("digest", "rep", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    lowest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(lowest, "component").select("digest", "n_links", "component_id")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(known, "digest", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of embeddings at cosine 0.95, whatever their labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
ORACLES: dict[str, str] = {}
