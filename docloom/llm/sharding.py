"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL expressions only.

A key's shard needs no table of the ring: a 64-bit linear congruential generator seeded by the key
says to which shard count the key jumps next, and the shard is the last jump below the count. One
more shard therefore takes only the keys that jump to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import gapless_ranks, materialize, table, text_bytes

#: Fixed values of the published algorithm: the generator's multiplier, and 2**31.
MULTIPLIER = 2862933555777941757
JUMP = 2147483648.0

MASK = 0xFFFFFFFF


def _low32(x: Column, y: int) -> Column:
    """x * y modulo 2**32 for x, y below 2**32, without leaving 63 bits."""
    high = F.shiftright(x, 16) * F.lit(y)
    return x.bitwiseAND(F.lit(0xFFFF)) * F.lit(y) + F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16)


def _step(at: Column, shards: int, most: int) -> Column:
    """One jump; at has the generator's halves, the next jump, and the shards so far."""
    a_hi, a_lo = MULTIPLIER >> 32, MULTIPLIER & MASK
    hi, lo, j = at["hi"], at["lo"], at["j"]
    upper = F.shiftright(lo, 16) * F.lit(a_lo)
    low = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(a_lo) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(low, 32) + F.shiftright(upper, 16)
    new_hi = (carry + _low32(hi, a_lo) + _low32(lo, a_hi)).bitwiseAND(F.lit(MASK))
    new_lo = low.bitwiseAND(F.lit(MASK))
    jumped = F.floor((j + 1) * (F.lit(JUMP) / (F.shiftright(new_hi, 1) + 1).cast("double"))).cast("long")
    on = F.struct(
        new_hi.alias("hi"),
        new_lo.alias("lo"),
        jumped.alias("j"),
        F.when(j < shards, j).otherwise(at["shard"]).alias("shard"),
        F.when(j < most, j).otherwise(at["grown"]).alias("grown"),
    )
    return F.when(j < most, on).otherwise(at)


def jump_shards(key: Column, shards: int) -> Column:
    """struct<shard, grown>: the shard of a long key among `shards`, and among one more.

    A null key counts as 0. Each jump at least moves one shard on, so shards + 1 steps suffice.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).cast("long").alias("hi"),
        key.bitwiseAND(F.lit(MASK)).alias("lo"),
        F.lit(0).cast("long").alias("j"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
    )
    steps = F.sequence(F.lit(1), F.lit(shards + 1))
    return F.aggregate(steps, start, lambda at, _: _step(at, shards, shards + 1), lambda at: F.struct(at["shard"].cast("int").alias("shard"), at["grown"].cast("int").alias("grown")))


def assign_shards(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """rows with shard, grown_shard and a slot that counts each shard's rows from 0 without gaps.

    The key and the shard count alone decide the shard. Equal keys, and null keys, share a shard;
    repeated rows take a slot each. An empty table stays empty. Columns of the input keep their
    values; shard, grown_shard and slot are replaced if the input has them. Pass narrow rows: they
    are stored once, so that slots stay the same when tasks are run again.
    """
    put = rows.drop("shard", "grown_shard", "slot").withColumn("_put", jump_shards(F.col(key), shards))
    put = put.withColumn("shard", F.col("_put.shard")).withColumn("grown_shard", F.col("_put.grown")).drop("_put")
    return gapless_ranks(materialize(put, "shards", "_row"), "shard", "_row", [key], "slot").drop("_row")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by the law `key`.

    Null texts have size 1 and the checksum of no bytes.
    """
    body = text_bytes(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))
    return assign_shards(rows, "doc_id", 8).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op3_sharding": op3_sharding}
#: DuckDB has no crc32, so tests/llm compares with the published loop instead.
ORACLES: dict[str, str] = {}
