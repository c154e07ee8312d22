import zlib

from docloom.llm.sharding import assign_shards, jump_shards, op3_sharding
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def loop(key, n):
    """The published loop on unsigned 64-bit integers."""
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_published_loop(spark):
    keys = [0, 1, 2, -1, -(2**63), 2**63 - 1, *range(1000, 1400), *(k * 7919 * 10**9 for k in range(300))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 13):
        for k, s in df.select("k", jump_shards(F.col("k"), n).alias("s")).collect():
            assert (s.shard, s.grown) == (loop(k, n), loop(k, n + 1))


def test_edges(spark):
    rows = [(None, "a")] * 3 + [(5, None)] * 4 + [(6, "x")]
    out = assign_shards(spark.createDataFrame(rows, "k long, slot string"), "k", 4).collect()
    assert len(out) == 8 and len({r.shard for r in out if r.k is None}) == 1
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert assign_shards(spark.createDataFrame([], "k long"), "k", 4).count() == 0


def test_query(spark):
    got = op3_sharding(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        body = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 1, zlib.crc32(body), "key")
        assert r.shard == loop(r.doc_id, 8) and r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
