"""Streams whose state ends, and recognition that survives failures and restarts."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from docloom.streaming import activity as A
from docloom.streaming import events as S
from docloom.streaming import recognition as G

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def test_runs_merge_in_any_order():
    rng = random.Random(3)
    for _ in range(200):
        times = [rng.randrange(200) for _ in range(rng.randrange(1, 30))]
        runs = []
        for t in times:
            runs = A.merged(runs + [(t, t, 1, [(t, str(t))])], 7, 3)
        want = []
        for t in sorted(times):
            if want and t - want[-1][-1] < 7:
                want[-1].append(t)
            else:
                want.append([t])
        assert runs == [(w[0], w[-1], len(w), [(t, str(t)) for t in w[-3:]]) for w in want]


def test_activity_comes_out_once_over_batches(spark, tmp_path):
    """Three files in three batches: a run goes on across files, late rows are dropped, what is open stays in."""
    minutes = [
        [(1, 0, "a"), (1, 5, "b"), (2, 3, "x"), (3, None, "y")],
        [(1, 12, "c"), (1, 9, "d"), (2, 60, "z"), (4, 100, None)],
        [(1, 1, "late"), (5, 300, "q"), (5, 301, "r")],
    ]
    for i, rows in enumerate(minutes):
        made = [(k, None if m is None else START + datetime.timedelta(minutes=m), e) for k, m, e in rows]
        spark.createDataFrame(made, "k long, ts timestamp, e string").coalesce(1).write.parquet(f"{tmp_path}/raw{i}")
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        part = next((tmp_path / f"raw{i}").glob("*.parquet"))
        part.rename(folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + 10 * i,) * 2)  # files arrive in the order of their times
    stream = S.table_stream(spark, f"{folder}", files=1)
    with A.with_families(spark):
        out = S.run_to_end(A.ended_activity(stream, "k", "e", 600, "10 minutes"), "append")
    got = {(r.k, r.n, tuple(r.recent)) for r in out.collect()}
    assert got == {(1, 4, ("b", "d", "c")), (2, 1, ("x",)), (2, 1, ("z",)), (4, 1, ("None",))}


def flaky(folder):
    """Fails on "bad" always, on "once" the first time, and counts its calls by files."""

    def one(x):
        import pathlib
        import uuid

        (pathlib.Path(folder) / f"{x}-{uuid.uuid4().hex}").touch()
        seen = len(list(pathlib.Path(folder).glob(f"{x}-*")))
        if x is None or x == "bad" or (x == "once" and seen == 1):
            raise ValueError(f"cannot read {x}")
        return x.upper()

    return one


def test_recognition_retries_and_restarts(spark, tmp_path):
    calls, source, work = tmp_path / "calls", tmp_path / "in", f"{tmp_path}/work"
    calls.mkdir()
    spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "once"), ("d", None)], "id string, text string").coalesce(1).write.parquet(f"{source}")
    run = lambda: G.recognise_stream(S.table_stream(spark, f"{source}", files=1), "text", flaky(f"{calls}"), work, 3)
    tried = run()
    assert {(r.id, r.attempt, r.result) for r in G.recognised(tried).collect()} == {("a", 1, "GOOD"), ("c", 2, "ONCE")}
    assert {(r.id, r.error) for r in G.dead_letters(tried, 3).collect()} == {("b", "ValueError: cannot read bad"), ("d", "ValueError: cannot read None")}
    before = len(list(calls.iterdir()))
    assert before == 1 + 3 + 2 + 3
    spark.createDataFrame([("e", "new")], "id string, text string").coalesce(1).write.mode("append").parquet(f"{source}")
    tried = run()
    assert len(list(calls.iterdir())) == before + 1 and G.recognised(tried).count() == 3
    # a run that broke off after its attempts were written, before the stream committed: nothing is tried again
    (tmp_path / "work" / "state" / "commits" / "1").unlink()
    (tmp_path / "work" / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    tried = run()
    assert len(list(calls.iterdir())) == before + 1 and G.recognised(tried).count() == 3


def test_recognition_edges(spark, tmp_path):
    rows = spark.createDataFrame([], "id string, text string")
    rows.write.parquet(f"{tmp_path}/none")
    tried = G.recognise_stream(S.table_stream(spark, f"{tmp_path}/none"), "text", str.upper, f"{tmp_path}/w", 2)
    assert tried.count() == 0 and tried.columns == ["id", "text", "result", "error", "shard", "attempt"]
    with pytest.raises(ValueError):
        G.recognise_stream(S.table_stream(spark, f"{tmp_path}/none").withColumn("Error", F.lit(1)), "text", str.upper, f"{tmp_path}/w2")
