"""Runs of activity with state that ends: what goes quiet comes out once, and its state is dropped.

The state of Spark's own processors, with timers in event time. They need the state store that has column
families; `with_families` sets it on a session and puts the old one back.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FAMILIES = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_families(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, FAMILIES)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def runs_of(times: np.ndarray, gap: int) -> np.ndarray:
    """Where runs begin in sorted times: at the first, and wherever the step before is at least gap."""
    return np.flatnonzero(np.r_[True, np.diff(times) >= gap]) if len(times) else np.array([], dtype=int)


def merged(runs: list[tuple], gap: int, recent: int) -> list[tuple]:
    """(first, last, n, items) joined where less than gap lies between; items are (time, text), the latest last."""
    out: list[tuple] = []
    for first, last, n, items in sorted(runs, key=lambda r: r[:2]):
        if out and first - out[-1][1] < gap:
            a = out.pop()
            first, last, n, items = a[0], max(a[1], last), a[2] + n, sorted(a[3] + items)[-recent:]
        out.append((first, last, n, items))
    return out


class Activity(StatefulProcessor):
    """Keeps the open runs of each key: when they began and last went on, how many rows they have, and the latest few items."""

    def __init__(self, key: str, time: str, item: str, gap: int, recent: int):
        self.names, self.gap, self.recent = (key, time, item), gap, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", "first long, last long, n long, times array<long>, items array<string>")

    def _read(self) -> list[tuple]:
        return [(a, b, n, list(zip(t, i))) for a, b, n, t, i in self.runs.get()]

    def _store(self, runs: list[tuple]) -> None:
        rows = [(int(a), int(b), int(n), [int(t) for t, _ in i], [x for _, x in i]) for a, b, n, i in runs]
        self.runs.put(rows) if rows else self.runs.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, time, item = self.names
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        runs = self._read()
        for batch in rows:
            at = batch[time].to_numpy("datetime64[us]").astype(np.int64)
            fresh = at >= mark  # what the watermark has passed may belong to a run that has come out
            order = np.lexsort((batch[item].to_numpy(str)[fresh], at[fresh]))
            at, items = at[fresh][order], batch[item].to_numpy()[fresh][order]
            starts = runs_of(at, self.gap)
            for a, b in zip(starts, np.r_[starts[1:], len(at)]):
                last = max(a, b - self.recent)
                runs.append((int(at[a]), int(at[b - 1]), int(b - a), [(int(t), str(x)) for t, x in zip(at[last:b], items[last:b])]))
            runs = merged(runs, self.gap, self.recent)
        self._store(runs)
        self._watch(runs)
        yield from ()

    def _watch(self, runs: list[tuple]) -> None:
        """One timer for each key: the end of the run that ends first."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if runs:
            self.handle.registerTimer(-(-(min(r[1] for r in runs) + self.gap) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        runs = self._read()
        over = [r for r in runs if r[1] + self.gap <= mark]
        still = [r for r in runs if r[1] + self.gap > mark]
        self._store(still)
        self._watch(still)
        if over:
            stamp = lambda i: pd.to_datetime([r[i] for r in over], unit="us", utc=True)
            yield pd.DataFrame({self.names[0]: [key[0]] * len(over), "first": stamp(0), "last": stamp(1), "n": [r[2] for r in over], "recent": [[x for _, x in r[3]] for r in over]})

    def close(self) -> None:
        pass


def ended_activity(events: DataFrame, key: str, item: str, gap_seconds: int, late: str, recent: int = 3, time: str = "ts") -> DataFrame:
    """(key, first, last, n, recent): each run of rows of a key with less than the gap between, once it can no longer go on.

    A run is over when the watermark (the latest time less `late`) has passed its last row by the gap. Rows
    older than the watermark are dropped, as are those without a time; a null item counts as the text "None".
    Rows of one batch may come in any order. Of a key, only open runs are kept, with `recent` items each.
    """
    rows = events.where(events[time].isNotNull()).withWatermark(time, late)
    kind = dict(events.dtypes)[key]
    processor = Activity(key, time, item, gap_seconds * 1_000_000, recent)
    return rows.select(key, time, item).groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"{key} {kind}, first timestamp, last timestamp, n long, recent array<string>", outputMode="Append", timeMode="EventTime")
