"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1). BENCH_CPUS: threads (default 8).
The first query runs once to warm the session up, which builds the stored index that it and others search (index_build,
the time of that run, is not part of the sum); then each runs once, into a sink that takes every row.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from docloom import catalog  # noqa: E402

HEADLINES = [
    "bm25_topk", "dense_topk", "rrf_hybrid", "rrf_routed", "finance_rerank", "metric_aware_rerank", "page_dedup", "token_budget", "fact_coverage", "term_statistics", "clean_text", "overlap_windows",
    "nearest_range_join", "revenue_by_nation", "growth_calc", "token_f1", "hit_recall_at_k", "run_summary", "session_30m",
]


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds, built = catalog.queries(), {}, None
    with contextlib.redirect_stdout(sys.stderr):
        for name in (HEADLINES[0], *HEADLINES):  # the first runs once more, to warm up
            began = time.time()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - began, 3)
            built = built or seconds[name]
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "index_build": built, "sf": folder.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
