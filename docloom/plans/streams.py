"""Queries over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.storage import new_path
from docloom.streaming import activity as A
from docloom.streaming import events as S
from docloom.streaming import recognition as G


def _plain(df: DataFrame) -> DataFrame:
    """Starts without a zone, as the table has them."""
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stream_of(spark, f"{sf_dir}/events.parquet")


def tumbling_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(S.run_to_end(S.tumbling(_events(spark, sf_dir), "1 day", ["event_type"]), "complete"))


TUMBLING_SQL = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def sliding_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(S.run_to_end(S.sliding(_events(spark, sf_dir), "2 days", "1 day"), "complete"))


SLIDING_SQL = "WITH d AS (SELECT date_trunc('day', ts) AS d FROM events), w AS (SELECT d AS start FROM d UNION ALL SELECT d - INTERVAL 1 DAY FROM d) SELECT strftime(start::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM w GROUP BY 1"


def session_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(S.run_to_end(S.sessions(_events(spark, sf_dir), "30 minutes", "user_id"), "complete"))


SESSION_SQL = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, s"""


def dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.deduplicated(_events(spark, sf_dir), "event_id", "1 hour").select("event_id", "event_type")
    return S.run_to_end(rows, "append")


DEDUP_SQL = "SELECT DISTINCT event_id, event_type FROM events"

def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts under a watermark, in append mode: days that the watermark has not passed are still open and do not come out."""
    daily = S.with_watermark(_events(spark, sf_dir), "1 hour", lambda e: S.tumbling(e, "1 day", ["event_type"]))
    return _plain(S.run_to_end(daily, "append"))


LATE_SQL = """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events), d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
    SELECT strftime(day, '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, n, total FROM d, m WHERE day + INTERVAL 1 DAY <= mark"""


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each user from state that the stream keeps."""
    rows = S.running_totals(_events(spark, sf_dir).select("user_id", "value"), "user_id", "value")
    return S.last_of_each(rows, "user_id", "n").select("user_id", "n", F.round("total", 2).alias("total"))


TOTALS_SQL = "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id"


def ended_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events of a user less than 30 minutes apart, once they are over, with their last three kinds."""
    with A.with_families(spark):
        runs = S.run_to_end(A.ended_activity(_events(spark, sf_dir), "user_id", "event_type", 1800, "1 hour"), "append")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return runs.select("user_id", stamp("first"), stamp("last"), "n", F.array_join("recent", ",").alias("recent"))


ENDED_SQL = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
    r AS (SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, list(event_type ORDER BY ts, event_type)[-3:] AS recent FROM s GROUP BY user_id, s)
    SELECT user_id, strftime(first, '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(last, '%Y-%m-%d %H:%M:%S.%f') AS last, n, array_to_string(recent, ',') AS recent
    FROM r WHERE last + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR"""


def _first_heading(page: str) -> str:
    """Stands in for recognition: the words of a page's first heading, in languages that it knows."""
    import re

    lang = re.search(r'lang="([a-z]*)"', page).group(1)
    if lang not in ("en", "de"):
        raise ValueError(f"language {lang}")
    return re.search(r"(?s)<h1>(.*?)</h1>", page).group(1)


def recognised_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as they arrive: recognised ones with their heading, dead letters with their error, and the attempts of each."""
    attempts = G.recognise_stream(S.table_stream(spark, f"{sf_dir}/pages.parquet").select("page_id", "html"), "html", _first_heading, new_path(spark, "recognition"), 2)
    good = G.recognised(attempts).select("page_id", "attempt", F.md5("result").alias("result"), F.lit(None).cast("string").alias("error"))
    return good.unionByName(G.dead_letters(attempts, 2).select("page_id", "attempt", F.lit(None).cast("string").alias("result"), "error"))


RECOGNISED_SQL = """WITH p AS (SELECT page_id, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h FROM pages)
    SELECT page_id, CASE WHEN lang IN ('en', 'de') THEN 1 ELSE 2 END AS attempt, CASE WHEN lang IN ('en', 'de') THEN md5(h) END AS result, CASE WHEN lang NOT IN ('en', 'de') THEN 'ValueError: language ' || lang END AS error FROM p"""

QUERIES = {f.__name__: f for f in (tumbling_daily, sliding_2d, session_30m, dedup_watermark, late_events, running_totals, ended_activity, recognised_stream)}
ORACLES = {"tumbling_daily": TUMBLING_SQL, "sliding_2d": SLIDING_SQL, "session_30m": SESSION_SQL, "dedup_watermark": DEDUP_SQL, "late_events": LATE_SQL, "running_totals": TOTALS_SQL, "ended_activity": ENDED_SQL, "recognised_stream": RECOGNISED_SQL}
