"""The stored index, records, histories, streams with late rows."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from docloom.config import RetrievalConfig
from docloom.functions import text as T
from docloom.operators import conversation as V
from docloom.operators import evaluation as E
from docloom.operators import factory
from docloom.operators import metrics as M
from docloom.operators import retrieval as R
from docloom.operators import selection as S
from docloom.sources import records
from docloom.streaming import events

TEXTS = {1: "The cat sat on the mat", 2: "a dog", 3: "the the the", 4: "", 5: None, 6: "Straße ﬁne CAFÉ café", 7: "cat dog cat dog"}


def terms(text):
    import unicodedata

    words = re.findall(r"[^\W\d_]+", unicodedata.normalize("NFKC", text or "").casefold())
    return words + [f"{a}::{b}" for a, b in zip(words, words[1:])]


def brute(texts, question, k1=1.2, b=0.75):
    docs = {i: terms(t) for i, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    out = {}
    for term in set(terms(question)):
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            if tf := d.count(term):
                out[i] = out.get(i, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean))
    return {i: round(x, 5) for i, x in out.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def test_index_equals_brute_force(spark, docs, tmp_path):
    asked = spark.createDataFrame([(1, "the CAT"), (2, "strasse fine café"), (3, "nothing here"), (4, None)], "q long, text string")
    index = R.build_index(docs)
    index.save(str(tmp_path / "index"))
    for found in (index, R.open_index(spark, str(tmp_path / "index"), 7)):
        for k1, b in ((1.2, 0.75), (2.0, 0.1)):
            got = {}
            for r in R.search_index(found, asked, "q", 10, k1=k1, b=b).collect():
                got.setdefault(r.q, {})[r.doc_id] = round(r.score, 5)
            want = {q: brute(TEXTS, t, k1, b) for q, t in ((1, "the CAT"), (2, "strasse fine café"))}
            assert got.keys() == want.keys() and all(got[q] == pytest.approx(want[q], abs=2e-5) for q in want)
    with pytest.raises(ValueError):
        R.open_index(spark, str(tmp_path / "index"), 8)
    empty = R.build_index(docs.where("false"))
    assert R.search_index(empty, asked, "q", 3).count() == 0


def test_part_of_an_index(spark, docs):
    some = {i: t for i, t in TEXTS.items() if i != 2}
    index = R.part_of(R.build_index(docs), docs.where("doc_id <> 2").select("doc_id"))
    asked = spark.createDataFrame([(1, "the dog")], "q long, text string")
    assert {r.doc_id: round(r.score, 5) for r in R.search_index(index, asked, "q", 10).collect()} == pytest.approx(brute(some, "the dog"), abs=2e-5)


def test_evidence_within_its_settings(spark, docs):
    config = RetrievalConfig(mode="bm25", k=3, least_score=0.5, max_rows=2, max_tokens=6)
    found = spark.createDataFrame([("q", 1, 1, 0.9), ("q", 2, 3, 0.8), ("q", 3, 7, 0.7), ("q", 4, 2, 0.4)], "query string, rank int, doc_id long, score double")
    got = [(r.position, r.doc_id) for r in factory.select_evidence(found, docs, config).orderBy("position").collect()]
    assert got == [(0, 1)]  # 6 tokens; the next would be 3 more


def test_ranks_of_hot_groups(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 10 else None, None if i % 37 == 0 else i * 7919 % 5000) for i in range(3000)], "id long, g string, v long")
    got = S.rank_hot_groups(rows, "g", "v", "id", 4)
    want = rows.selectExpr("id", "row_number() over (partition by g order by v desc, id) rn", "rank() over (partition by g order by v desc) rk", "dense_rank() over (partition by g order by v desc) dr", "ntile(4) over (partition by g order by v desc, id) quartile")
    assert sorted(map(tuple, got.select("id", "rn", "rk", "dr", "quartile").collect())) == sorted(map(tuple, want.collect()))


def test_ranking_scores(spark):
    found = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("a", 6, True), ("b", 1, False)], "q string, rank int, relevant boolean")
    gold = spark.createDataFrame([("a", 30), ("b", 2), ("c", 1), ("d", 0)], "q string, gold_n long")
    got = {r.q: r for r in E.ranking_scores(found, gold, "q").collect()}
    assert (got["a"].recall_1, got["a"].recall_5, got["a"].recall_10, got["a"].first) == (0.0, round(2 / 30, 6), 0.1, 2)
    assert (got["a"].citation_precision, got["a"].citation_recall) == (round(2 / 3, 6), round(2 / 30, 6))
    assert not got["b"].hit_10 and got["c"].recall_10 == 0.0 and got["c"].first is None and got["d"].recall_10 is None


def test_printed_candidates(spark):
    rows = [(1, "12", 10.0, 5.0), (1, "12", 95.0, 95.0), (1, "7", 50.0, 5.0), (1, "x9", 10.0, 5.0), (1, "1234", 10.0, 5.0), (1, "3", 10.0, 50.0), (2, "a", 0.0, 0.0)]
    words = spark.createDataFrame(rows, "page int, token string, x0 double, y0 double").withColumn("page_height", F.lit(100.0)).withColumn("clip", F.struct(F.lit(0.0).alias("x0"), F.lit(100.0).alias("width")))
    assert {r.page: r.candidates for r in records.printed_candidates(words, ["page"]).collect()} == {1: [12], 2: []}


def test_text_leaves_and_mapping(spark, tmp_path):
    value = {"a": ["x", {"b": "y \"quoted\" \\ ü", "n": 3}, ""], "c": {"d": {"e": "z:"}}, "k": None}
    df = spark.createDataFrame([(json.dumps(value),), ("{broken",), (None,), ("[]",)], "v string")
    assert [r[0] for r in df.select(records.text_leaves(F.col("v"))).collect()] == [["x", "y \"quoted\" \\ ü", "z:"], [], [], []]
    pages = spark.createDataFrame([(1, 5, "detected")], "logical_index int, printed_page int, mapping_method string")
    records.save_mapping(pages, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).collect()[0].printed_page == 5


def test_history(spark):
    rows = spark.createDataFrame([(1, "user", "café"), (1, None, "x"), (2, "user", None)], "conv_id int, role string, text string")
    assert sorted((r.conv_id, r.text) for r in V.normal_history(rows).collect()) == [(1, "café"), (2, "")]


def test_late_rows_are_dropped(spark, tmp_path):
    """A row behind the watermark of the batch before does not count; one within it does."""
    folder = str(tmp_path / "events")
    schema = "event_id long, ts timestamp, event_type string, value double"
    batch = lambda *rows: spark.createDataFrame([(i, t, "a", 1.0) for i, t in rows], "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)
    batch((1, "2024-01-01 10:00:00"), (2, "2024-01-03 00:00:00"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = events.with_watermark(spark.readStream.schema(schema).parquet(folder), "1 hour", lambda e: events.tumbling(e, "1 day", ["event_type"]))
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return {str(r.start)[:10]: r.n for r in spark.read.parquet(out).collect()}

    assert run() == {"2024-01-01": 1}
    batch((3, "2024-01-01 11:00:00"), (4, "2024-01-02 23:30:00"), (5, "2024-01-04 12:00:00"))
    assert run() == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-03": 1}


def test_state_lasts_from_batch_to_batch(spark, tmp_path):
    folder = str(tmp_path / "events")
    for k in range(3):
        spark.createDataFrame([(1, 1.5), (2, float(k))], "user_id long, value double").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("user_id long, value double").option("maxFilesPerTrigger", 1).parquet(folder)
    got = events.last_of_each(events.running_totals(stream, "user_id", "value"), "user_id", "n").collect()
    assert {r.user_id: (r.n, r.total) for r in got} == {1: (3, 4.5), 2: (3, 3.0)}


def test_metric_rows(spark):
    text = "Chỉ tiêu: Thu nhập  lãi thuần | 2020 Tỷ đồng: 1.234,5 | 2021 tỷ đồng: (12) | 2021 tỷ đồng: 13\nCột 1: Chi | 2020 %: -\nlời nói"
    df = spark.createDataFrame([(1, text), (2, None), (3, "Chỉ tiêu: none")], "id int, text string")
    got = sorted((r.label, r.year, r.value, r.unit) for r in M.metric_rows(df, ["id"], "text").collect())
    assert got == [("Chi", "2020", "-", "%"), ("Thu nhập lãi thuần", "2020", "1.234,5", "tỷ đồng"), ("Thu nhập lãi thuần", "2021", "13", "tỷ đồng")]
    asked = spark.createDataFrame([("a", "thu nhập lãi thuần 2021 so với 2020", 1), ("b", "thu nhập lãi thuần 1999", 1), ("c", "chi 2020", 1), ("d", "thu nhập lãi thuần 2020 và 2021", 1)], "q string, question string, id int")
    rows = M.metric_rows(df, ["id"], "text")
    got = {r.q: (r.kind, r["values"], r.delta and float(r.delta), r.reason) for r in M.answers_from_rows(asked, rows, "q", "question", ["id"]).collect()}
    assert got == {"a": ("comparison", ["2021: 13", "2020: 1.234,5"], -1221.5, None), "b": (None, None, None, "no_row"), "c": ("lookup", ["2020: -"], None, None), "d": (None, None, None, "neither_lookup_nor_comparison")}


def test_normal_form(spark):
    df = spark.createDataFrame([("ﬁ STRASSE Straße",), ("ΟΔΟΣ",), (None,), ("plain",)], "t string")
    assert [r[0] for r in df.select(T.normal_form(F.col("t"))).collect()] == ["fi strasse strasse", "οδοσ", "", "plain"]
