"""The stored index: tables that change, segments, routes, pruning, bounds."""

import random

import pytest
from pyspark.sql import functions as F
from test_index_and_records import brute

from docloom.operators import lexical as L
from docloom.operators import metrics as M


def found(rows, key="q"):
    out = {}
    for r in rows.collect():
        out.setdefault(r[key], {})[r.doc_id] = round(r.score, 4)
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert got[q] == pytest.approx({d: round(s, 4) for d, s in want[q].items()}, abs=2e-4)


def top(scores, k):
    return dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k])


def write(spark, path, rows, mode="overwrite"):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode(mode).parquet(path)


def test_a_table_that_changes(spark, tmp_path):
    path = str(tmp_path / "docs")
    texts = {1: "alpha beta", 2: "beta gamma", 3: None}
    write(spark, path, [(i, t, "en") for i, t in texts.items()])
    asked = spark.createDataFrame([(1, "alpha gamma")], "q long, text string")
    index = lambda: L.index_of(spark.read.parquet(path), path)
    first = index()
    same(found(L.search_index(first, asked, "q", 5)), {1: brute(texts, "alpha gamma")})
    assert index() is first  # nothing changed
    more = {7: "gamma gamma delta", 8: "alpha"}
    write(spark, path, [(i, t, "en") for i, t in more.items()], "append")
    grown = index()
    assert grown.segments == (1, 2)  # only the new file was indexed
    same(found(L.search_index(grown, asked, "q", 5)), {1: brute(texts | more, "alpha gamma")})
    merged = L.merge_segments(grown)
    assert merged.segments == (3,) and merged.digest == grown.digest
    same(found(L.search_index(merged, asked, "q", 5)), {1: brute(texts | more, "alpha gamma")})
    other = {1: "nothing here", 2: "gamma"}
    write(spark, path, [(i, t, "en") for i, t in other.items()])
    same(found(L.search_index(index(), asked, "q", 5)), {1: brute(other, "alpha gamma")})


def test_an_index_of_other_texts_is_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    L.build_index(docs, path=str(tmp_path / "i"))
    assert L.open_index(spark, str(tmp_path / "i"), 2, docs).documents == 2
    with pytest.raises(ValueError):
        L.open_index(spark, str(tmp_path / "i"), 2, docs.withColumn("text", F.lit("a b")))
    with pytest.raises(ValueError):
        L.append_documents(L.open_index(spark, str(tmp_path / "i")), docs, group="text")


def corpus():
    rng = random.Random(5)
    words = ["the"] * 30 + ["and"] * 20 + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    return {i: " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for i in range(300)}


@pytest.mark.parametrize("direct", [0, 10_000_000])
def test_bounds_change_nothing(spark, monkeypatch, direct):
    monkeypatch.setattr(L, "DIRECT_PAIRS", direct)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else "fr") for i, t in texts.items()], "doc_id long, text string, lang string")
    index = L.build_index(docs, group="lang")
    questions = {q: texts[q] + " the and the" for q in range(0, 300, 20)} | {1000: "the and", 1001: "the"}
    asked = spark.createDataFrame(list(questions.items()), "q long, text string")
    for k in (1, 3, 10):
        same(found(L.search_index(index, asked, "q", k)), {q: top(brute(texts, t), k) for q, t in questions.items()})
    alone = found(L.search_index(index, asked, "q", 3, exclude_self=True))
    same(alone, {q: top({d: s for d, s in brute(texts, t).items() if d != q}, 3) for q, t in questions.items()})
    routed = L.search_index(index, asked.withColumn("to", F.explode(F.array(F.lit("en"), F.lit("fr")))), "q", 4, route="to")
    for lang, own in (("en", lambda i: i % 3), ("fr", lambda i: not i % 3)):
        part = {i: t for i, t in texts.items() if own(i)}
        same(found(routed.where(F.col("group") == lang)), {q: top(brute(part, t), 4) for q, t in questions.items()})


@pytest.mark.parametrize("direct", [0, 10_000_000])
def test_only_parts_of_asked_terms_are_read(spark, monkeypatch, direct):
    monkeypatch.setattr(L, "DIRECT_PAIRS", direct)
    index = L.build_index(spark.createDataFrame(list(corpus().items()), "doc_id long, text string"))
    plan = L.search_index(index, spark.createDataFrame([(1, "waa wba")], "q long, text string"), "q", 3)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan and plan.count("SubqueryAdaptiveBroadcast") >= 2  # segment and part


def test_statistics_of_terms(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "B"), (3, None)], "doc_id long, text string")
    got = {r.term: (r.df, r.total) for r in L.term_statistics(L.build_index(docs)).collect()}
    assert got == {"a": (1, 2), "b": (2, 2)}
    assert {r.term for r in L.term_statistics(L.build_index(docs), pairs=True).collect()} == {"a", "b", "a::a", "a::b"}


def test_an_ambiguous_best_row_is_refused(spark):
    text = "Cột 1: Doanh thu thuần | 2021 tỷ đồng: 5 | 2022 %: 7\nCột 1: Doanh thu | 2021 tỷ đồng: 1 | 2022 tỷ đồng: 2\nCột 1: Chi | 2021 tỷ đồng: 0 | 2022 tỷ đồng: (3,5)"
    rows = M.metric_rows(spark.createDataFrame([(1, text)], "id int, text string"), ["id"], "text")
    asked = [("units", "Doanh thu thuần năm 2022 so với 2021"), ("none", "Doanh thu thuần là bao nhiêu"), ("zero", "chi năm 2022 tăng so với 2021"), ("fall", "chi năm 2021 giảm so với 2022"), ("said", "Lợi nhuận năm 2020"), ("row", "Doanh thu thuần năm 2021")]
    asked = spark.createDataFrame([(q, t, 1) for q, t in asked], "q string, question string, id int")
    fields = spark.createDataFrame([(1, "Lợi nhuận", "1,5", "tỷ đồng", ["▲ Tăng 3%", "tỷ đồng", "Tăng 3%"], 2020, "Lợi nhuận 1,5"), (1, "Chi", "9", None, None, 1900, "")], "id int, metric string, value string, unit string, details array<string>, reporting_year int, text string")
    got = {r.q: (r.kind, r["values"], r.delta and float(r.delta), r.percent, r.details, r.reason) for r in M.answers_from_rows(asked, rows, "q", "question", ["id"], semantic=fields).collect()}
    assert got == {
        "units": (None, None, None, None, None, "several_units"), "none": (None, None, None, None, None, "no_years"), "zero": (None, None, None, None, None, "no_number"),
        "fall": ("comparison", ["2021: 0", "2022: (3,5)"], 3.5, 100.0, None, None), "said": ("semantic", ["2020: 1,5 tỷ đồng"], None, None, ["Tăng 3%"], None), "row": ("lookup", ["2021: 5"], None, None, None, None),
    }


def test_financial_numbers(spark):
    df = spark.createDataFrame([("1.234",), ("+1.234,5%",), ("12,5x",), ("1.5",), ("-2",), ("a",)], "t string")
    assert [r[0] and float(r[0]) for r in df.select(M.financial_number(F.col("t"))).collect()] == [1234, 1234.5, 12.5, 1.5, -2, None]
    held = spark.createDataFrame([("lai suat",), ("lai suatx lai suat",), ("xlai suat",), (r"a \E b",)], "t string")
    assert [r[0] for r in held.select(M.holds_phrase(F.col("t"), F.lit("lai suat"))).collect()] == [True, True, False, False]
    assert [r[0] for r in held.select(M.holds_phrase(F.col("t"), F.lit(r"\E b"))).collect()] == [False, False, False, True]
