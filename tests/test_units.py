"""Operators on small literal rows."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.operators import conversation as V
from docloom.operators import coverage as COV
from docloom.operators import evaluation as E
from docloom.operators import retrieval as R
from docloom.operators import selection as S
from docloom.sources import records as REC


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_tokens(spark):
    assert one(spark, "Die Quote-A stieg 12,5%", lambda x: T.lexical_tokens(x, True)) == ["die", "quote-a", "stieg", "12,5%", "die::quote-a", "quote-a::stieg", "stieg::12,5%"]
    assert one(spark, None, T.lexical_tokens) == [] and one(spark, "one", lambda x: T.lexical_tokens(x, True)) == ["one"]
    assert one(spark, "in 1999, 3000 and 2021 twice 2021", T.years) == ["1999", "2021"]
    assert one(spark, "7 of 2020 and 1,5%", T.non_year_numbers) == ["7", "1,5%"]
    assert one(spark, "so [p. 3, 14] and [p. 14]", T.citations) == [3, 14]
    assert one(spark, "", T.token_estimate) == 1 and one(spark, "äää", T.token_estimate) == 2


def test_normal_forms(spark):
    assert one(spark, "ﬁne", T.nfkc) == "fine" and one(spark, "é", T.nfc) == "é" and one(spark, "Đồng  Ấm", T.fold) == "dong am"
    assert one(spark, "5 and 2020", lambda x: T.redact_new_numbers(F.lit("in 2020"), x)) == "[number] and 2020"
    assert one(spark, None, T.nfkc) is None


def test_markup(spark):
    assert one(spark, "<p>a<br/>b</p><!-- x --><script>y</script><td>c</td>", T.html_to_text) == "a\nb\nc ;"
    assert one(spark, "# Top\n* item\n[link](u) **bold**\n|--|--|", T.markdown_to_text) == "Top\nitem\nlink bold"
    assert one(spark, "x\n## Part two\n", T.markdown_heading) == "Part two"
    assert C.row_texts(C.tables_of("<table><tr><th>k</th><th></th></tr><tr><td>a &amp; b</td><td>1</td></tr></table>")[0]) == ["k: a & b | column 2: 1"]
    assert C.row_texts(C.tables_of("| a | b |\n|---|---|\n| 1 | 2 |")[0]) == ["a: 1 | b: 2"]
    assert C.row_texts(C.tables_of("<table><tr><th>only</th></tr></table>")[0]) == ["only"]


def test_numbers(spark):
    cases = {"1.234": "1234", "12,5": "12.5", "1.234,5": "1234.5", "(7)": "-7", "-": None, "12.5": "12.5", "3%": "3", "x": None}
    for raw, want in cases.items():
        got = one(spark, raw, N.parse_decimal)
        assert got == (None if want is None else Decimal(want)), raw
    assert one(spark, 1192.5, lambda x: N.format_decimal(x, 2), "double") == "1.192,50" and one(spark, 2.5, lambda x: N.format_decimal(x, 0), "double") == "3"
    assert one(spark, 0.0, lambda x: N.change_percent(x, F.lit(5.0)), "double") is None
    assert one(spark, 100.0, lambda x: N.cagr_percent(x, F.lit(121.0), F.lit(2.0)), "double") == pytest.approx(10)


def test_windows():
    text = "word " * 50
    parts = list(C.cut(text, 40, 10))
    assert all(len(p) <= 40 for p in parts) and parts[0].split()[-1] == "word" and list(C.cut("", 5, 1)) == []
    assert list(C.cut("x" * 25, 10, 3)) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]


def test_fusion_prefers_overlap(spark):
    rows = lambda x: spark.createDataFrame(x, "q int, k string, rank int, score double")
    fused = R.fuse({"dense": (rows([(1, "a", 1, 0.9), (1, "b", 2, 0.8)]), 1.0), "bm25": (rows([(1, "c", 1, 1.0), (1, "a", 2, 0.7)]), 1.0)}, "q", "k", 3).orderBy("rank").collect()
    assert [r.k for r in fused] == ["a", "c", "b"] and fused[0].n_sources == 2 and fused[0].dense_score == 0.9


def test_blocks_equal_broadcast_search(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 5 = 0")
    assert sorted(R.dense_top_k(rows, asked, 4).collect()) == sorted(R.dense_top_k(rows, asked, 4, most_bytes=100).collect())


def test_selection(spark):
    rows = spark.createDataFrame([(1, "p", "a", 0.9, "w1 w2 w3 w4"), (1, "p", "b", 0.8, "w1 w2 w3 w4"), (1, "p", "c", 0.7, "x y z"), (1, "p", "d", 0.6, "k l m"), (1, "o", "e", 0.1, "x y z")], "q int, page string, id string, score double, text string")
    assert sorted(r.id for r in S.dedup_by_page(rows, ["q"], "page", "id", "score", "text").collect()) == ["a", "c", "e"]
    budget = spark.createDataFrame([(1, 1, "a", 40), (1, 2, "b", 80), (1, 3, "c", 50)], "q int, rank int, id string, n int")
    assert [r.id for r in S.token_budget(budget, ["q"], ["rank"], "id", "n", 6, 100).orderBy("position").collect()] == ["a", "c"]
    merged = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "c"), (1, 1, 2, "a")], "q int, turn int, rank int, id string")
    assert [r.id for r in S.round_robin(merged, ["q"], "id", "rank", "turn").orderBy("position").collect()] == ["a", "c", "b"]
    mmr = S.diverse(rows.withColumn("kind", F.lit("k")), "q", "id", "page", "kind", "score", "text", 3).orderBy("position").collect()
    assert mmr[0].id == "a" and "b" not in [r.id for r in mmr]


def test_parents_and_filters(spark):
    children = spark.createDataFrame([(1, "part"), (2, "whole text"), (3, "alone")], "pid int, text string")
    parents = spark.createDataFrame([(1, "whole text"), (2, "whole")], "pid int, parent_text string")
    assert {r.pid: r.text for r in R.expand_parents(children, parents, "pid").collect()} == {1: "part\n\nwhole text", 2: "whole text", 3: "alone"}
    rows = spark.createDataFrame([(1, True), (1, False), (2, False)], "q int, ok boolean")
    assert sorted(map(tuple, R.where_or_all(rows, ["q"], F.col("ok")).collect())) == [(1, True), (2, False)]


def test_layout(spark):
    box = "g int, id int, x0 double, y0 double, x1 double, y1 double"
    values = spark.createDataFrame([(1, 10, 100.0, 200.0, 160.0, 220.0), (1, 11, 600.0, 200.0, 660.0, 220.0)], box)
    labels = spark.createDataFrame([(1, 1, 100.0, 150.0, 160.0, 170.0), (1, 2, 100.0, 100.0, 160.0, 120.0), (1, 3, 600.0, 120.0, 660.0, 140.0)], box)
    assert {r.value_id: r.label_id for r in C.nearest_labels(values, labels, "g").collect()} == {10: 1, 11: 3}


def test_conversation(spark):
    turns = spark.createDataFrame([(1, 1, "user", "Revenue in 2020?"), (1, 2, "assistant", "5"), (1, 3, "user", "and in 2021?")], "conv_id int, turn int, role string, text string")
    got = {r.turn: (r.anchor, r.rewritten) for r in V.rewrite_follow_up(turns).collect()}
    assert got[3] == ("Revenue in 2020?", "Revenue in 2021?") and got[1] == (None, "Revenue in 2020?")


def test_scores(spark):
    pairs = spark.createDataFrame([(1, "a b b", "b b c"), (2, "", ""), (3, "x", ""), (4, "x", "y")], "k int, p string, g string")
    assert {r.k: r.f1 for r in E.token_f1(pairs, ["k"], "p", "g").collect()} == {1: 0.666667, 2: 1.0, 3: 0.0, 4: 0.0}
    row = spark.createDataFrame([([1, 2, 2], [2, 9], [])], "c array<int>, g array<int>, e array<int>")
    assert row.select(*E.citation_scores(F.col("c"), F.col("g"))).first()[:] == (0.5, 0.5, False)
    assert row.select(*E.citation_scores(F.col("e"), F.col("e"))).first()[:] == (0.0, None, True)
    assert row.select(E.recall_at(F.col("c"), F.col("e"), 5), E.first_rank(F.col("c"), F.col("g"))).first()[:] == (None, 2)


def test_unknown_fact(spark):
    row = spark.createDataFrame([("the value is 5",)], "text string")
    got = row.select(COV.has_fact(F.col("text"), []).alias("a"), COV.has_fact(F.col("text"), [["the"], ["value"]], "[0-9]").alias("b")).first()
    assert got[:] == (False, True)


def test_sources(spark, tmp_path):
    (tmp_path / "fragment_2.json").write_text(json.dumps({"raw_id": "b", "logical_index": 2, "markdown": "x", "structured_result": {"res": {"parsing_res_list": [{"block_label": "text", "block_content": "c", "block_bbox": [1, 2, 3], "block_order": 1}]}}}))
    (tmp_path / "fragment_1.json").write_text(json.dumps({"raw_id": "a", "logical_index": 1, "markdown": "y"}))
    (tmp_path / "fragment_3.json").write_text(json.dumps({"raw_id": "c", "logical_index": 0}))
    (tmp_path / "other.json").write_text("{}")
    records = REC.read_records(spark, str(tmp_path))
    assert sorted(r.raw_id for r in records.collect()) == ["a", "b"]
    assert [(r.raw_id, r.text, r.bbox) for r in REC.blocks(records).collect()] == [("b", "c", None)]
    q = tmp_path / "q.json"
    q.write_text(json.dumps(["bare", {"id": "z", "question": "full", "answerable": True, "gold_printed_pages": [3], "category": "kind"}]))
    got = REC.read_questions(spark, str(q)).orderBy("id").collect()
    assert [(r.id, r.question, r.gold_printed_pages, r.question_type) for r in got] == [("q-001", "bare", [], "unspecified"), ("z", "full", [3], "kind")]
    q.write_text(json.dumps([{"id": "z", "question": "full", "answerable": True}]))
    with pytest.raises(ValueError):
        REC.read_questions(spark, str(q))
    for body in ([{"id": "a", "correct": True}], {"a": {"correct": True}}):
        (tmp_path / "r.json").write_text(json.dumps(body))
        assert [tuple(r)[:2] for r in REC.read_reviews(spark, str(tmp_path / "r.json")).collect()] == [("a", True)]


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, text string")
    path = str(tmp_path / "chunks")
    made = REC.write_manifest(rows, ["id", "text"], path).first()
    assert made.rows == 2 and REC.verify(spark, path, ["id", "text"]).count() == 0
    REC.append_log(rows, str(tmp_path / "log"))
    REC.append_log(rows, str(tmp_path / "log"))
    assert REC.read_jsonl(spark, str(tmp_path / "log"), "id int, text string").count() == 4


def test_config(spark, tmp_path):
    from docloom.config import RetrievalConfig, load_config, preflight

    path = tmp_path / "c.json"
    path.write_text(json.dumps({"mode": "bm25", "k": 3, "candidates": 5}))
    assert load_config(str(path)) == RetrievalConfig(mode="bm25", k=3, candidates=5)
    for bad in ({"mode": "bm25", "k": 3}, {"mode": "x", "k": 3, "candidates": 5}, {"mode": "bm25", "k": 9, "candidates": 5}, {"mode": "bm25", "k": 3, "candidates": 5, "z": 1}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            load_config(str(path))
    chunks = spark.createDataFrame([(1,), (2,)], "id int")
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec int, e array<double>")
    preflight(spark, chunks, vectors, "id", "vec", "e", 1)
    with pytest.raises(ValueError):
        preflight(spark, chunks, vectors.where("vec = 1"), "id", "vec", "e", 1)


def test_sql_functions(spark):
    from docloom.functions.register import register

    register(spark)
    rows = spark.sql("SELECT w.seq, w.text FROM (SELECT 'aa bb cc dd' AS t) d, LATERAL text_windows(d.t, 6, 1) w").collect()
    assert [r.text for r in rows] == [x for x in C.cut("aa bb cc dd", 6, 1)]
    assert spark.sql("SELECT m.text FROM LATERAL markup_rows('| a | b |\n| 1 | 2 |') m").first()[0] == "a: 1 | b: 2"
    assert spark.sql("SELECT fold_text('Ärger')").first()[0] == "arger"
