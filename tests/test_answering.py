"""Answers with one repair, and the contract of a router's reply."""

from pyspark.sql import functions as F

from docloom.operators import answering as W
from docloom.operators import routing as RT

EVIDENCE = [("good", 1, 5, 3.0, "Vốn 1.234 tỷ"), ("good", 2, 6, 2.0, "CASA 40,4 % năm 2024"), ("bare", 1, 5, 3.0, "Vốn 12"), ("wrong", 1, 7, 1.5, None), ("never", 1, 8, 1.5, "x 3"), ("weak", 1, 5, 0.2, "t"), ("no", 1, 5, 2.0, "t"), ("mute", 1, 5, 2.0, "t"), ("far", 1, 1, 2.0, "a"), ("far", 9, 2, 1.0, "beyond k 55")]
FIRST = {"good": "CASA là 40,4% [p. 6], vốn 1.234 [p. 5, 6] năm 2025", "bare": "Vốn 12", "wrong": "x [p. 9]", "never": "x 4 [p. 8]", "no": "Không đủ thông tin.", "far": "55 [p. 2]"}
SECOND = {"bare": "Vốn 12 [p. 5]", "wrong": "không đủ thông tin [p. 9]", "never": "x 34 [p. 8]", "mute": "t [p. 5]", "far": "không đủ thông tin"}


def models(spark):
    asked = []

    def model(replies):
        def run(prompts):
            asked.append({r.query: r.prompt for r in prompts.collect()})
            return spark.createDataFrame(list(replies.items()), "query string, reply string").join(prompts.select("query"), "query", "left_semi")

        return run

    return asked, model(FIRST), model(SECOND)


def test_one_repair_then_closed(spark):
    questions = spark.createDataFrame([(q, f"{q}?") for q in ("good", "bare", "wrong", "never", "weak", "no", "mute", "far")] + [("none", None)], "query string, text string")
    evidence = spark.createDataFrame(EVIDENCE, "query string, rank int, page int, score double, text string")
    asked, write, repair = models(spark)
    settings = W.AnswerSettings(k=3, least=1.0)
    got = {r.query: r for r in W.answered(questions, evidence, write, repair, settings).collect()}
    assert {q: (r.mode, r.calls, r.refused, r.valid, r.citations) for q, r in got.items()} == {
        "good": ("written", 1, False, True, [6, 5]), "bare": ("repaired", 2, False, True, [5]), "wrong": ("closed", 2, True, False, []), "never": ("closed", 2, True, False, []),
        "weak": ("no_evidence", 0, True, True, []), "none": ("no_evidence", 0, True, True, []), "no": ("written", 1, True, True, []), "mute": ("repaired", 2, False, True, [5]), "far": ("repaired", 2, True, True, []),
    }
    assert got["wrong"].answer == settings.closed and got["none"].answer == settings.refusal
    assert set(asked[0]) == {"good", "bare", "wrong", "never", "no", "mute", "far"} and set(asked[1]) == {"bare", "wrong", "never", "mute", "far"}
    assert asked[0]["good"] == "[evidence 2, page 6]\nCASA 40,4 % năm 2024\n\n[evidence 1, page 5]\nVốn 1.234 tỷ\n\nQuestion: good?"
    assert "Pages that may be cited: 5\n" in asked[1]["bare"] and "beyond k" not in asked[0]["far"]


def test_empty(spark):
    questions = spark.createDataFrame([], "query string, text string")
    evidence = spark.createDataFrame([], "query string, rank int, page int, score double, text string")
    asked, write, repair = models(spark)
    assert W.answered(questions, evidence, write, repair).count() == 0 and asked == [{}, {}]


ROUTES = ("narrative", "structured")
CASES = [
    ('{"route": "narrative", "confidence": 0.75, "reasons": ["why"]}', ("narrative", 0.75, ["why"], "model")),
    ('```json\n{"route": "narrative", "confidence": 1, "reasons": " why "}\n```', ("narrative", 1.0, ["why"], "model_normalized")),
    ('{"route": "narrative", "confidence": 0.25, "reasons": ["a"]}', ("multi_repr", 0.25, ["a", "confidence 0.250 below 0.500; instead of narrative"], "low_confidence_fallback")),
    ('{"route": "narrative", "confidence": 1.5, "reasons": ["a"]}', ("multi_repr", 0.0, ["confidence is not from 0 to 1"], "error_fallback")),
    ('{"route": "narrative", "confidence": "0.9", "reasons": ["a"]}', ("multi_repr", 0.0, ["confidence is no number"], "error_fallback")),
    ('{"route": 3, "confidence": 0.9, "reasons": ["a"]}', ("multi_repr", 0.0, ["unknown route"], "error_fallback")),
    ('{"route": "narrative", "confidence": 0.9, "reasons": ["a", 4]}', ("multi_repr", 0.0, ["no reasons"], "error_fallback")),
    ('{"route": "narrative", "confidence": 0.9, "reasons": ["a", " "]}', ("multi_repr", 0.0, ["no reasons"], "error_fallback")),
    ('{"route": "narrative", "confidence": 0.9, "reasons": ["a"], "query_features": {"n": true, "m": false}}', ("narrative", 0.9, ["a"], "model")),
    ('{"route": "narrative", "confidence": 0.9, "reasons": ["a"], "query_features": {"n": true}}', ("multi_repr", 0.0, ["other features"], "error_fallback")),
    ('{"route": "narrative", "confidence": 0.9, "reasons": ["a"], "query_features": {"n": true, "m": 1}}', ("multi_repr", 0.0, ["other features"], "error_fallback")),
    ("[1]", ("multi_repr", 0.0, ["no JSON object"], "error_fallback")), ("", ("multi_repr", 0.0, ["no JSON object"], "error_fallback")), (None, ("multi_repr", 0.0, ["no JSON object"], "error_fallback")), ('{"route": ', ("multi_repr", 0.0, ["no JSON object"], "error_fallback")),
]


def test_router_contract(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string")
    got = rows.select("i", RT.router_decision(F.col("raw"), ROUTES, ("n", "m")).alias("d")).orderBy("i").collect()
    for r, (raw, want) in zip(got, CASES):
        assert (r.d.route, r.d.confidence, r.d.reasons, r.d.source) == want, raw
