"""Tool calls: what is accepted, what is rejected, and what they leave as evidence."""

import json

import pytest

from docloom.operators import agent as A

ROWS = {"a": (5, "Lãi 1.234 tỷ và 1.000 tỷ"), "b": (6, "Vốn 200 khách"), "c": (7, "Nợ 1 000,5 ₫"), "d": (8, "Khác")}
FOUND = {"tăng": ["a", "b"], "khác": ["d", "a"], "lãi": ["a"]}
CALC = {"tool": "calculator", "operation": "subtract", "left": {"value": "1.234", "page": 5}, "right": {"value": "1.000", "page": 5}, "unit": "tỷ"}
REPLIES = {
    "sub": json.dumps(CALC), "pct": "```json\n" + json.dumps(CALC | {"operation": "percentage_change"}) + "\n```", "nested": json.dumps({"calculator": {k: v for k, v in CALC.items() if k != "tool"}}),
    "cagr": json.dumps(CALC | {"operation": "cagr", "years": 2}), "noyears": json.dumps(CALC | {"operation": "cagr"}), "op": json.dumps(CALC | {"operation": "divide"}), "page": json.dumps(CALC | {"left": {"value": "1.234", "page": 6}}),
    "field": json.dumps(CALC | {"left": {"value": "1.234"}}), "none": json.dumps({k: v for k, v in CALC.items() if k != "left"}), "number": json.dumps(CALC | {"left": {"value": 200, "page": 6}}), "word": json.dumps(CALC | {"left": {"value": "Lãi", "page": 5}}),
    "again": '{"tool": "hybrid_retrieve", "query": " khác "}', "nestagain": '{"hybrid_retrieve": {"query": "khác"}}', "same": '{"tool": "hybrid_retrieve", "query": "TĂNG"}', "empty": '{"tool": "hybrid_retrieve"}',
    "broken": "{oops", "list": "[1]", "tool": '{"tool": "shell", "query": "rm"}', "finish": '{"finish": {}}', "null": None, "two": '{"calculator": {}, "finish": {}}',
}


@pytest.fixture(scope="module")
def answered(spark):
    def search(queries, k):
        rows = [(q.query, key, ROWS[key][0], 1.0 - n / 10 if q.text != "khác" else 0.95 - n / 2, ROWS[key][1]) for q in queries.collect() for n, key in enumerate(FOUND.get(q.text, [])[:k])]
        return spark.createDataFrame(rows, "query string, key string, page int, score double, text string")

    seen = {}

    def planner(shown):
        seen.update({r.query: r.preview for r in shown.collect()})
        return spark.createDataFrame([(q, r) for q, r in REPLIES.items() if q in seen], "query string, reply string")

    questions = spark.createDataFrame([(q, "tăng") for q in REPLIES] + [("quiet", "lãi"), ("silent", "tăng"), ("nothing", "tăng gì")], "query string, text string")
    evidence, trace = A.tool_search(questions, search, planner, A.AgentSettings(triggers=("tăng",), k=3))
    rows = {}
    for r in evidence.orderBy("query", "position").collect():
        rows.setdefault(r.query, []).append(r)
    return rows, {r.query: (r.source, r.tool, r.outcome, r.evidence) for r in trace.collect()}, seen


def test_calls_and_outcomes(answered):
    rows, trace, seen = answered
    calc, look = "calculator", "hybrid_retrieve"
    rejected = lambda why: ("planner", calc, f"rejected:{why}", 2)
    assert trace == {
        "sub": ("planner", calc, "ok", 3), "pct": ("planner", calc, "ok", 3), "nested": ("planner_nested_tool_json", calc, "ok", 3), "cagr": ("planner", calc, "ok", 3), "noyears": rejected("invalid_cagr_inputs"),
        "op": rejected("operation_not_allowed"), "page": rejected("operands_not_verbatim_in_evidence"), "field": rejected("invalid_operand_fields"), "none": rejected("invalid_operands"), "number": ("planner", calc, "ok", 3), "word": rejected("invalid_number"),
        "again": ("planner", look, "ok", 3), "nestagain": ("planner_nested_tool_json", look, "ok", 3), "same": ("planner", look, "rejected_invalid_followup", 2), "empty": ("planner", look, "rejected_invalid_followup", 2),
        "broken": ("planner_invalid_json", "finish", "ok", 2), "list": ("planner_invalid_json", "finish", "ok", 2), "tool": ("planner_invalid_tool", "finish", "ok", 2), "finish": ("planner_nested_tool_json", "finish", "ok", 2), "null": ("planner_invalid_json", "finish", "ok", 2),
        "two": ("planner_invalid_tool", "finish", "ok", 2), "quiet": ("not_triggered", None, None, 1), "silent": ("planner_invalid_json", "finish", "ok", 2), "nothing": ("planner_invalid_json", "finish", "ok", 0),
    }
    assert "quiet" not in seen and seen["sub"].startswith("E1 | page=5 | id=a\nLãi") and seen["nothing"] == ""


def test_evidence(answered):
    rows, _, _ = answered
    first = rows["sub"][0]
    assert (first.text, first.page, first.source_keys) == ("1.234 − 1.000 = 234 tỷ", 5, ["a", "a"]) and [r.key for r in rows["sub"][1:]] == ["a", "b"]
    assert first.key == rows["nested"][0].key and first.key.startswith("calculation_")
    assert rows["pct"][0].text == "(1.234 − 1.000) / 1.000 × 100 = 23,4%" and rows["cagr"][0].text == "(1.234 / 1.000)^(1/2.0) − 1 = 11,09%"
    assert rows["number"][0].text == "200 − 1.000 = -800 tỷ" and rows["number"][0].source_keys == ["b", "a"]
    # the better score of a row that both searches found
    assert [(r.key, round(r.score, 2)) for r in rows["again"]] == [("a", 1.0), ("d", 0.95), ("b", 0.9)]
    assert [r.key for r in rows["op"]] == ["a", "b"] and [r.key for r in rows["quiet"]] == ["a"]
