"""Controllers against plain versions of their rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import adaptive as A
from docloom.operators import coverage as COV
from docloom.operators import finance as FI
from docloom.operators import selection as S


def similar(a, b):
    if not a or not b:
        return float(a == b)
    return max(len(a & b) / len(a | b), len(a & b) / min(len(a), len(b)))


BONUS = {"n": {"row": 0.06, "block": 0.03, "page": -0.03}, "e": {"block": 0.03, "row": -0.03}}


def plain_diverse(pool, k, question="", protected=None, balance=0.7):
    """pool: (key, page, kind, score, words), best first."""
    top, low = pool[0][3], pool[-1][3]
    rel = lambda s: 1.0 if top == low else s / top
    asks = "e" if "nguyên nhân" in question else "n" if "bao nhiêu" in question else None
    taken = []
    while len(taken) < min(k, len(pool)):
        def worth(c):
            v = balance * rel(c[3]) + 1e-6 * c[3] + BONUS.get(asks, {}).get(c[2], 0.0)
            if taken:
                v -= (1 - balance) * max(similar(c[4], t[4]) for t in taken) + 0.08 * any(c[1] == t[1] for t in taken) + 0.025 * any(c[2] == t[2] for t in taken)
            return v

        taken.append(max((c for c in pool if c not in taken), key=worth))
    asked = {w for w in question.split() if len(w) > 1} - {"bao", "nhiêu", "là"}
    if asked:
        direct = max(pool, key=lambda c: (len(asked & c[4]) / len(asked), c[3]))
        window = min(protected or min(5, k), k)
        if len(asked & direct[4]) / len(asked) >= 0.5 and direct[3] >= 0.85 * top and direct not in taken[:window]:
            taken = [t for t in taken if t != direct]
            taken.insert(window - 1, direct)
    return [t[0] for t in taken[:k]]


WORDS = "alpha beta gamma delta lãi vốn nợ 2021 17 lợi nhuận".split()


def pools(n=40, seed=1):
    rng = random.Random(seed)
    out = []
    for q in range(n):
        question = rng.choice(["lãi vốn bao nhiêu", "nguyên nhân nợ", "alpha beta", ""])
        rows = [(q, question, i, rng.choice("abc"), rng.choice(["row", "block", "page"]), round(rng.uniform(0.2, 1), 3), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 12)))) for i in range(rng.randint(1, 9))]
        out.append((q, question, rows))
    return out


def test_diversity_in_full(spark):
    data = pools()
    df = spark.createDataFrame([r for _, _, rows in data for r in rows], "q int, question string, key int, page string, kind string, score double, text string")
    for k, protected in ((5, None), (4, 2)):
        got = {}
        for r in S.diverse(df, "q", "key", "page", "kind", "score", "text", k, question="question", protected=protected).orderBy("q", "position").collect():
            got.setdefault(r.q, []).append(r.key)
        for q, question, rows in data:
            pool = sorted(((r[2], r[3], r[4], r[5], set(r[6].split())) for r in rows), key=lambda c: (-c[3], c[0]))
            assert got[q] == plain_diverse(pool, k, question, protected), (q, question)


def plain_evidence(question, rows, s):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        mine = [x for x in kept if x[1] == r[1]]
        if len(mine) < s.most_per_page and all(similar(set(x[4].split()), set(r[4].split())) < s.threshold for x in mine):
            kept.append(r)
    order = plain_diverse([(*r[:4], set(r[4].split())) for r in kept], s.diverse, question, s.most_rows)
    spread = [next(r for r in kept if r[0] == k) for k in order]
    out, used = [], 0
    for r in spread:
        n = max(1, math.ceil(len(r[4].encode()) / 4))
        if len(out) < s.most_rows and used + n <= s.most_tokens:
            out.append(r)
            used += n
    return out, (len(rows), len(kept), len(spread), len(out), used)


def test_adaptive_search(spark):
    """The rounds, by a plain loop that takes sufficiency and follow-ups from their own operators."""
    s = A.AdaptiveSettings(first=8, second=3, diverse=5, most_rows=3, most_tokens=12)
    rng = random.Random(7)
    corpus = [(i, rng.choice("abcd"), rng.choice(["row", "block"]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 10)))) for i in range(60)]
    questions = [(0, "lãi năm 2021 how many"), (1, "alpha beta"), (2, "zzz vốn"), (3, "compare nợ 2019 2020"), (4, "nothing"), (5, "vốn in 2021 exact figures"), (6, "lãi how many"), (7, "figures  report")]

    def plain_search(text, k):
        want = set(text.split())
        rows = [(i, page, kind, round(len(want & set(t.split())) / len(want), 6), t) for i, page, kind, t in corpus]
        return sorted((r for r in rows if r[3] > 0), key=lambda r: (-r[3], r[0]))[:k]

    fields = "key int, page string, kind string, score double, text string"

    def search(queries, k):
        rows = [(q.query, *r) for q in queries.collect() for r in plain_search(q.text, k)]
        return spark.createDataFrame(rows, f"query int, {fields}")

    def judge(question, evidence):
        if not evidence:
            return False, 0.0, ["no_evidence"]
        df = spark.createDataFrame([(1, question, i, r[3], r[4]) for i, r in enumerate(evidence)], "query int, asked string, rank int, score double, text string")
        r = COV.sufficiency(df, "query", "asked", "text", "score", ["vốn", "lãi", "nợ"]).first()
        return r.sufficient, r.confidence, r.missing

    want, want_evidence = {}, {}
    for q, text in questions:
        first = plain_search(text, s.first)
        evidence, counts = plain_evidence(text, first, s) if first else ([], (0,) * 5)
        ok, confidence, missing = judge(text, evidence)
        rounds, reason, follow = 1, "sufficient_after_round_1", None
        if not ok:
            named = " ".join([t for t in ("vốn", "lãi", "nợ") if t in text][:2]) or "figures"
            years = [w for w in text.split() if w.isdigit() and len(w) == 4]
            df = spark.createDataFrame([(missing, named, years)], "m array<string>, n string, y array<string>")
            follow = df.select(COV.follow_up(F.col("m"), F.col("n"), F.col("y"))).first()[0]
            if follow.lower().strip() == text.lower().strip():
                reason, follow = "no_distinct_followup_query", None
            else:
                both = {}
                for r in [*first, *plain_search(follow, s.second)]:
                    if r[0] not in both or r[3] > both[r[0]][3]:
                        both[r[0]] = r
                evidence, counts = plain_evidence(text, list(both.values()), s) if both else ([], (0,) * 5)
                ok, confidence, missing = judge(text, evidence)
                rounds, reason = 2, "sufficient_after_round_2" if ok else "max_rounds_reached_insufficient"
        want[q] = (rounds, reason, ok, confidence, missing, *counts, follow)
        want_evidence[q] = [r[0] for r in evidence]
    state, evidence = A.adaptive_search(spark.createDataFrame(questions, "query int, text string"), search, ["vốn", "lãi", "nợ"], "figures", s)
    got = {r.query: (r.rounds, r.stop_reason, r.sufficient, r.confidence, r.missing, r.candidates, r.after_dedup, r.after_diversity, r.evidence, r.tokens, r.again) for r in state.collect()}
    assert got == want and len({x[1] for x in want.values()}) >= 3
    found = {q: [] for q, _ in questions}
    for r in evidence.orderBy("query", "position").collect():
        found[r.query].append(r.key)
    assert found == want_evidence


CONFIG = FI.FinanceConfig(
    intents=(
        FI.Intent("variance", "calculation", ("so với kế hoạch",), ("plan", "actual"), "difference", (("actual", r"thực hiện\s+([0-9.,]+)"), ("plan", r"kế hoạch\s+([0-9.,]+)"))),
        FI.Intent("points", "calculation", ("điểm phần trăm",), ("personal", "corporate"), "point_difference", (("personal", r"cá nhân tăng ([0-9,]+)%"), ("corporate", r"doanh nghiệp tăng ([0-9,]+)%"))),
        FI.Intent("green", "calculation", ("tín dụng xanh năm trước",), (), "reverse_growth", (("now", r"xanh đạt ([0-9,]+)"), ("growth", r"tăng ([0-9,]+)%"))),
        FI.Intent("double", "calculation", ("nhân đôi",), ("base",), "multiply", (("base", r"([0-9,]+) triệu khách hàng"), ("times", r"gấp ([0-9]+) lần"))),
        FI.Intent("summary", "multi_hop", ("tổng hợp",), ("plan", "personal"), "synthesis", (("plan", r"kế hoạch\s+([0-9.,]+)"), ("personal", r"cá nhân tăng ([0-9,]+)%"))),
    ),
    facts={
        "plan": {"groups": [["kế hoạch"]], "value": r"kế hoạch\s+[0-9]", "query": "find plan"}, "actual": {"groups": [["thực hiện", "đạt"]], "query": "find actual"},
        "personal": {"groups": [["cá nhân"]], "query": "find loans"}, "corporate": {"groups": [["doanh nghiệp"]], "query": "find loans"}, "base": {"groups": [["khách hàng"], ["triệu"]], "query": ""},
    },
    entities=(("broker", "chứng khoán abc"),), default_entity="group", first=2, follow=2, simple=2, complex=3,
)

TEXTS = {
    1: ("Lợi nhuận thực hiện 32.538", "group"), 2: ("Lợi nhuận KẾ HOẠCH 31.500 tỷ", None), 3: ("Cho vay cá nhân tăng 30,8%, năm qua", ""), 4: ("Cho vay doanh nghiệp tăng 13,4%", "group"),
    5: ("Tín dụng xanh đạt 18,9 tăng 16%", "group"), 6: ("15,3 triệu khách hàng", "group"), 7: ("mục tiêu gấp 2 lần", "group"), 8: ("Chứng khoán ABC thực hiện 9", "group"), 9: ("kế hoạch chưa có", "Chứng khoán ABC"),
}
FOUND = {
    "so với kế hoạch": [8, 1], "find plan": [2, 9], "find actual": [1], "điểm phần trăm": [9], "find loans": [3, 4], "tín dụng xanh năm trước": [5], "nhân đôi": [6, 7], "tổng hợp": [1], "gì đó": [9, 2, 1], "": [],
}


@pytest.fixture(scope="module")
def financial(spark):
    def search(queries, k):
        rows = [(q.query, n, i, 10 + i, 1.0 - n / 10, *TEXTS[i], "heading") for q in queries.collect() for n, i in enumerate(FOUND[q.text][:k], 1)]
        return spark.createDataFrame(rows, "query string, rank int, key int, page int, score double, text string, entity string, heading string")

    questions = spark.createDataFrame([(t or "none", t) for t in FOUND if not t.startswith("find")], "query string, text string")
    state = FI.controlled_search(questions, search, CONFIG)
    return state, FI.evidence_of(state, CONFIG)


def test_plans_and_rounds(financial):
    state, evidence = financial
    plan = {r.query: (r.intent, r.kind, r.facts, r.scope) for r in state.plan.collect()}
    assert plan["so với kế hoạch"] == ("variance", "calculation", ["plan", "actual"], "group") and plan["gì đó"] == ("generic", "lookup", [], "group")
    trace = {r.query: (r.rounds, r.follow_ups, r.initial_candidates, r.final_candidates) for r in state.trace.collect()}
    assert trace == {
        "so với kế hoạch": (2, ["find plan"], 2, 4), "điểm phần trăm": (2, ["find loans"], 1, 3), "tín dụng xanh năm trước": (1, [], 1, 1), "nhân đôi": (1, [], 2, 2),
        "tổng hợp": (2, ["find plan", "find loans"], 1, 5), "gì đó": (1, [], 2, 2), "none": (1, [], 0, 0),
    }
    covered = {(r.query, r.fact): r.pages for r in state.coverage.collect()}
    # the plan without a figure is none; the broker's text comes after the group's
    assert covered[("so với kế hoạch", "plan")] == [12] and covered[("so với kế hoạch", "actual")] == [11, 18] and covered[("tổng hợp", "plan")] == [12]
    order = {}
    for r in state.candidates.orderBy("query", "place").collect():
        order.setdefault(r.query, []).append(r.key)
    assert order["so với kế hoạch"] == [2, 1, 8, 9] and order["gì đó"] == [9, 2]
    chosen = {}
    for r in evidence.orderBy("query", "position").collect():
        chosen.setdefault(r.query, []).append(r.key)
    assert chosen["so với kế hoạch"] == [2, 1, 8] and chosen["tổng hợp"][:2] == [2, 3]


def test_derived_facts(financial):
    state, evidence = financial
    got = {r.query: (r.expression, r.result and round(float(r.result), 1), r.text, [(o.role, o.value, o.page) for o in r.operands], r.pages) for r in FI.derived_facts(state, evidence, CONFIG).collect()}
    assert got == {
        "so với kế hoạch": ("32.538 − 31.500", 1038.0, None, [("actual", "32.538", 11), ("plan", "31.500", 12)], [11, 12]),
        "điểm phần trăm": ("30,8 − 13,4", 17.4, None, [("personal", "30,8", 13), ("corporate", "13,4", 14)], [13, 14]),
        "tín dụng xanh năm trước": ("18,9 / (1 + 16 / 100)", 16.3, None, [("now", "18,9", 15), ("growth", "16", 15)], [15]),
        "nhân đôi": ("15,3 × 2", 30.6, None, [("base", "15,3", 16), ("times", "2", 17)], [16, 17]),
        "tổng hợp": ("plan + personal", None, "plan 31.500, personal 30,8", [("plan", "31.500", 12), ("personal", "30,8", 13)], [12, 13]),
    }


def test_bad_configurations():
    for intent in (FI.Intent("a", "lookup", ("x",), ("none",)), FI.Intent("a", "lookup", ("x",), (), "divide"), FI.Intent("a", "lookup", ("x",), (), "multiply")):
        with pytest.raises(ValueError):
            FI.FinanceConfig(intents=(intent,), facts={})
