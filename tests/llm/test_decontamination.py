import hashlib
import random
import re

import duckdb
from docloom.llm import decontamination as D

SF = "/root/testdata/sf0.001"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            t = words(item)
            size = min(window, len(t))
            for i in range(len(t) - size + 1 if size else 0):
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == t[i : i + size]:
                        hit |= set(range(j, j + size))
                        found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, window=10):
    d = spark.createDataFrame([(*x, 5, "x") for x in docs], "doc_id long, text string, segment int, `first` string")
    b = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, words string")
    return sorted((tuple(r) for r in D.contamination(d, b, window).collect()), key=str)


def fixture():
    rng = random.Random(3)
    vocabulary = ["the", "of"] * 6 + [f"w{i}" for i in range(12)] + ["Über", "naïve", "漢字"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 6, 9]))) for i in range(25)] + [(25, None), (None, "w1 w2 w3 w4"), (7, "of the of"), (3, "the the the the the")]
    docs = [(i, text(rng.randint(0, 80))) for i in range(60)] + [(5, "W1, w2! w3-w4"), (None, "of the of"), (70, None), (71, ""), (72, "the " * 3000), (73, "x" * 50_000 + " w1 w2"), (74, "...")]
    docs += [(100 + i, docs[3][1] + " " + items[6][1]) for i in range(8)]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = fixture()
    for window in (10, 3):
        assert run(spark, docs, items, window) == brute(docs, items, window)
    # many segments, and lookups in portions, give the same
    monkeypatch.setattr(D, "SEGMENT_WORDS", 50)
    monkeypatch.setattr(D, "TERM_BYTES", 0)
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_portions(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    rows = pa.table({"term": ["a", "b", None], "n": [6, 3, 9], "places": [np.array([0, 1, 1, 3, 1, 1], "<u4").tobytes(), np.array([3, 1, 4], "<u4").tobytes(), None], "doc_id": [None, None, 1], "first": [None, None, 0]})
    segment = D._Segment(rows)  # a a a b b a a a b, places 0 1 2 3 4 5 6 7 8
    windows = np.array([[0, 1], [0, 0], [1, 1], [0, 0]])
    for portion in (1, 2, 1000):
        monkeypatch.setattr(D, "PORTION", portion)
        row, at = D._occurrences(segment, windows)
        assert sorted(zip(row.tolist(), at.tolist())) == [(0, 2), (0, 7), (1, 0), (1, 1), (1, 5), (1, 6), (2, 3), (3, 0), (3, 1), (3, 5), (3, 6)]


def test_empty_tables(spark):
    docs = [(1, "a b")]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, docs, [(1, None)]) == brute(docs, [(1, None)])


def near(docs, phrase, slack):
    """Shortest spans of each document that hold all words of the phrase."""
    out = []
    need = {w: phrase.count(w) for w in phrase}
    for doc, w in docs.items():
        spans = {}
        for i in range(len(w)):
            for j in range(i, min(len(w), i + len(phrase) + slack)):
                if all(w[i : j + 1].count(x) >= n for x, n in need.items()):
                    spans[j] = i  # the latest start for an end
                    break
        # of starts with one end the latest; a start that is no word of the phrase is never the latest
        out += [(doc, i, j - i + 1) for j, i in spans.items()]
    return sorted(out)


def test_phrases_and_proximity(spark):
    rng = random.Random(9)
    docs = {i: [rng.choice("a b c d e f".split()) for _ in range(rng.randint(0, 40))] for i in range(30)}
    index = D.build_index(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"))
    phrases = {"p": ["a", "b"], "q": ["c", "c", "d"], "r": ["a"], "s": ["a", "zzz"], "t": []}
    items = spark.createDataFrame(list(phrases.items()), "item string, words array<string>")
    got = sorted((r.item, r.doc_id, r.start, r.length) for r in D.phrase_matches(index, items).collect())
    plain = []
    for key, phrase in phrases.items():
        for doc, w in docs.items():
            at = [i for i in range(len(w) - len(phrase) + 1) if phrase and w[i : i + len(phrase)] == phrase]
            for i in at:  # of one word, each occurrence is a passage of its own length
                plain.append((key, doc, i, len(phrase)))
    assert got == sorted(plain)
    for slack in (0, 2):
        got = sorted((r.item, r.doc_id, r.start, r.length) for r in D.proximity_matches(index, items, slack).collect())
        assert got == sorted((key, *x) for key, phrase in phrases.items() if phrase for x in near(docs, phrase, slack))


def test_query_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = sorted(c.execute(D.ORACLES["op11_decontamination"]).fetchall())
    assert sorted(tuple(r) for r in D.op11_decontamination(spark, SF).collect()) == want and any(r[-1] for r in want)
