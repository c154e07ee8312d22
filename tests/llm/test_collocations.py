import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from docloom.llm import collocations as C
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def brute(docs, least, top):
    f, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    f[lang or "und"][tuple(w[i : i + n])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            subs = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and subs(q) and 100 * b >= 80 * a for q, b in candidates.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def run(spark, docs, least, top):
    df = spark.createDataFrame([(t, l, 1, "x") for t, l in docs], "text string, lang string, shard int, word string")
    return sorted(tuple(r) for r in C.collocations(df, least, top).collect())


def fixture():
    rng = random.Random(2)
    words = ["the", "of", "New", "york", "city", "été", "漢", "a\x00b", "x"] + [f"r{i}" for i in range(40)]
    phrases = ["new York City", "the city of new york", "of the", "ein haus", "été été"]
    text = lambda: "".join(rng.choice([rng.choice(words), rng.choice(phrases)]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!"]) for _ in range(rng.randint(0, 60)))
    docs = [(text(), rng.choice(["en", "en", "en", "fr", None, "und"])) for _ in range(150)]
    return docs + [(None, "en"), ("", "fr"), (None, None), ("word", "xx"), ("a b " * 4000, "de")] + [docs[0]] * 20


def test_equals_brute_force(spark, monkeypatch):
    docs = fixture()
    for least, top in ((5, 50), (2, 7)):
        assert run(spark, docs, least, top) == brute(docs, least, top)
    monkeypatch.setattr(C, "SHARD_WORDS", 100)  # many shards
    monkeypatch.setattr(C, "MOST_BITS", 10)  # a bitmap too small to tell pairs apart
    assert run(spark, docs, 3, 1000) == brute(docs, 3, 1000)
    assert run(spark, [], 1, 5) == [] and run(spark, [("a b", "en")], 30, 5) == []


def test_suffix_ranks_and_counts():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 5, 400).astype(np.int32)
    for depth in (1, 2, 4):
        rank = C.suffix_ranks(ids, depth)
        keys = [tuple(ids[i : i + depth]) + (0,) * (depth - len(ids[i : i + depth])) for i in range(len(ids))]
        order = {k: i for i, k in enumerate(sorted(set(keys)))}
        if depth > 1:
            assert rank.tolist() == [order[k] for k in keys]
    for least, most in ((1, 1), (2, 2), (3, 4), (1, 4)):
        for n, (words, counts) in enumerate(C.count_phrases(ids, least, most), least):
            want = Counter(tuple(ids[i : i + n].tolist()) for i in range(len(ids) - n + 1) if (ids[i : i + n] > 0).all())
            assert {tuple(w): c for w, c in zip(words.tolist(), counts.tolist())} == want
    assert [len(c) for _, c in C.count_phrases(np.zeros(3, np.int32), 2, 4)] == [0, 0, 0]
    assert (C.unpack_ints(C.pack_ints(ids - 1)) == ids - 1).all()


def test_the_bitmap_stops_no_frequent_pair(spark):
    keys = np.random.default_rng(4).integers(1, 2**62, 3000)
    bitmap = C.pair_bitmap(spark.createDataFrame([(int(k),) for k in keys], "k1 long"), 16)
    slots = C._slots(keys, 16)
    assert ((bitmap[(slots >> np.uint64(6)).astype(int)] >> (slots & np.uint64(63))) & np.uint64(1)).all()


def test_large_counts(spark):
    # products beyond 64 bits
    a = 10**13
    row = spark.range(1).select(F.expr(f"cast(({C.SCALE} * cast({a}L as decimal(38,0))) div (cast({a}L as decimal(38,0)) + {a + 1}L) as long)").alias("x")).first()
    assert row.x == C.SCALE * a // (2 * a + 1)


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(c.execute(C.ORACLES["op12_collocations"]).fetchall())
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in C.op12_collocations(spark, SF).collect()) == want and len(want) > 100
