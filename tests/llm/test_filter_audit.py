import re
from itertools import permutations

import duckdb
from docloom.llm import filter_audit as A

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    parts, good, toxic = {}, {}, {}
    for i, q, t in labels:
        if i is not None:
            good[i], toxic[i] = good.get(i, False) or q == 1, toxic.get(i, False) or t == 1
    for doc_id, text, lang in docs:
        text = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        same = [i for i, t, _ in docs if (t or "") == text and i is not None]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and doc_id > min(same)}
        parts.setdefault(lang or "", []).append(({f for f, x in fails.items() if x}, good.get(doc_id, False), toxic.get(doc_id, False)))
    out = []
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                steps.append((part, "".join(order), step, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def run(spark, docs, labels):
    d = spark.createDataFrame([(*x, 1, "m") for x in docs], "doc_id long, text string, lang string, mask int, digest string")
    l = spark.createDataFrame([(*x, "p") for x in labels], "doc_id long, quality int, toxic int, part string")
    return sorted(tuple(r) for r in A.filter_audit(d, l).collect())


LONG = " ".join(f"w{i}" for i in range(120))


def test_equals_brute_force(spark):
    docs = [(1, LONG, "en"), (2, LONG, "en"), (3, LONG, "fr"), (3, LONG, "fr"), (0, LONG, None), (None, LONG, "en"), (None, LONG, ""), (4, None, "en"), (5, "", "en"), (6, None, "fr"), (7, "a a a a b", "en"), (8, "A" * 11 + "b" * 89, "en"), (9, "A" * 10 + "b" * 90, "en")]
    docs += [(10, LONG + " #", "en"), (11, "x " * 100_000, "de"), (12, " \t\x0b\x0cword\r\n", "de"), (13, "ÀÉ € $", "de"), (14, LONG.upper(), "en"), (15, "　" + LONG, "fr"), (2, LONG + " &", "en")] + [(20 + i, "copy | of Text", "en" if i % 3 else "de") for i in range(40)]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (25, 1, None), (None, 1, 1), (99, 1, 1), (8, 0, 1), (4, 1, 0)]
    assert run(spark, docs, labels) == brute(docs, labels)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], labels) == []


def test_parity_sums_invert_to_cells(spark):
    masks = spark.createDataFrame([("en", m % 2 == 0, m % 3 == 0, m, (m * m) % 7) for m in range(32)] + [("fr", True, True, 31, 5)], "part string, good boolean, toxic boolean, mask int, n long")
    sums = A.parity_sums(masks)
    assert all(len(r.sums) == 32 for r in sums.collect())
    got = {r.part: r for r in A.mask_cells(sums).collect()}
    assert got["en"].cells == [(m * m) % 7 for m in range(32)] and got["fr"].cells == [0] * 31 + [5]
    assert got["en"].good_cells == [(m * m) % 7 if m % 2 == 0 else 0 for m in range(32)]
    assert got["en"].toxic_cells == [(m * m) % 7 if m % 3 == 0 else 0 for m in range(32)]


def test_query_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    want = sorted(c.execute(f"SELECT {', '.join(columns)} FROM ({A.ORACLES['op13_filter_audit']})").fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in A.op13_filter_audit(spark, SF).collect()) == want
