"""Dense search against plain products, in one block and in many."""

import numpy as np
import pytest

from docloom.operators import dense as D


def plain(vectors, queries, k, exclude):
    out = []
    for q, a in queries:
        found = sorted((-round(float(np.dot(a, b)), 6) + 0.0, i) for i, b in vectors if a is not None and b is not None and len(a) == len(b) and len(a) and not (exclude and i == q))
        out += [(q, n, i, -s + 0.0) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def data():
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(90)]  # small integers: many ties
    return vectors + [(90, None), (91, []), (92, [1.0, 2.0]), (93, [0.5, -1.0]), (94, [1e9] * 4), (95, vectors[3][1]), (96, vectors[3][1])]


@pytest.mark.parametrize("most_bytes", [1 << 26, 600])
@pytest.mark.parametrize("portion", [4_000_000, 7])
def test_equals_plain_products(spark, monkeypatch, most_bytes, portion):
    monkeypatch.setattr(D, "PORTION", portion)
    vectors = data()
    queries = [v for v in vectors if v[0] % 5 == 0 or v[0] > 88]
    v, q = (spark.createDataFrame(x, "vec_id long, embedding array<double>") for x in (vectors, queries))
    for k, exclude in ((3, True), (200, False)):
        got = sorted((r.query, r["rank"], r.vec_id, r.score) for r in D.dense_top_k(v, q, k, exclude_self=exclude, most_bytes=most_bytes).collect())
        assert got == plain(vectors, queries, k, exclude)


def test_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert D.dense_top_k(empty, one, 3).count() == D.dense_top_k(one, empty, 3).count() == D.dense_top_k(one, one, 3).count() == 0
