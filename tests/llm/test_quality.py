import zlib

import numpy as np
from docloom.llm.quality import MARKS, TRIGRAMS, CumulativeLink, features, fit_cumulative_link, grade_documents, op5_quality, project

SF = "/root/testdata/sf0.01"


def test_projection_equals_features():
    texts = ["", "a", "Ünï code\nlines\nlines", "word " * 300, "!!!", "x" * 70]
    w = np.random.default_rng(0).standard_normal(TRIGRAMS + MARKS)
    assert np.allclose(project(texts, w), features(texts).astype(float) @ w, rtol=1e-5, atol=1e-4)
    assert len(project([], w)) == 0


def test_recovers_ordered_grades():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 5))
    w, cuts = np.array([1.5, -1.0, 0.5, 0.0, 0.0]), np.array([-1.5, 0.0, 2.0])
    noise = np.log(1 / rng.random(4000) - 1)
    y = np.array([2, 3, 5, 9])[(x @ w + noise)[:, None].__gt__(cuts).sum(1)]
    m = fit_cumulative_link(x, y, rounds=800)
    assert m.grades == [2, 3, 5, 9]
    assert np.abs(m.weights - w).max() < 0.2 and np.abs(m.thresholds - cuts).max() < 0.25
    line = x @ m.weights
    p = -np.diff(np.concatenate([np.ones((4000, 1)), m.above(line), np.zeros((4000, 1))], 1), axis=1)
    assert (p >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.allclose(m.expected(line), p @ np.array([2, 3, 5, 9]))
    assert np.allclose(m.tail(line, 5), p[:, 2:].sum(1)) and np.allclose(m.tail(line, 2), 1) and np.allclose(m.tail(line, 10), 0)
    assert (m.likeliest(line) == np.array([2, 3, 5, 9])[p.argmax(1)]).all()


def test_one_grade_and_no_rows():
    m = fit_cumulative_link(np.ones((3, 2)), np.array([1, 1, 1]))
    assert m.expected(np.zeros(2)).tolist() == [1, 1] and m.tail(np.zeros(2), 1).tolist() == [1, 1]
    assert fit_cumulative_link(np.ones((0, 2)), np.zeros(0, int)).tail(np.zeros(1), 1).tolist() == [0]


def test_edges(spark):
    model = CumulativeLink(np.ones(TRIGRAMS + MARKS), np.array([0.5]), [0, 1])
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "x" * 200_000, "k"), (None, "dup", "k"), (None, "dup", "k")], "doc_id long, text string, selected string")
    got = grade_documents(df, model, 1).collect()
    assert len(got) == 5 and got[0].expected_grade == got[1].expected_grade
    assert all(0 <= r.tail_probability <= 1 and r.selected == (r.tail_probability >= 0.5) for r in got)
    assert grade_documents(df.where("false"), model, 1).count() == 0


def test_query_accuracy_on_held_out(spark):
    got = {r.doc_id: r for r in op5_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held)
    right = np.mean([got[i].predicted_grade == labels[i] for i in held])
    assert right > 0.93
    clean = [i for i in held if labels[i] == 1]
    assert np.mean([got[i].selected for i in clean]) > 0.97
