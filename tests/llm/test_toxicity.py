import random
import zlib

import numpy as np
from docloom.llm.toxicity import BITS, Toxicity, distinct_ids, fit_toxicity, op8_toxicity, score_toxicity, word_ids

SF = "/root/testdata/sf0.1"


def fit(texts, y, **more):
    return fit_toxicity(*distinct_ids(texts), np.array(y, float), **more)


def biased(n=1500):
    """Toxic texts, most of which also name one group."""
    rng = random.Random(4)
    filler = ["w%d" % k for k in range(200)]
    texts, y = [], []
    for _ in range(n):
        bad = rng.random() < 0.3
        w = rng.sample(filler, 12)
        if bad:
            w.append(rng.choice(["vile", "rotten", "filth"]))
        if rng.random() < (0.7 if bad else 0.05):
            w.append("muslim")
        elif rng.random() < 0.1:
            w.append("christian")
        rng.shuffle(w)
        texts.append(" ".join(w))
        y.append(bad)
    return texts, y


def test_swaps_change_less():
    texts, y = biased()
    plain, fair = fit(texts, y, counterfactual=0.0, rounds=800), fit(texts, y, counterfactual=5.0, rounds=800)
    neutral = ["w1 w2 w3 muslim w4 w5", "w1 w2 w3 christian w4 w5"]

    def change(m):
        p = np.clip(m.score(neutral), 1e-9, 1 - 1e-9)
        return abs(np.diff(np.log(p / (1 - p)))[0])

    assert change(plain) > 1.0 and change(fair) < 0.25 * change(plain)
    assert fair.score(neutral).max() < 0.5
    assert np.mean((fair.score(texts) >= 0.5) == np.array(y)) > 0.97


def test_edge_cases(spark):
    assert fit([], []).score(["a"]).tolist() == [0.5]
    assert fit(["a b", "c"], [0, 0]).score(["a"])[0] < 0.5 < fit(["a b"], [1]).score([""])[0]
    word = int(word_ids(["bad"])[0][0])
    model = Toxicity(np.array([word]), np.array([5.0]), -2.0, BITS)
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (3, "BAD bad", 3), (3, "BAD bad", 3), (None, "good " * 50_000 + "bad", 3)], "doc_id long, text string, toxicity int")
    got = score_toxicity(df, model).collect()
    assert [r.toxicity > 0.5 for r in got] == [False, False, True, True, True] and got[0].toxicity == got[1].toxicity
    assert score_toxicity(df.where("false"), model).count() == 0


def test_query_accuracy_on_held_out(spark):
    got = {r.doc_id: r for r in op8_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out and 0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.5) for i in held)
    toxic = [i for i in held if labels[i]]
    assert np.mean([got[i].predicted for i in toxic]) > 0.85
    assert np.mean([got[i].predicted for i in held if not labels[i]]) < 0.01
