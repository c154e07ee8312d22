import itertools
import random
import zlib

import numpy as np
from docloom.llm.language_id import SCRIPTS, find_words, identify, op2_language_id, train, viterbi
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    counts = np.array([5, 0, 1, 7, 3])
    scores = rng.standard_normal((counts.sum(), 3)).astype(np.float32)
    got, at = viterbi(scores, counts, 0.8), 0
    for n in counts:
        own = scores[at : at + n]

        def value(path):
            return sum(own[i, p] for i, p in enumerate(path)) - 0.8 * sum(a != b for a, b in zip(path, path[1:]))

        if n:
            assert abs(value(got[at : at + n]) - max(map(value, itertools.product(range(3), repeat=int(n))))) < 1e-5
        at += n


def test_scripts():
    text = "word слово λόγος 字 かな 한글 كلمة मंत्र 123 Éé x"
    words, _ = find_words([text])
    body = ("\n" + text).encode()
    got = [(body[b:e].decode(), SCRIPTS[s]) for b, e, s in zip(words.begin, words.end, words.script)]
    assert [s for _, s in got] == ["latin", "cyrillic", "greek", "han", "kana", "hangul", "arabic", "devanagari", "none", "latin", "latin"]


ENGLISH = "the house with this thing and that which would there where they have been with other things through"
GERMAN = "das haus mit der sache und auch nicht ein schön für über die straße zwischen größe ich wäre"
RUSSIAN = "это дом и вещь который был там где они были с другими вещами через"


def prose(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words.split()) for _ in range(n))


def model(spark):
    rows = [(i, prose(w, 30, i), lang) for k, (lang, w) in enumerate((("en", ENGLISH), ("de", GERMAN), ("ru", RUSSIAN))) for i in range(k * 50, k * 50 + 50)]
    return train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))


def test_spans_of_mixed_text(spark):
    m = model(spark)
    a, b, c = prose(ENGLISH, 40, 901), prose(GERMAN, 25, 902), prose(RUSSIAN, 10, 903)
    text = f"Ünï {a}. {b}! {c}"
    df = spark.createDataFrame([(1, text, None), (2, None, "q"), (3, "", "q"), (4, "12 !? 3", "q"), (5, "字 字", "q"), (6, a, "q"), (6, a, "q"), (7, (b + " ") * 3000, "q")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in identify(df, m).collect()}
    spans = [(s.lang, text[s.start : s.stop]) for s in got[1].spans]
    assert [s for s, _ in spans][-3:] == ["en", "de", "ru"] and spans[-1][1] == c
    assert got[1].lang_pred == "en" and 0.3 < got[1].score < 0.8
    for k in (2, 3, 4):
        assert (got[k].lang_pred, got[k].score, got[k].spans) == ("und", 0.0, [])
    assert got[5].lang_pred in m.languages
    assert (got[6].lang_pred, got[6].score) == ("en", 1.0) and got[7].lang_pred == "de"
    assert identify(df.where("false"), m).count() == 0


def test_no_training_documents(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    r = identify(df, train(df, F.lit(True))).first()
    assert (r.lang_pred, r.score) == ("und", 0.0)


def test_query_accuracy_on_held_out(spark):
    got = {r.doc_id: r for r in op2_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out for d in held)
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
