"""Near copies in tables whose ids repeat or are null."""

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
ONE, TWO, THREE = (" ".join(f"{w}{i}" for i in range(30)) for w in ("one", "two", "three"))


def test_repeated_and_null_ids(spark):
    rows = [(7, ONE), (7, TWO), (7, TWO), (9, TWO + " end"), (None, THREE), (None, THREE), (None, THREE + " end"), (None, ONE), (None, None), (None, None), (8, None), (8, None), (5, ONE + " end")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in cp.drop_near_copies(spark, df, SF).collect()]
    with_id = sorted((x for x in got if x[0] is not None), key=str)
    assert with_id == sorted([(5, ONE + " end"), (7, TWO), (8, None)], key=str)
    without = [t for i, t in got if i is None]
    # of ONE a copy with an id stays; rows without id and text are no copies
    assert len(without) == 3 and without.count(None) == 2 and sum(t in (THREE, THREE + " end") for t in without) == 1


def test_both_texts_of_an_id_stay(spark):
    df = spark.createDataFrame([(1, ONE, "en", "s", 1), (1, TWO, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in cp.drop_near_copies(spark, df, SF).collect()) == [ONE, TWO]
