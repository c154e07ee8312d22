import sys
from pathlib import Path

import corpus_pipeline as cp
from docloom.llm.common import table
from docloom.llm.quality import project, train_quality
from docloom.llm.toxicity import train_toxicity

sys.path.insert(0, str(Path(__file__).parent))
from test_order_minhash import groups, words  # noqa: E402
from test_packing import check  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_python(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = train_quality(docs, table(spark, SF, "labels"))
    good = {i for i, t in rows.items() if model.tail(project([t], model.weights), 1)[0] >= 0.5}
    first = cp.keep_quality(spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == good and good
    toxicity = train_toxicity(docs, table(spark, SF, "labels"))
    mild = {i for i in good if toxicity.score([rows[i]])[0] < 0.5}
    second = cp.drop_toxic(spark, first, SF)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == mild
    short = [i for i in mild if len(words(rows[i])) < 200]
    third = cp.drop_near_copies(spark, second.where(second.doc_id.isin(short)), SF)
    by = groups({i: rows[i] for i in short})
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == {i for i in short if by[i] == i}
    _, pieces = check(cp.pack(spark, third, SF).collect(), 4096)
    assert set(pieces) == {r.doc_id for r in third.collect()}


def test_odd_rows(spark):
    rows = [(None, "plain words of some text here", "en", "s", 5), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words of some text here", "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert cp.keep_quality(spark, df, SF).count() <= 5 and cp.drop_toxic(spark, df, SF).count() == 5
    kept = cp.drop_near_copies(spark, df, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3"]
    assert sum(r.doc_tokens for r in cp.pack(spark, df, SF).where("start = 0").collect()) > 5
    for _, stage in cp.STAGES:
        assert stage(spark, df.where("false"), SF).count() == 0


def test_run(spark):
    check(cp.run(spark, SF).collect(), 4096)
