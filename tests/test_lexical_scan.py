"""Search by passes over the documents against the stored index, and what it leaves on disk."""

import math
import pickle
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical as L
from docloom.operators import lexical_scan as S
from docloom.plans import answers as PA
from docloom.plans import control as PC
from docloom.plans import retrieval as P
from docloom.plans import texts as PT
from docloom.storage import new_path

SF = "/root/testdata/sf0.001"


def corpus(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % (11 + j % 5)}" for j in range(3 + i % 9)), ["en", "fr", None][i % 3]) for i in range(90)]
    rows += [(i, "w1 w2 copies of w3", "en") for i in range(90, 140)] + [(140, None, "en"), (141, "", "fr"), (142, "3,5 kg Straße", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


QUESTIONS = [(90, "w1 w2 w3"), (3, "w5 w1 w1 w2 strasse"), (4, "w0 w1 w2 w3 w4 w5 w6 copies of"), (5, ""), (6, None), (7, "nowhere")]


def found(df, *by):
    return sorted(tuple(r[c] for c in (*by, "rank", "doc_id")) + (round(r["score"], 5),) for r in df.collect())


@pytest.mark.parametrize("most_bytes", [1 << 20, 20])
def test_equals_the_index(spark, most_bytes):
    docs, asked = corpus(spark), spark.createDataFrame(QUESTIONS, "q long, text string")
    index, held = L.build_index(docs, group="lang"), S.Corpus(docs, group="lang")
    for k in (3, 60):
        for alone in (False, True):
            assert found(S.search_corpus(held, asked, "q", k, exclude_self=alone, most_bytes=most_bytes), "q") == found(L.search_index(index, asked, "q", k, exclude_self=alone), "q")
    to = asked.withColumn("to", F.explode(F.array(F.lit("en"), F.lit("fr"), F.lit("xx"), F.lit(None))))
    assert found(S.search_corpus(held, to, "q", 4, route="to", most_bytes=most_bytes), "q", "group") == found(L.search_index(index, to, "q", 4, route="to"), "q", "group")


def test_small_portions_change_nothing(spark, monkeypatch):
    docs, asked = corpus(spark).coalesce(1), spark.createDataFrame(QUESTIONS, "q long, text string")
    want = found(S.search_corpus(S.Corpus(docs), asked, "q", 5), "q")
    monkeypatch.setattr(S, "TOKENS", 7)
    monkeypatch.setattr(S, "CELLS", 9)
    assert found(S.search_corpus(S.Corpus(docs), asked, "q", 5), "q") == want


def test_hits_of_a_block_go_once_its_rows_are_stored(spark, monkeypatch):
    """What a pass leaves is as large as the documents, so blocks of questions must not add it up on disk."""
    made, at_once = [], []
    monkeypatch.setattr(S, "new_path", lambda s, name: (at_once.append(sum(Path(p.removeprefix("file:")).exists() for p in made)), made.append(new_path(s, name)))[-1] or made[-1])
    asked = spark.createDataFrame(QUESTIONS, "q long, text string")
    out = S.search_corpus(S.Corpus(corpus(spark)), asked, "q", 5, most_bytes=20)
    assert len(made) > 2 and set(at_once) == {0} and not any(Path(p.removeprefix("file:")).exists() for p in made)
    assert out.count()


def test_ids_of_any_type_and_nothing_asked(spark):
    docs = corpus(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    asked = spark.createDataFrame([("d90", "w1 w2 w3")], "q string, text string")
    assert found(S.search_corpus(S.Corpus(docs), asked, "q", 60, exclude_self=True), "q") == found(L.search_index(L.build_index(docs), asked, "q", 60, exclude_self=True), "q")
    held = S.Corpus(corpus(spark))
    assert {r.q for r in S.search_corpus(held, spark.createDataFrame([("100/1", "w1 w2")], "q string, text string"), "q", 4).collect()} == {"100/1"}
    assert S.search_corpus(S.Corpus(docs), asked.where("false"), "q", 4).count() == 0
    assert S.search_corpus(S.Corpus(docs.where("false")), asked, "q", 4).count() == 0


def test_statistics_equal_those_of_the_index(spark):
    docs = corpus(spark)
    for pairs in (False, True):
        got, want = S.corpus_statistics(S.Corpus(docs), pairs), L.term_statistics(L.build_index(docs), pairs)
        assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("query", [P.bm25_topk, P.hyde_fusion, P.metric_aware_rerank, P.rrf_hybrid, PT.term_statistics])
def test_a_batch_of_questions_stores_less_than_it_reads(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr("docloom.storage.shared_dir", lambda _: f"file://{tmp_path}")
    assert query(spark, SF).count()
    stored = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    assert stored < 1.5 * Path(f"{SF}/documents.parquet").stat().st_size


def test_documents_are_not_read_again_for_each_use_of_a_pool(spark):
    plan = PC.canonical_citation(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "/texts-" in plan and "documents.parquet" not in plan


def test_a_pool_that_meets_itself_can_be_written(spark, tmp_path):
    for name, query in {"citation": PC.canonical_citation, "repair": PA.answer_repair}.items():
        query(spark, SF).write.parquet(str(tmp_path / name))


def test_hyde_fusion_passes_over_the_documents_once(spark, monkeypatch):
    """The questions and the made-up answers are one batch."""
    blocks, one = [], S._search_block
    monkeypatch.setattr(S, "_search_block", lambda *a: (blocks.append(1), one(*a))[1])
    assert P.hyde_fusion(spark, SF).count() and len(blocks) == 1


def test_texts_are_cut_into_tokens_once_for_all_blocks(spark, monkeypatch):
    """Each block passed over all texts again, so that the work on them grew with the square of the corpus where documents ask."""
    cut, tokens = [], S.Corpus.tokens
    monkeypatch.setattr(S.Corpus, "tokens", lambda self: (cut.append(1), tokens(self))[1])
    asked = spark.createDataFrame(QUESTIONS, "q long, text string")
    assert S.search_corpus(S.Corpus(corpus(spark)), asked, "q", 5, most_bytes=20).count() and len(cut) == 1


def batches_of(docs, asked, most):
    import pyarrow as pa

    for a in range(0, len(docs), most):
        part = pa.array(docs[a : a + most], pa.list_(pa.string()))
        row, term = asked.numbers(part)
        both, tf = np.unique(row * asked.terms + term, return_counts=True)
        offsets = pa.array(np.searchsorted(both // asked.terms, np.arange(len(part) + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (both % asked.terms, tf)]
        yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(part))), pa.nulls(len(part), pa.string()), pa.array([max(2 * len(d) - 1, 0) for d in docs[a : a + most]]), *lists], names=["d", "group", "dl", "terms", "tfs"])


@pytest.mark.parametrize("common", [1e-9, 0.1, 2])
def test_common_terms_by_a_product_change_nothing(monkeypatch, common):
    """Documents added up by matrices, one by one or both, against plain loops."""
    import pyarrow as pa

    monkeypatch.setattr(S, "COMMON", common)
    monkeypatch.setattr(S, "CELLS", 40)
    monkeypatch.setattr(S, "SUMMANDS", 5)
    docs = [[f"w{(i * 7 + j * j) % (11 + j % 5)}" for j in range(i % 13)] for i in range(70)]
    queries = [docs[12], docs[25] + ["other"], ["w1"], ["none"], docs[51]]
    asked = S._asked_terms(pa.array(queries), np.arange(5), [None] * 5)
    pairs = lambda t: t + list(zip(t, t[1:]))
    terms = [pairs(d) for d in docs]
    average = sum(map(len, terms)) / len(docs)
    rows = list(batches_of(docs, asked, 9))
    df = sum(np.bincount(b.column(3).flatten().to_numpy(), minlength=asked.terms) for b in rows)
    weights = pickle.loads(pickle.dumps((np.log(1 + (70 - df + 0.5) / (df + 0.5)), df, 70, average)))
    scores = S._Scores(asked, {None: weights}, 1.2, 0.75, 5, {51: 4}, 6)
    for b in rows:
        scores.add(b)
    held = scores.best.rows()
    got = [(r["query"], r["key"], pytest.approx(r["score"], abs=2e-6)) for r in held.to_pylist()]
    want = []
    for q, query in enumerate(queries):
        found = {}
        for d, own in enumerate(terms):
            for t in set(pairs(query)) & set(own):
                n, tf = sum(t in o for o in terms), own.count(t)
                found[d] = found.get(d, 0) + math.log(1 + (70 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / average))
        found.pop(51 if q == 4 else None, None)
        want += [(q, d, s) for d, s in sorted(((d, round(s, 6)) for d, s in found.items()), key=lambda x: (-x[1], x[0]))[:6]]
    assert want == got


def test_pairs_are_found_whatever_slot_they_share():
    rng = np.random.default_rng(3)
    pairs = np.unique(rng.integers(0, 1 << 40, 3000))
    asked = S._Asked(np.arange(10), pairs, {})
    wanted = np.concatenate([pairs, rng.integers(0, 1 << 40, 3000)])
    place = {int(p): i for i, p in enumerate(pairs)}
    assert asked._places(wanted).tolist() == [place.get(int(x), -1) for x in wanted]
