"""hybrid_factory against brute force."""

import math
import random
import re
from collections import Counter

import pytest
from docloom.operators import retrieval as R
from docloom.plans.documents import hybrid_factory

K, CANDIDATES, CONSTANT = 5, 20, 60


def corpus():
    rng = random.Random(5)
    words = ["w" + "".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    common = " ".join(words[:8] * 6)  # over 200 characters that most texts begin with
    texts = {}
    for i in range(60):
        tail = " ".join(rng.choice(words) for _ in range(rng.randint(5, 30)))
        texts[i] = f"{common if i % 3 else ''} {tail} {rng.choice(['the', 'and', 'AB'])} {1990 + i % 20} {i % 7},5".strip()
    texts[40] = " "
    return texts, {i: [rng.choice([-1.0, -0.5, 0.5, 1.0]) for _ in range(6)] for i in range(57)}


def tokens(text):
    one = re.findall(r"\d+(?:[.,]\d+)*%?|[^\W\d_]+(?:[-_][^\W\d_]+)*", text.lower())
    return one + [f"{a}::{b}" for a, b in zip(one, one[1:])]


def ranked(scores, k):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def recall(wanted, found):
    return len(set(wanted) & set(found)) / len(set(wanted)) if wanted else 1.0


def brute_force(texts, vectors):
    docs = {i: tokens(texts[i]) for i in vectors}
    counts = {i: Counter(t) for i, t in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    mean = sum(map(len, docs.values())) / len(docs)
    numbers = lambda t: re.findall(r"[0-9]+(?:[.,][0-9]+)*%?", t)
    is_year = lambda n: re.fullmatch("(19|20)[0-9]{2}", n)
    out = {}
    for q in (i for i in vectors if i % 20 == 0):
        lexical = Counter()
        for t in set(docs[q]):
            idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
            for d, c in counts.items():
                if t in c:
                    lexical[d] += idf * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        dense = {d: round(sum(a * b for a, b in zip(v, vectors[q])), 6) for d, v in vectors.items()}
        fused = Counter()
        for found in (dense, {d: round(s, 6) for d, s in lexical.items()}):
            for rank, (d, _) in enumerate(ranked(found, CANDIDATES), 1):
                fused[d] += 1 / (CONSTANT + rank)
        pool = ranked({d: round(s, 9) for d, s in fused.items()}, CANDIDATES)
        final, a = {}, texts[q]
        for d, s in pool:
            b, w = texts[d], R.CONSTRAINT_WEIGHTS
            years = lambda t: [n for n in numbers(t) if is_year(n)]
            rest = lambda t: [n for n in numbers(t) if not is_year(n)]
            names = lambda t: re.findall("[A-Z]{2,}", t)
            terms = lambda t: [x for x in ("the", "and") if x in t.lower()]
            total = w["year"] * recall(years(a), years(b)) + w["acronym"] * recall(names(a), names(b)) + w["metric"] * recall(terms(a), terms(b)) + w["number"] * recall(rest(a), rest(b)) + w["granularity"]
            final[d] = round(0.65 * s / pool[0][1] + 0.35 * total, 6)
        out |= {(q, rank): x for rank, x in enumerate(ranked(final, K), 1)}
    return out


def test_whole_texts_ask(spark, tmp_path):
    texts, vectors = corpus()
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query"], r["rank"]): (r.doc_id, r.score) for r in hybrid_factory(spark, str(tmp_path)).collect()}
    want = brute_force(texts, vectors)
    assert got.keys() == want.keys() and len(texts[20]) > 200
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)


def test_documents_with_vectors_are_dealt_to_all_tasks(spark, tmp_path, monkeypatch):
    """Those with a vector lie in the first files of the table, so that a few tasks had all the work."""
    from docloom.plans import documents as P

    spark.range(400).selectExpr("id AS doc_id", "concat('w', id % 7, ' w', id % 3) AS text").repartitionByRange(8, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(60).selectExpr("id AS vec_id", "array(1.0D, id / 60) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored, one = {}, P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name, *a, **b: stored.setdefault(name, one(df, name, *a, **b)))
    assert hybrid_factory(spark, str(tmp_path)).count() == 15
    assert len(stored["with-vectors"].inputFiles()) > 8
