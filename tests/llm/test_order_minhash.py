import random

import numpy as np
import pytest
from docloom.llm.order_minhash import K, SHORT, distance_in_band, document_sketches, labelled_kmers, links_within, near, near_documents, op6_order_minhash, order_sketches, word_bits, word_hashes

SF = "/root/testdata/sf0.001"


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def groups(texts, similarity=0.8):
    """Brute force over all pairs."""
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    w = {i: words(t) for i, t in texts.items() if t is not None}
    ids = sorted(w)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            longer = max(len(w[i]), len(w[j]))
            close = texts[i] == texts[j] or (longer and abs(len(w[i]) - len(w[j])) <= (1 - similarity) * longer and edit(w[i], w[j]) <= (1 - similarity) * longer + 1e-9)
            if close and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in texts}


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n))


def test_words_and_kmers():
    texts = ["", "One, two; THREE", "été été", "!!!", "a b c d e f a b c d e f"]
    hashes, counts, _ = word_hashes(texts)
    assert counts.tolist() == [len(words(t)) for t in texts]
    flat = [x for t in texts for x in words(t)]
    by = {}
    for h, x in zip(hashes.tolist(), flat):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)
    kmers, n = labelled_kmers(hashes, counts)
    assert n.tolist() == [0, 1, 1, 0, 8]
    assert len(set(kmers.tolist())) == 10  # a repeated k-mer has another label


def test_sketch_depends_on_order():
    rng = random.Random(2)
    a, b = prose(rng, 40), prose(rng, 40)
    h, n, _ = word_hashes([a + " " + b, b + " " + a, a + " " + b])
    s = order_sketches(*labelled_kmers(h, n), 200)
    assert (s[0] == s[2]).all()
    swapped = (s[0] == s[1]).mean()
    assert 0.2 < swapped < 0.75  # both from one half: about a half


def test_distance():
    rng = random.Random(3)
    a, b, want = [], [], []
    for _ in range(200):
        x = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        y = [v for v in x if rng.random() > 0.1]
        for _ in range(rng.randint(0, 4)):
            y.insert(rng.randint(0, len(y)), rng.randint(0, 5))
        a.append(np.array(x, np.uint32)), b.append(np.array(y, np.uint32)), want.append(edit(x, y))
    got = distance_in_band(a, b, 12)
    for g, w in zip(got, want):
        assert g == w if w <= 12 else g > 12
    limit = [w <= 0.2 * max(len(x), len(y)) + 1e-9 and max(len(x), len(y)) > 0 for x, y, w in zip(a, b, want)]
    assert near(list(zip(a, b)), 0.8).tolist() == limit


def corpus():
    rng = random.Random(7)
    texts, passage = {}, prose(rng, 60)
    for i in range(0, 40):
        texts[i] = prose(rng, rng.randint(5, 80))
    for i in range(40, 80):  # a passage that many share
        texts[i] = prose(rng, 25) + " " + passage + " " + prose(rng, 20)
    base = prose(rng, 120)
    for i in range(80, 110):  # near copies of one another
        w = base.split()
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = "new%d" % rng.randint(0, 99)
        texts[i] = " ".join(w)
    for i in range(110, 125):  # edits that add up along a chain
        w = texts[i - 1].split()
        for _ in range(3):
            w[rng.randrange(len(w))] = "link%d" % i
        texts[i] = " ".join(w)
    for i in range(125, 135):
        texts[i] = texts[i - 100]
    texts |= {135: "", 136: "", 137: None, 138: None, 139: "!!", 140: "!!", 141: "?", 142: "a", 143: "A.", 144: "b"}
    return texts


def test_equals_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, digest string")
    want = groups(texts)
    for block in (512, 7):
        got = near_documents(df, block=block).collect()
        assert {r.doc_id: r.group_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.group_id) for r in got)


@pytest.mark.parametrize("share", [0.78, 0.82])
def test_short_documents_of_one_passage(spark, share):
    """Many documents of which nearly four fifths, or just over, are one passage."""
    rng = random.Random(9)
    passage = prose(rng, round(100 * share)).split()
    texts = {}
    for i in range(120):
        own = prose(rng, 100 - len(passage)).split()
        if i % 4 == 3:  # near another one
            own = texts[i - 1].split()[: len(own) // 2] + own[len(own) // 2 :] if i % 8 == 7 else own
        k = len(own) // 2
        texts[i] = " ".join([*own[:k], *passage, *own[k:]])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = groups(texts)
    assert len(set(want.values())) < 120 and (share < 0.8 or set(want.values()) == {0})
    for block in (2048, 25):
        assert {r.doc_id: r.group_id for r in near_documents(df, block=block).collect()} == want


def test_bits_bound_the_distance():
    rng = random.Random(12)
    for _ in range(50):
        many = [np.array([rng.randint(0, 9) for _ in range(rng.randint(0, 40))], "<u4") for _ in range(6)]
        bits = word_bits(many)
        for i in range(6):
            for j in range(6):
                assert np.bitwise_count(bits[i] & ~bits[j]).sum() <= edit(many[i].tolist(), many[j].tolist())


def test_links_within_skip_what_is_connected():
    a = np.arange(50, dtype="<u4")
    words = [a, np.append(a, 99).astype("<u4"), np.append(a, 98).astype("<u4"), a + 500]
    sketch = np.array([[1, 3], [1, 3], [1, 3], [1, 3]])
    node, part = np.arange(4) + 10, np.zeros(4, np.int64)
    got = links_within(1, 0, 0, node, node, part, words, sketch, 0.8)
    assert len(got) == 2 and {x for e in got for x in e} == {10, 11, 12}
    assert links_within(3, 0, 0, node, node, part, words, sketch, 0.8) == []  # they met in the first sketch
    assert links_within(1, 0, 0, node, np.zeros(4), part, words, sketch, 0.8) == []


@pytest.mark.parametrize("words_of", [15, 20, 30, 60, 200, SHORT + 10, 400])
def test_recall_of_scattered_edits(words_of):
    """Candidates of pairs at the least similarity, words changed at random."""
    rng = np.random.default_rng(words_of)
    n, edits = 300, int(0.2 * words_of + 1e-9)
    a = rng.integers(1, 1 << 62, (n, words_of), dtype=np.uint64)
    b = a.copy()
    for row in b:
        row[rng.choice(words_of, edits, replace=False)] = rng.integers(1, 1 << 62, edits, dtype=np.uint64)
    s = document_sketches(np.concatenate([a, b]).ravel(), np.full(2 * n, words_of))
    assert ((s[:n] == s[n:]) & (s[:n] != 0)).any(1).mean() >= 0.9


def test_very_long_texts(spark):
    rng = random.Random(10)
    w = prose(rng, 30_000).split()
    other = list(w)
    for k in range(0, 30_000, 30):
        other[k] = "changed"
    df = spark.createDataFrame([(4, " ".join(w)), (2, " ".join(other)), (3, prose(rng, 30_000)), (5, "x" * 1_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in near_documents(df).collect()} == {4: 2, 2: 2, 3: 3, 5: 5}


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A b c.")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.group_id, r.kept) for r in near_documents(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (None, None, True), (2, 1, False)], key=str)
    assert near_documents(df.where("false")).count() == 0


def test_query(spark):
    got = {r.doc_id: r.group_id for r in op6_order_minhash(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    short = {i: t for i, t in texts.items() if len(words(t)) < 250}
    want = groups(short)
    assert {i: got[i] for i in short if got[i] in short} == {i: want[i] for i in short if got[i] in short}
    assert len(got) == len(texts) and K == 5
