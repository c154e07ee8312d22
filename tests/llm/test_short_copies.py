"""Near copies of few words, which share few five-word k-mers or none."""

import random
import sys
from pathlib import Path

import numpy as np
from docloom.llm.order_minhash import deletion_variants, near_documents, variant_places, word_hashes

sys.path.insert(0, str(Path(__file__).parent))
from test_order_minhash import edit, prose  # noqa: E402


def groups(texts):
    """Brute force in whole numbers: an edit distance of at most a fifth of the longer text."""
    group, w = {i: i for i in texts}, {i: t.split() for i, t in texts.items()}
    for i in texts:
        for j in range(i):
            longer = max(len(w[i]), len(w[j]))
            if group[i] != group[j] and 5 * abs(len(w[i]) - len(w[j])) <= longer and 5 * edit(w[i], w[j]) <= longer:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return group


def test_one_changed_word_at_any_place(spark):
    rng, texts = random.Random(4), {}
    for n in range(4, 15):
        for at in range(n):
            w = prose(rng, n).split()
            texts[len(texts)] = " ".join(w)
            texts[len(texts)] = " ".join([*w[:at], "other", *w[at + 1 :]])
            if n < 14:
                texts[len(texts)] = " ".join([*w[:at], "more", *w[at:]])
    for n in range(10, 15):  # two edits
        for _ in range(8):
            w = prose(rng, n).split()
            texts[len(texts)] = " ".join(w)
            for _ in range(2):
                w[rng.randrange(n)] = "x%d" % rng.randint(0, 9)
            texts[len(texts)] = " ".join(w)
            texts[len(texts)] = " ".join(w[2:] + ["end", "last"])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = groups(texts)
    for block in (512, 3):
        assert {r.doc_id: r.group_id for r in near_documents(df, block=block).collect()} == want


def test_variants_meet():
    rng = random.Random(6)
    assert len(variant_places(0.8)) == 15
    for _ in range(2000):
        x = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 14))]
        y = list(x)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randint(0, 1)] = [rng.choice("abcdefghijklmnop")] * rng.randint(0, 1)
        if not 0 < len(y) <= 14:
            continue
        h, n, _ = word_hashes([" ".join(x), " ".join(y)])
        a, b = deletion_variants(h, n, 0.8)
        if edit(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
            assert len(np.intersect1d(a, b))
    h, n, _ = word_hashes(["", " ".join("abcdefghijklmno")])
    assert deletion_variants(h, n, 0.8) == [None, None]
