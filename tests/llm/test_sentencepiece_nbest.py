import random

import numpy as np
from docloom.llm.common import TOKENIZER_DIR
from docloom.llm.sentencepiece_nbest import SPACE, Decoder, Lattice, decode_ids, encode_nbest, op9_sentencepiece, read_model

SF = "/root/testdata/sf0.001"
FILE = f"{TOKENIZER_DIR}/piece_bpe_32k.model"


def small():
    words = ["a", "b", "c", "ab", "bc", "abc", "▁", "▁a", "▁ab", "▁▁", "ca", "cab"]
    rng = random.Random(5)
    return [(w, i + 256, -float(rng.randint(1, 12)) if w != "▁▁" else -1e9) for i, w in enumerate(words)], list(range(256)), 999


def every(lattice, text):
    """All paths by plain recursion."""
    if not text:
        return [(0.0, b"")]
    out = []
    for k in range(1, len(text) + 1):
        found = lattice.pieces.get(text[:k])
        if found:
            first = found[1], found[0].to_bytes(4, "little")
        elif k == 1:
            first = lattice.unknown, lattice._bytes(text[0])
        else:
            continue
        out += [(first[0] + s, first[1] + ids) for s, ids in every(lattice, text[k:])]
    return out


def test_equals_all_paths():
    lattice, rng = Lattice(*small()), random.Random(6)
    for _ in range(150):
        text = "".join(rng.choice("aabbcc  \nxé") for _ in range(rng.randint(0, 9)))
        want = sorted((-s for s, _ in every(lattice, SPACE + text.replace(" ", SPACE))), reverse=False)[:5] if text else [0.0]
        got = lattice.encode(text, 5)
        assert [-s for s, _ in got] == want, text
        assert len({ids for _, ids in got}) == len(got)
        paths = {(s, ids) for s, ids in every(lattice, SPACE + text.replace(" ", SPACE))} if text else {(0.0, b"")}
        assert set(got) <= paths


def test_unit_search_and_batch_agree():
    lattice = Lattice(*read_model(FILE))
    texts = ["▁segmentation", "▁Donaudampfschiff", "▁l'été", "▁▁▁indent", "▁x" * 3, "▁你好世界", "\n", "▁" + "ab" * 60]
    best, second, ids = lattice.solve(texts)
    for t, b, s, i in zip(texts, best, second, ids):
        found = lattice.search(t, 6)
        assert found[0][0] == b and i in [x for y, x in found if y == b]
        assert (found[1][0] if len(found) > 1 else -np.inf) == s
        scores = [x for x, _ in found]
        assert scores == sorted(scores, reverse=True)


def test_round_trip():
    model = read_model(FILE)
    lattice, decoder = Lattice(*model), Decoder(*model)
    for t in ["", " ", "a", "  two  spaces ", "tab\tnew\nline\r\n", "Ünï", "emoji 🙂", "\x00", "日本語 テスト", "word " * 2000]:
        for _, ids in lattice.encode(t, 3):
            assert decoder.decode(ids) == t


def test_columns(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "two words", 1), (3, "two words", 1), (4, "z" * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, nbest int")
    got = encode_nbest(df, 3, FILE)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].nbest is None and [(x.score, x.ids) for x in by[2].nbest] == [(0.0, [])] and len(by[3].nbest) == 3
    back = decode_ids(got.selectExpr("doc_id", "nbest[0].ids as ids", "text as decoded").where("doc_id > 1"), "ids", FILE).collect()
    assert {r.doc_id: r.decoded for r in back} == {2: "", 3: "two words", 4: "z" * 5000}
    assert encode_nbest(df.where("false"), 3, FILE).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in op9_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    lattice = Lattice(*read_model(FILE))
    for d in docs[:25]:
        r = got[d.doc_id]
        assert r.same_text and r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.best_score == r.nbest_scores[0]
        if len(d.text) < 3000:
            whole = lattice.search(SPACE + d.text.replace(" ", SPACE), 4)
            assert [s for s, _ in whole] == r.nbest_scores
