import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from docloom.llm.common import TOKENIZER_DIR
from docloom.llm.packing import combinations, cut_documents, op1_packing, pack_pieces, plan_windows, solve_repeats
from docloom.llm.word_bpe import WordBpe
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
FILE = f"{TOKENIZER_DIR}/word_bpe_49k.json"

TEXTS = ["", " ", "The quick  brown\tfox's", "ΣΊΣΥΦΟΣ İstanbul ﬁne Straße", "a<|endoftext|>b <|startoftext|>", "é ́x 你好 мир", "x\x1cy \x85z 1234 !!??", " non breaking​", "we'll they'd can't 'S"]


def check(rows, window):
    spans, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for s in spans.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= window
    assert sorted(spans) == list(range(len(spans)))
    return spans, docs


def test_words_equal_tokenizer():
    t, mine = Tokenizer.from_file(FILE), WordBpe(FILE)
    for x in TEXTS:
        assert np.frombuffer(mine.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_plan_uses_histogram():
    rng = random.Random(3)
    for case in ({}, {4: 5}, {8: 3}, {1: 100}, {5: 7}, {k: rng.randint(0, 40) for k in range(1, 9)}):
        case = {k: v for k, v in case.items() if v}
        plan = plan_windows(case, 8)
        used = Counter()
        for lengths, n in plan:
            assert n > 0 and sum(lengths) <= 8
            for x in lengths:
                used[x] += n
        assert used == case


def test_least_squares_reaches_an_exact_histogram():
    combos = combinations(np.arange(1, 16), 16)
    truth = np.zeros(len(combos))
    truth[::7] = 50
    counts = np.zeros(17)
    for row, n in zip(combos, truth):
        for x in row[row > 0]:
            counts[x] += n
    x = solve_repeats(combos, counts, 3000)
    reached = np.zeros(17)
    for row, n in zip(combos, x):
        for k in row[row > 0]:
            reached[k] += n
    assert (x >= 0).all() and np.abs(reached - counts).max() < 0.02 * counts.max()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 30), (3, "word " * 30), (None, "x")], "doc_id long, text string")
    pieces = cut_documents(docs, 8, 2, FILE)
    rows = pack_pieces(pieces, 8).collect()
    check(rows, 8)
    assert sum(r.length for r in rows) == 1 + 1 + 31 + 31 + 2
    assert pack_pieces(pieces.where("false"), 8).count() == 0


def test_query(spark):
    rows = op1_packing(spark, SF).collect()
    spans, docs = check(rows, 4096)
    t = Tokenizer.from_file(FILE)
    by = {(r.doc_id, r.start): r for r in rows}
    total = 0
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        at = 0
        for start, n, whole in sorted(docs[d.doc_id]):
            assert start == at and whole == len(ids)
            assert by[d.doc_id, start].ids_crc32 == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    assert len(spans) <= -(-total // 4096) + max(1, len(spans) // 50)


if __name__ == "__main__":
    pytest.main([__file__])


def test_random_unicode_equals_the_tokenizer():
    from docloom.llm.common import TOKENIZER_DIR
    from docloom.llm.word_bpe import word_bpe
    from tokenizers import Tokenizer

    path = f"{TOKENIZER_DIR}/word_bpe_49k.json"
    tokenizer, bpe, rng = Tokenizer.from_file(path), word_bpe(path), np.random.default_rng(4)
    ranges = [(32, 127), (32, 127), (160, 592), (0x250, 0x2B0), (0x300, 0x370), (0x370, 0x530), (0x600, 0x700), (0x900, 0x980), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x3040, 0x3100), (0x4E00, 0x4F00), (0xFB00, 0xFB07), (0x1F600, 0x1F640), (0x181, 0x190)]
    for _ in range(1500):
        some = [ranges[k] for k in rng.integers(0, len(ranges), 3)]
        text = "".join(" " if rng.random() < 0.2 else chr(rng.integers(*some[rng.integers(0, 3)])) for _ in range(rng.integers(0, 40)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == want, text


def test_a_worker_forgets_the_words_when_it_turns_to_another_module():
    from docloom.llm import common
    from docloom.llm.word_bpe import word_bpe

    path = f"{common.TOKENIZER_DIR}/word_bpe_49k.json"
    common._turn_to("docloom.llm.packing")
    first = word_bpe(path)
    common._turn_to("docloom.llm.packing")
    assert word_bpe(path) is first
    common._turn_to("docloom.llm.toxicity")
    assert word_bpe(path) is not first
