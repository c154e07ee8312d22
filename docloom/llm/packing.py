"""Packing by non-negative least squares.

Documents are cut into full windows and one remainder. Shallow combinations of remainder lengths that
fill a window exactly are enumerated, their repeat counts are solved as non-negative least squares
against the histogram of lengths, rounded down to what the histogram holds, and what is left is packed
greedily, longest first. All of this works on the histogram, which has at most `window` entries
whatever the number of documents; documents are then dealt to the planned slots by rank within length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import TOKENIZER_DIR, gapless_ranks, materialize, returning, table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, window: int, end_id: int, tokenizer: str) -> DataFrame:
    """The pieces of each document: every full window of its ids, then the remainder.

    Null text counts as empty; each document ends with end_id, so none is without a piece.
    """

    def cut(batches):
        import pyarrow as pa

        from docloom.llm.word_bpe import piece_sums, word_bpe

        bpe, end = word_bpe(tokenizer), end_id.to_bytes(4, "little")
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = bpe.encode(text or "") + end
                for start, length, crc in piece_sums(ids, window):
                    for column, x in zip(out, (doc_id, start, length, crc, len(ids) // 4)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(returning(cut), PIECES)


def combinations(lengths: np.ndarray, window: int, partners: int = 12) -> np.ndarray:
    """Rows of up to four lengths that sum to window; 0 fills. All pairs, and for deeper ones a few partners of each length."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    rows = []
    a = lengths[lengths < window]
    b = window - a
    ok = there[b] & (a >= b)
    rows.append(np.stack([a[ok], b[ok], 0 * a[ok], 0 * a[ok]], 1))
    if len(a):
        few = np.unique(a[np.linspace(0, len(a) - 1, min(len(a), partners)).astype(int)])
        x, y = (g.ravel() for g in np.meshgrid(a, few, indexing="ij"))
        z = window - x - y
        ok = (z > 0) & there[np.clip(z, 0, window)]
        rows.append(np.stack([x[ok], y[ok], z[ok], 0 * x[ok]], 1))
        half = few[: max(1, len(few) // 2)]
        x, y, w = (g.ravel() for g in np.meshgrid(a, half, half, indexing="ij"))
        z = window - x - y - w
        ok = (z > 0) & there[np.clip(z, 0, window)]
        rows.append(np.stack([x[ok], y[ok], w[ok], z[ok]], 1))
    return np.unique(-np.sort(-np.concatenate(rows), axis=1), axis=0)


def solve_repeats(combos: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min |A x - counts| with x >= 0 by multiplicative updates (Lee and Seung, 2001); A counts lengths in combinations."""
    if not len(combos):
        return np.zeros(0)
    size = len(counts)
    used = combos > 0
    column = np.broadcast_to(np.arange(len(combos))[:, None], combos.shape)[used]
    length = combos[used]
    target = np.bincount(column, counts[length], len(combos))
    x = np.full(len(combos), max(counts.sum() / combos.size, 1e-9))
    for _ in range(rounds):
        reached = np.bincount(length, x[column], size)
        x *= target / np.maximum(np.bincount(column, reached[length], len(combos)), 1e-12)
    return x


def plan_windows(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of sequences that use up the histogram exactly."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        plan.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations(np.flatnonzero(left), window)
    repeats = solve_repeats(combos, left.astype(float))
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] < 1:
            break
        lengths, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
        n = min(int(repeats[k]), int((left[lengths] // times).min()))
        if n:
            left[lengths] -= n * times
            plan.append((tuple(int(x) for x in combos[k] if x), n))
    while True:  # greedily: the longest, then ever the longest that still fits, as often as all of them last
        there = np.flatnonzero(left)
        if not len(there):
            return plan
        room, chosen, taken = window, [], {}
        for length in there[::-1]:
            n = min(int(left[length]), room // int(length))
            if n:
                chosen += [int(length)] * n
                taken[int(length)] = n
                room -= n * int(length)
            if room < there[0]:
                break
        n = min(int(left[length]) // times for length, times in taken.items())
        for length, times in taken.items():
            left[length] -= n * times
        plan.append((tuple(chosen), n))


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Rows (length, rank of the first, sequence of the first, offset), sorted: rank r of a length has the last row at or below it."""
    rows, used, sequence = [], {}, 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    rows.sort()
    length, rank, first, offset = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
    return {"key": (length << 48) + rank, "rank": rank, "first": first, "offset": offset}


def pack_pieces(pieces: DataFrame, window: int) -> DataFrame:
    """pieces with sequence_id and offset. pieces has a column length from 1 to window; more columns are kept.

    Of the corpus only the histogram (at most `window` rows) comes to the driver, and only the plan
    (in all at most a few slots for each enumerated combination) goes to the tasks. Ranks within a
    length are split into buckets, so one length may hold most rows. An empty table stays empty.
    """
    stored = materialize(pieces.drop("sequence_id", "offset"), "pieces", "_row")
    histogram = {r["length"]: r["count"] for r in stored.groupBy("length").count().collect()}
    at = slots(plan_windows(histogram, window))
    ranked = gapless_ranks(stored, "length", "_row", [], "_rank")

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_rank"))
            row = np.searchsorted(at["key"], (length << 48) + rank, "right") - 1
            more = [pa.array(at["first"][row] + rank - at["rank"][row]), pa.array(at["offset"][row])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    return ranked.mapInArrow(returning(place), f"{schema}, sequence_id long, `offset` long").drop("_row", "_rank")


def op1_packing(spark: SparkSession, sf_dir: str, window: int = 4096, end_id: int = 2, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """All documents in sequences of at most 4096 ids.

    Null and empty texts are one id; repeated rows are packed each; no documents give no rows.
    """
    docs = table(spark, sf_dir, "documents")
    pieces = cut_documents(docs, window, end_id, f"{tokenizer_dir}/word_bpe_49k.json")
    return pack_pieces(pieces, window).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
