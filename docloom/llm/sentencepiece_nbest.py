"""N-best segmentation over a SentencePiece model's pieces.

A forward Viterbi pass gives the best score up to every place of the lattice; a search from the end
backwards that ranks partial paths by their own score plus that forward score is A* with an exact
heuristic, so complete paths come out best first. No piece spans the beginning of a word, so a text's
lattice is a chain of units. Units are solved once each, many together, along with the best score of
any other path through them; the text's n best paths can only depart in the n - 1 units where a
departure costs least, and only those are searched.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import TOKENIZER_DIR, table

SPACE = "▁"
#: A place of the text that no piece covers becomes its bytes, and costs this much more than the worst ordinary piece.
UNKNOWN_COST = 10.0
#: Pieces at or below this score are the model's own runs of spaces, not ordinary ones.
ORDINARY = -1e8
#: Runs of spaces with the word after them; line breaks; a beginning without a space.
UNITS = re.compile("▁+[^▁\n]*|\n|[^▁\n]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Lattice:
    """Pieces with scores. score and best ids of units are kept up to a bound."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int] | None, unknown_id: int, most_units: int = 400_000):
        """pieces: (text, id, score); byte_ids: of the 256 bytes, if the model falls back to them."""
        self.pieces = {p: (i, s) for p, i, s in pieces}
        self.byte_ids, self.unknown_id = byte_ids, unknown_id
        self.unknown = min([s for _, _, s in pieces if s > ORDINARY], default=0.0) - UNKNOWN_COST
        self.longest = max((len(p) for p, _, _ in pieces), default=1)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p and p != "\n" for p, _, _ in pieces):
            raise ValueError("a piece spans words")
        self.most_units = most_units
        self._tables(pieces)
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.best, self.second = np.zeros(1 << 16), np.zeros(1 << 16)  # grown by doubling
        self.ids: list[bytes] = []
        self.alternatives: dict[tuple[str, int], list] = {}

    def _tables(self, pieces) -> None:
        """For each length, sorted hashes of its pieces with scores and ids."""
        self.by_length = {}
        for n in sorted({len(p) for p, _, _ in pieces}):
            own = [(p, i, s) for p, i, s in pieces if len(p) == n]
            codes = np.frombuffer("".join(p for p, _, _ in own).encode("utf-32-le"), "<u4").reshape(len(own), n).astype(np.uint64) + np.uint64(1)
            powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE)]))
            keys = (codes * powers).sum(1, dtype=np.uint64)
            order = np.argsort(keys)
            if (np.diff(keys[order]) == 0).any():
                raise ValueError("hashes of two pieces agree")
            self.by_length[n] = keys[order], np.array([own[k][2] for k in order]), np.array([own[k][1] for k in order])

    # -- many units at once ---------------------------------------------------------------------

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Best score, score of the best other path (-inf if there is none) and best ids of each unit."""
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        best, second, ids = np.zeros(len(units)), np.zeros(len(units)), [b""] * len(units)
        a = 0
        while a < len(order):
            b, wide = a + 1, len(units[order[a]])
            while b < len(order) and len(units[order[b]]) <= max(8, wide + wide // 4) and (b - a) * (len(units[order[b]]) + 1) < 400_000:
                b += 1
            rows = order[a:b]
            best[rows], second[rows], found = self._solve([units[i] for i in rows])
            for i, x in zip(rows, found):
                ids[i] = x
            a = b
        return best, second, ids

    def _solve(self, units: list[str]):
        n, size = len(units), np.array([len(u) for u in units])
        wide = int(size.max())
        inside = np.arange(wide) < size[:, None]
        code = np.zeros((n, wide), np.uint64)
        code[inside] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(wide - 1, _BASE)]))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(wide - 1, _INVERSE)]))
        sums = np.zeros((n, wide + 1), np.uint64)
        np.cumsum((code + np.uint64(1)) * powers, axis=1, out=sums[:, 1:])
        lengths = [k for k in self.by_length if k <= wide]
        edge, piece = {}, {}
        for k in lengths:
            keys, scores, ids = self.by_length[k]
            span = (sums[:, k:] - sums[:, : wide + 1 - k]) * down[: wide + 1 - k]
            ok = np.arange(k, wide + 1) <= size[:, None]
            at = np.minimum(np.searchsorted(keys, span[ok]), len(keys) - 1)
            hit = keys[at] == span[ok]
            w, p = np.full(span.shape, -np.inf), np.full(span.shape, -1, np.int64)
            w[ok], p[ok] = np.where(hit, scores[at], -np.inf), np.where(hit, ids[at], -1)
            edge[k], piece[k] = w, p
        if 1 not in edge:
            lengths = [1, *lengths]
            edge[1], piece[1] = np.full((n, wide), -np.inf), np.full((n, wide), -1, np.int64)
        edge[1] = np.where(inside & (piece[1] < 0), self.unknown, edge[1])
        forward = np.full((n, wide + 1), -np.inf)
        forward[:, 0] = 0
        came = np.zeros((n, wide + 1), np.int64)
        for e in range(1, wide + 1):
            for k in lengths:  # shorter first: of equal scores the longer last piece stays
                if k > e:
                    break
                x = forward[:, e - k] + edge[k][:, e - k]
                better = (x >= forward[:, e]) & (x > -np.inf)
                forward[better, e] = x[better]
                came[better, e] = k
        backward = np.full((n, wide + 1), -np.inf)
        backward[np.arange(n), size] = 0
        for s in range(wide - 1, -1, -1):
            for k in lengths:
                if s + k > wide:
                    break
                np.maximum(backward[:, s], edge[k][:, s] + backward[:, s + k], out=backward[:, s])
        on = {k: np.zeros((n, wide + 1 - k), bool) for k in lengths}
        at, live, steps = size.copy(), np.arange(n), []
        while len(live):
            k = came[live, at[live]]
            start = at[live] - k
            chosen = np.zeros(len(live), np.int64)
            for x in np.unique(k):
                m = k == x
                on[x][live[m], start[m]] = True
                chosen[m] = piece[x][live[m], start[m]]
            steps.append((live, start, chosen))
            at[live] = start
            live = live[start > 0]
        second = np.full(n, -np.inf)
        for k in lengths:
            other = forward[:, : wide + 1 - k] + edge[k] + backward[:, k:]
            other[on[k]] = -np.inf
            np.maximum(second, other.max(1), out=second)
        row, start, chosen = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((start, row))
        row, start, chosen = row[order], start[order], chosen[order]
        ends = np.cumsum(np.bincount(row, minlength=n))
        flat = chosen.astype("<u4").tobytes()
        ids = [flat[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), np.bincount(row, minlength=n).tolist())]
        for r in np.unique(row[chosen < 0]).tolist():
            a, b = (ends[r - 1] if r else 0), ends[r]
            ids[r] = b"".join(self._bytes(units[r][s]) if c < 0 else int(c).to_bytes(4, "little") for s, c in zip(start[a:b].tolist(), chosen[a:b].tolist()))
        return forward[np.arange(n), size], second, ids

    def _bytes(self, char: str) -> bytes:
        """Ids of a place that no piece covers."""
        if self.byte_ids is None:
            return self.unknown_id.to_bytes(4, "little")
        return b"".join(self.byte_ids[x].to_bytes(4, "little") for x in char.encode("utf-8", "surrogatepass"))

    # -- one unit: A* from the end ----------------------------------------------------------------

    def edges_to(self, text: str, end: int):
        """(start, score, ids) of the lattice's edges that end at a place."""
        for k in range(1, min(self.longest, end) + 1):
            found = self.pieces.get(text[end - k : end])
            if found is not None:
                yield end - k, found[1], found[0].to_bytes(4, "little")
            elif k == 1:
                yield end - 1, self.unknown, self._bytes(text[end - 1])

    def search(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best paths through a text, best first; of equal scores the longer last piece first."""
        forward = [0.0] + [-np.inf] * len(text)
        for e in range(1, len(text) + 1):
            forward[e] = max(forward[s] + w for s, w, _ in self.edges_to(text, e))
        order = itertools.count()
        # of equal totals the path nearest to the beginning goes first, so that ties do not widen the search
        heap = [(-forward[-1], len(text), next(order), 0.0, None)]
        out = []
        while heap and len(out) < n:
            _, at, _, score, path = heapq.heappop(heap)
            if at == 0:
                parts, node = [], path
                while node is not None:
                    parts.append(node[0])
                    node = node[1]
                out.append((score, b"".join(parts)))
                continue
            for s, w, ids in sorted(self.edges_to(text, at), key=lambda x: x[0]):
                heapq.heappush(heap, (-(forward[s] + w + score), s, next(order), score + w, (ids, path)))
        return out

    # -- texts --------------------------------------------------------------------------------------

    def units(self, text: str) -> list[str]:
        return UNITS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, units) -> None:
        if len(self.known) > self.most_units:
            self.reset()
        new = [u for u in dict.fromkeys(units) if u not in self.known]
        if new:
            base = len(self.ids)
            best, second, ids = self.solve(new)
            self.ids += ids
            while len(self.ids) > len(self.best):
                self.best, self.second = (np.concatenate([x, np.zeros(len(x))]) for x in (self.best, self.second))
            self.best[base : len(self.ids)] = best
            self.second[base : len(self.ids)] = second - best
            self.known.update(zip(new, range(base, base + len(new))))

    def encode(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """(score, ids) of the n best segmentations of a text, best first; fewer if there are no more."""
        units = self.units(text)
        self.learn(units)
        parts, found = self.departures(units, n)
        out = []
        for score, changed in found:
            ids = list(parts)
            for i, x in changed:
                ids[i] = x
            out.append((score, b"".join(ids)))
        return out

    def departures(self, units: list[str], n: int) -> tuple[list[bytes], list[tuple[float, list[tuple[int, bytes]]]]]:
        """Best ids of each known unit; and for the n best paths their scores and the units whose ids differ."""
        at = list(map(self.known.__getitem__, units))
        where = np.array(at, np.int64)
        best = float(self.best[where].sum())
        parts = list(map(self.ids.__getitem__, at))
        out = [(best, [])]
        if n == 1 or not at:
            return parts, out
        costs = -self.second[where]
        where = np.argsort(costs, kind="stable")[: n - 1] if len(costs) < 64 else self._cheapest(costs, n - 1)
        places = [int(i) for i in where if costs[i] < np.inf]
        options = []
        for i in places:
            key = units[i], n
            if key not in self.alternatives:
                paths = self.search(units[i], n)
                self.alternatives[key] = [(paths[0][0] - s, ids) for s, ids in paths if ids != self.ids[at[i]]][: n - 1]
            options.append([(0.0, parts[i]), *self.alternatives[key]])
        heap, seen = [(0.0, (0,) * len(options))], {(0,) * len(options)}
        found = []
        while heap and len(found) < n:
            cost, choice = heapq.heappop(heap)
            found.append((cost, choice))
            for j, c in enumerate(choice):
                if c + 1 < len(options[j]):
                    following = (*choice[:j], c + 1, *choice[j + 1 :])
                    if following not in seen:
                        seen.add(following)
                        heapq.heappush(heap, (cost - options[j][c][0] + options[j][c + 1][0], following))
        out += [(best - cost, [(places[j], options[j][c][1]) for j, c in enumerate(choice) if c]) for cost, choice in found[1:]]
        return parts, out

    @staticmethod
    def _cheapest(costs: np.ndarray, n: int) -> np.ndarray:
        near = np.flatnonzero(costs <= np.partition(costs, n - 1)[n - 1])
        return near[np.argsort(costs[near], kind="stable")][:n]


class Decoder:
    """Ids back to text."""

    def __init__(self, pieces: list[tuple[str, int, float]], byte_ids: list[int] | None, unknown_id: int):
        known = {i: p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p, i, _ in pieces}
        known |= {i: bytes([b]) for b, i in enumerate(byte_ids or [])} | {unknown_id: " ⁇ ".encode()}
        self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]

    def decode(self, ids: bytes) -> str:
        """Without the space before the first word; ids beyond the model are left out, broken UTF-8 becomes U+FFFD."""
        numbers = np.frombuffer(ids, "<u4")
        body = b"".join(map(self.bytes.__getitem__, numbers[numbers < len(self.bytes)].tolist()))
        try:
            text = body.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            text = body.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def read_model(path: str) -> tuple[list[tuple[str, int, float]], list[int] | None, int]:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ordinary, bytes_ = [], {}
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[3:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            ordinary.append((piece, i, model.get_score(i)))
    return ordinary, [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None, model.unk_id()


@cache
def loaded(path: str) -> tuple[Lattice, Decoder]:
    """One for each Python worker, so that its units last from task to task."""
    model = read_model(path)
    return Lattice(*model), Decoder(*model)


def encode_nbest(docs: DataFrame, n: int, path: str, text: str = "text") -> DataFrame:
    """docs with nbest: array of (score, ids), best first. Null texts give null, empty ones a single empty segmentation."""
    docs = docs.drop("nbest")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        import pyarrow as pa

        lattice, _ = loaded(path)
        kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))
        for batch in batches:
            out = [None if t is None else [{"score": s, "ids": np.frombuffer(x, "<i4")} for s, x in lattice.encode(t, n)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "nbest"])

    return docs.mapInArrow(run, f"{kept}, nbest array<struct<score: double, ids: array<int>>>")


def decode_ids(df: DataFrame, ids: str, path: str) -> DataFrame:
    """df with decoded: the text of a column of id arrays; null for null."""
    df = df.drop("decoded")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        import pyarrow as pa

        _, decoder = loaded(path)
        for batch in batches:
            out = [None if x is None else decoder.decode(np.array([v for v in x if v is not None], "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, f"{kept}, decoded string")


DIGEST = "doc_id long, n_pieces long, best_score double, nbest_scores array<double>, ids_crc32 long, decoded_crc32 long, same_text boolean"


def digest_nbest(docs: DataFrame, n: int, path: str) -> DataFrame:
    """Digests of the n best segmentations and of what the best decodes to. Null texts count as empty."""

    def run(batches):
        import pyarrow as pa

        lattice, decoder = loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows: list[tuple] = []
            for a in range(0, len(texts), 500):
                units = [lattice.units(t) for t in texts[a : a + 500]]
                lattice.learn(itertools.chain.from_iterable(units))
                for t, own in zip(texts[a : a + 500], units):
                    parts, found = lattice.departures(own, n)
                    ids = b"".join(parts)
                    back = decoder.decode(ids)
                    rows.append((len(ids) // 4, found[0][0], [s for s, _ in found], zlib.crc32(ids), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == t))
            columns = zip(*rows) if rows else [()] * 6
            kinds = (pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)


def op9_sentencepiece(spark: SparkSession, sf_dir: str, n: int = 4, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """The four best segmentations of every text of documents, and the best one decoded again.

    same_text: decoding gives the text back; it does unless the text holds U+2581, which decodes to a space.
    """
    return digest_nbest(table(spark, sf_dir, "documents"), n, f"{tokenizer_dir}/piece_bpe_32k.model")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict[str, str] = {}
