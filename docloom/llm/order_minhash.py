"""Near-duplicate documents by Order MinHash (Marcais et al., 2019) and banded alignment.

Each document is its lower-cased words; its k-mers are runs of words, labelled by which occurrence in
the document they are. A sketch takes, under one hash, the smallest labelled k-mers and keeps them in
text order, so it depends on the order of what documents share and follows edit similarity.
Documents that agree in a sketch are candidates; a pair is linked if the words' edit distance, by
alignment in a band, is at most a fifth of the longer document.

Most sketches are of five-word k-mers. Edits that are scattered leave few of these, so each document
also has sketches of word pairs, of more of them where it is long. The shortest documents share few
k-mers however near they are: they have a key for each text that is left when as many words are
deleted as the similarity allows. Texts within that distance agree in one of these, so pairs of at
most 14 words, at 0.8, are never missed.

Equal texts are one class from the start. Within a bucket every class is a candidate of the smallest.
Each class is first aligned with the one of these with which it shares most sketches, then with the
others that this has not connected. At last, classes of one bucket that are still in different
components are compared with each other in tasks, block against block: the words that one lacks of the
other bound their distance from below, what is left is aligned, and what a link connects is not
aligned again. Tasks emit the links of a forest, never pairs. So no candidate pair goes unanswered: it
is linked, rejected, or already connected.
"""

from __future__ import annotations

import itertools
import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import connected_components, materialize, returning, table
from docloom.llm.media import in_portions

K = 5
SIMILARITY = 0.8
#: Documents of at most so many words count as short.
SHORT = 250
#: (words of a k-mer, k-mers of a sketch, sketches): of every document, of short ones, of long ones.
EVERY, OF_SHORT, OF_LONG = (K, 2, 40), (2, 3, 40), (2, 4, 40)
SKETCHES = EVERY[2] + OF_SHORT[2] + OF_LONG[2]
#: Most deletion variants of a text; longer texts have none.
MOST_VARIANTS = 128

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _POWERS = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS


#: Bytes that make up words: letters and digits, and all of any letter beyond ASCII.
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_hashes(texts: list[str], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """64-bit hashes of the words of all texts, and how many each text has.

    prefixes: for each number of bytes, also the hashes of the words' beginnings; 0 for words no longer.
    """
    bodies = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join([*bodies, b""]), np.uint8)
    up, down = powers(len(raw))
    inside = _INSIDE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    stops = np.cumsum([len(b) + 1 for b in bodies])
    starts = [np.where(end - begin > n, mix((sums[np.minimum(begin + n, len(raw))] - sums[begin]) * down[begin] + np.uint64(n << 32)), np.uint64(0)) for n in prefixes]
    return hashes, np.diff(np.searchsorted(begin, stops), prepend=0), starts


def labelled_kmers(hashes: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of documents one after another, and how many each has.

    A document of fewer than k words has one k-mer of all of them, one without words none.
    """
    ends = np.cumsum(counts)
    document = np.repeat(np.arange(len(counts)), counts)
    padded = np.concatenate([hashes, np.zeros(k - 1, np.uint64)])
    owner = np.concatenate([document, np.full(k - 1, -1)])
    n = len(hashes)
    value = np.zeros(n, np.uint64)
    for j in range(k):  # what lies beyond the document counts as 0
        value = value * _BASE + np.where(owner[j : j + n] == document, padded[j : j + n], np.uint64(0))
    value = mix(value)
    keep = np.arange(n) < (np.maximum(ends - k, ends - counts) + 1)[document] if n else np.zeros(0, bool)
    value, document = value[keep], document[keep]
    own = mix(value + document.astype(np.uint64) * _MIX_B)
    order = np.argsort(own, kind="stable")
    same = np.concatenate([[False], own[order][1:] == own[order][:-1]]) if len(own) else np.zeros(0, bool)
    at = np.arange(len(own))
    first = np.maximum.accumulate(np.where(same, 0, at)) if len(own) else at
    occurrence = np.empty(len(own), np.int64)
    occurrence[order] = at - first
    return mix(value + occurrence.astype(np.uint64) * _MIX_A), np.bincount(document, minlength=len(counts))


def order_sketches(kmers: np.ndarray, counts: np.ndarray, sketches: int, size: int = 2, seed: int = 11) -> np.ndarray:
    """Documents by sketches: a 64-bit key of the `size` smallest k-mers in text order, of all if there are fewer; rows without k-mers are 0."""
    out = np.zeros((len(counts), sketches), np.uint64)
    has = np.flatnonzero(counts > 0)
    if not len(has):
        return out
    starts = (np.cumsum(counts) - counts)[has]
    low = np.uint64((1 << 24) - 1)
    place = np.arange(len(kmers), dtype=np.uint64)
    if len(kmers) > 1 << 24:  # one very long document alone: places need more bits
        low = np.uint64((1 << 36) - 1)
    odd = np.random.default_rng(seed).integers(0, 1 << 63, (sketches, 2), dtype=np.uint64) | np.uint64(1)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(sketches):
        rank = ((kmers + odd[s, 1]) * odd[s, 0]) & ~low
        rank |= place
        chosen: list[np.ndarray] = []
        for j in range(size):
            at = (np.minimum.reduceat(rank, starts) & low).astype(np.int64)
            if j:
                at = np.where(counts[has] > j, at, chosen[0])
            chosen.append(at)
            if j + 1 < size:
                rank[at] = top
        value = np.full(len(has), np.uint64(s + seed))
        for at in np.sort(np.stack(chosen), axis=0):
            value = mix(value * _BASE + kmers[at])
        out[has, s] = value | np.uint64(1)
    return out


def document_sketches(hashes: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """All sketches of documents one after another, in the columns of EVERY, OF_SHORT and OF_LONG; 0 where a document has none.

    Documents near the limit have both kinds, so that two within the similarity always have one in common.
    """
    out = [order_sketches(*labelled_kmers(hashes, counts, EVERY[0]), EVERY[2], EVERY[1])]
    for (k, size, sketches), chosen, seed in ((OF_SHORT, counts * similarity <= SHORT, 12), (OF_LONG, counts > SHORT, 13)):
        part = np.zeros((len(counts), sketches), np.uint64)
        of = np.repeat(chosen, counts)
        part[chosen] = order_sketches(*labelled_kmers(hashes[of], counts[chosen], k), sketches, size, seed)
        out.append(part)
    return np.concatenate(out, axis=1)


@cache
def variant_places(similarity: float) -> list[list[np.ndarray]]:
    """For texts of 0, 1, 2 ... words: the places that stay when as many are deleted as similarity allows, an array for each number of deletions."""
    out: list[list[np.ndarray]] = [[]]
    while True:
        n = len(out)
        most = min(n - 1, int((1 - similarity) * n + 1e-9))
        if sum(math.comb(n, d) for d in range(most + 1)) > MOST_VARIANTS:
            return out
        out.append([np.array(list(itertools.combinations(range(n), n - d))) for d in range(most + 1)])


def deletion_variants(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> list[np.ndarray | None]:
    """Distinct keys of each document's deletion variants; they are even, those of sketches odd. None for texts without words or of too many.

    If x has m words and y n >= m, at edit distance d or less, with d the most that n words allow, they
    share a subsequence of n - d words. x then lacks d - (n - m) words, and so many are allowed for m too.
    """
    out: list[np.ndarray | None] = [None] * len(counts)
    starts, places = np.cumsum(counts) - counts, variant_places(similarity)
    for n in range(1, len(places)):
        at = np.flatnonzero(counts == n)
        if not len(at):
            continue
        words, keys = hashes[starts[at][:, None] + np.arange(n)], []
        for stay in places[n]:
            value = np.full((len(at), len(stay)), stay.shape[1], np.uint64)
            for j in range(stay.shape[1]):
                value = mix(value * _BASE + words[:, stay[:, j]])
            keys.append(value & ~np.uint64(1))
        for i, x in zip(at, np.concatenate(keys, axis=1)):
            out[i] = np.unique(x)
    return out


def _sketch(similarity: float):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in in_portions([len(t) for t in texts], 600_000):
                hashes, counts, _ = word_hashes(texts[a:b])
                body = [x.tobytes() if n else None for x, n in zip(document_sketches(hashes, counts, similarity), counts)]
                variants = [None if x is None else x.tobytes() for x in deletion_variants(hashes, counts, similarity)]
                columns = [batch.column("digest").slice(a, b - a), pa.array(counts.astype(np.int32)), pa.array(body, pa.binary()), pa.array(variants, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "size", "sketch", "variants"])

    return run


def _buckets(batches):
    """A row for each class and sketch or deletion variant."""
    import pyarrow as pa

    for batch in batches:
        for column in ("sketch", "variants"):
            bodies = [x or b"" for x in batch.column(column).to_pylist()]
            keys = np.frombuffer(b"".join(bodies), np.int64)
            nodes = np.repeat(batch.column("node").to_numpy(), [len(x) // 8 for x in bodies])
            yield pa.RecordBatch.from_arrays([pa.array(keys[keys != 0]), pa.array(nodes[keys != 0])], names=["bucket", "node"])


def _words(batches):
    """32-bit hashes of the words of each class."""
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in in_portions([len(t) for t in texts], 600_000):
            hashes, counts, _ = word_hashes(texts[a:b])
            parts = np.split((hashes >> np.uint64(32)).astype("<u4"), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array([p.tobytes() for p in parts], pa.binary())], names=["node", "words"])


def distance_in_band(a: list[np.ndarray], b: list[np.ndarray], band: int) -> np.ndarray:
    """Edit distance of each pair; right where it is at most band, beyond it too large."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    n, rows, wide = len(a), int(la.max()), 2 * band + 1
    left = np.full((n, rows), -1, np.int64)
    right = np.full((n, max(rows, int(lb.max())) + wide + band), -2, np.int64)
    for i in range(n):
        left[i, : la[i]] = a[i]
        right[i, band : band + lb[i]] = b[i]
    j = np.arange(wide, dtype=np.int32)
    far = np.int32(1 << 28)
    now = np.tile(np.where(j >= band, j - band, far).astype(np.int32), (n, 1))
    out = np.full(n, far, np.int64)
    at = np.clip(lb - la + band, 0, wide - 1)
    reach = np.abs(lb - la) <= band
    done = la == 0
    out[done & reach] = now[done & reach, at[done & reach]]
    for i in range(rows):
        step = now + (right[:, i : i + wide] != left[:, i : i + 1])
        np.minimum(step[:, :-1], now[:, 1:] + 1, out=step[:, :-1])
        now = np.minimum.accumulate(step - j, axis=1) + j
        done = (la == i + 1) & reach
        if done.any():
            out[done] = now[done, at[done]]
    return out


def near(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """Whether the edit distance of each pair is at most (1 - similarity) times the longer length.

    Equal ends are cut off, and a pair whose words in common are too few whatever their order is
    rejected; the rest is aligned in bands that double up to the allowed distance.
    """
    out = np.zeros(len(pairs), bool)
    left = []
    for i, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        most = int((1 - similarity) * longer + 1e-9)
        if abs(len(a) - len(b)) > most or not longer:
            continue
        n = min(len(a), len(b))
        unequal = np.flatnonzero(a[:n] != b[:n])
        start = int(unequal[0]) if len(unequal) else n
        a, b = a[start:], b[start:]
        n = min(len(a), len(b))
        unequal = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        stop = int(unequal[0]) if len(unequal) else n
        a, b = a[: len(a) - stop], b[: len(b) - stop]
        if max(len(a), len(b)) <= most:
            out[i] = True
            continue
        if not len(a) or not len(b):
            continue
        both, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        shared = np.minimum(np.bincount(at[: len(a)], minlength=len(both)), np.bincount(at[len(a) :], minlength=len(both))).sum()
        if max(len(a), len(b)) - shared <= most:
            left.append((i, a, b, most))
    band = 16
    while left:
        left.sort(key=lambda x: len(x[1]))
        again, k = [], 0
        while k < len(left):
            end = min(len(left), k + 256)
            while end > k + 1 and (end - k) * (len(left[end - 1][1]) + 4 * band) > 2_000_000:
                end = k + (end - k) // 2
            part = left[k:end]
            own = min(band, max(x[3] for x in part))
            found = distance_in_band([x[1] for x in part], [x[2] for x in part], own)
            for x, d in zip(part, found):
                if d <= min(own, x[3]):
                    out[x[0]] = True
                elif own < x[3]:
                    again.append(x)
            k = end
        left, band = again, band * 2
    return out


def _verify(similarity: float):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                # views of the batch's own memory: words are long, so they are not copied
                a, b = ([np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(c)] for c in ("words_u", "words_v"))
                ok = pa.array(near(list(zip(a, b)), similarity))
                yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], names=["u", "v"])

    return run


def word_bits(words: list[np.ndarray]) -> np.ndarray:
    """Documents by 64-bit parts of a set of hashed occurrence-labelled words, wide enough that most words have a bit of their own."""
    counts = np.array([len(w) for w in words])
    labelled, _ = labelled_kmers(np.concatenate(words).astype(np.uint64), counts, 1)
    wide = min(1 << 15, max(1 << 9, 1 << (8 * int(counts.max(initial=1)) - 1).bit_length()))
    out = np.zeros((len(words), wide // 8), np.uint8)
    stops = np.cumsum(counts)
    for i, (a, b) in enumerate(zip(stops - counts, stops)):
        row = np.zeros(wide, bool)
        row[(labelled[a:b] % np.uint64(wide)).astype(np.int64)] = True
        out[i] = np.packbits(row)
    return out.view(np.uint64)


def _open_pairs(part: np.ndarray, i: int, j: int, most_at_once: int = 1 << 18):
    """Pairs of places in a group: of one part all, of two parts those across."""
    left = np.flatnonzero(part == i)
    right = left if i == j else np.flatnonzero(part == j)
    rows = max(1, most_at_once // max(1, len(right)))
    for k in range(0, len(left), rows):
        x, y = np.repeat(left[k : k + rows], len(right)), np.tile(right, len(left[k : k + rows]))
        yield (x[x < y], y[x < y]) if i == j else (x, y)


def links_within(bucket: int, i: int, j: int, node: np.ndarray, component: np.ndarray, part: np.ndarray, words: list[np.ndarray], sketch: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of a forest that connects what near pairs of one bucket part (or two) connect.

    A pair is answered in the first sketch's bucket in which it meets only; in those of deletion variants if it shares no sketch.
    """
    size = np.array([len(w) for w in words])
    bits, label = None, np.unique(component, return_inverse=True)[1]
    earlier = int((sketch[0] == bucket).argmax()) if bucket & 1 else sketch.shape[1]
    out: list[tuple[int, int]] = []
    for x, y in _open_pairs(part, i, j):
        most = ((1 - similarity) * np.maximum(size[x], size[y]) + 1e-9).astype(np.int64)
        ok = (label[x] != label[y]) & (np.abs(size[x] - size[y]) <= most)
        x, y, most = x[ok], y[ok], most[ok]
        if not len(x):
            continue
        bits = word_bits(words) if bits is None else bits
        step = max(1, (1 << 18) // bits.shape[1])
        for k in range(0, len(x), step):
            a, b, limit = x[k : k + step], y[k : k + step], most[k : k + step]
            own, other = bits[a], bits[b]
            ok = np.bitwise_count(own & ~other).sum(1, dtype=np.int64) <= limit
            ok &= np.bitwise_count(other & ~own).sum(1, dtype=np.int64) <= limit
            a, b = a[ok], b[ok]
            met = ((sketch[a, :earlier] == sketch[b, :earlier]) & (sketch[a, :earlier] != 0)).any(1)
            a, b = a[~met], b[~met]
            while len(a):
                now = label[a] != label[b]  # links found so far may have connected them
                a, b = a[now], b[now]
                found = near([(words[p], words[q]) for p, q in zip(a[:1024], b[:1024])], similarity)
                for p, q in zip(a[:1024][found], b[:1024][found]):
                    if label[p] != label[q]:
                        label[label == label[q]] = label[p]
                        out.append((int(node[p]), int(node[q])))
                a, b = a[1024:], b[1024:]
    return out


def _within_buckets(similarity: float):
    """Sorted rows of bucket parts to the links found in them."""

    def run(batches):
        import pyarrow as pa

        names = ("bucket", "i", "j", "node", "component", "part")

        def answer(rows):
            if len(rows[0]) < 2:
                return []
            words = [np.frombuffer(w, "<u4") for w in rows[6]]
            sketch = np.frombuffer(b"".join(rows[7]), np.int64).reshape(len(words), -1)
            return links_within(int(rows[0][0]), int(rows[1][0]), int(rows[2][0]), *rows[3:6], words, sketch, similarity)

        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in names] + [np.array([*batch.column(c).to_pylist(), None], dtype=object)[:-1] for c in ("words", "sketch")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in now[:3]])) + 1
            starts = [0, *change.tolist()]
            found = [e for a, b in zip(starts, starts[1:]) for e in answer([c[a:b] for c in now])]
            held = [c[starts[-1] :] for c in now]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])
        found = answer(held) if held is not None else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["u", "v"])

    return run


def text_digest(text: Column) -> Column:
    """128 bits that equal texts share; null for null."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def near_texts(texts: DataFrame, similarity: float = SIMILARITY, block: int = 2048, block_words: int = 2_000_000) -> DataFrame:
    """(digest, component) of every distinct text in the column text; near texts have one component, a long.

    digest is text_digest; null texts are left out. Words end at white space and ASCII punctuation.
    Texts without words are near nothing. A part of a bucket that is compared with another in one
    task has about `block` texts and `block_words` words at most.
    """
    narrow = texts.select(F.col("text").cast("string").alias("text")).where("text is not null").withColumn("digest", text_digest(F.col("text")))
    sketched = narrow.mapInArrow(returning(_sketch(similarity)), "digest binary, size int, sketch binary, variants binary")
    classes = sketched.groupBy("digest").agg(*(F.min(c).alias(c) for c in ("size", "sketch", "variants")))
    classes = materialize(classes, "classes", "node")
    buckets = classes.where("sketch is not null").select("node", "sketch", "variants").mapInArrow(returning(_buckets), "bucket long, node long")
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialize(buckets.join(shared, "bucket"), "members")
    pairs = members.where("node <> low").groupBy(F.col("low").alias("u"), F.col("node").alias("v")).agg(F.count(F.lit(1)).alias("agree"))
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    wanted = classes.select("digest", "node").join(ids, "node", "left_semi")
    # copies go in the tasks that read them; one plan at every size: the wanted ones grow with the corpus, so they are never broadcast
    words = narrow.groupBy("digest").agg(F.first("text").alias("text")).join(wanted.hint("merge"), "digest")
    words = materialize(words.select("node", "text").mapInArrow(returning(_words), "node long, words binary"), "words")

    def linked(found: DataFrame) -> DataFrame:
        left = words.select(F.col("node").alias("u"), F.col("words").alias("words_u"))
        right = words.select(F.col("node").alias("v"), F.col("words").alias("words_v"))
        return found.join(left, "u").join(right, "v").select("u", "v", "words_u", "words_v").mapInArrow(returning(_verify(similarity)), "u long, v long")

    best = pairs.groupBy("v").agg(F.max_by("u", F.struct("agree", -F.col("u"))).alias("u")).select("u", "v")
    first = connected_components(linked(best))
    # what the likeliest partner has not connected
    own = first.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    other = first.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    open_ = pairs.select("u", "v").join(own, "u", "left").join(other, "v", "left").where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
    more = linked(open_.join(best, ["u", "v"], "left_anti"))
    # pairs with the smallest of a bucket are answered by these
    rest = members.where("members > 2 and node <> low").select("bucket", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = materialize(rest.join(classes.select("node", "size"), "node"), "rest")
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_w")).where("_a < _b")
    mixed = mixed.select("bucket", F.greatest(F.ceil(F.col("_n") / block), F.ceil(F.col("_w") / block_words)).cast("int").alias("parts"))
    put = rest.drop("size").join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    put = put.join(words, "node").join(classes.select("node", "sketch"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    put = put.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "component", "part", "words", "sketch")
    key = ["bucket", "i", "j"]
    late = put.repartition(*key).sortWithinPartitions(*key).mapInArrow(returning(_within_buckets(similarity)), "u long, v long")
    components = connected_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more).union(late))
    return classes.select("digest", "node").join(components, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))


def near_documents(docs: DataFrame, similarity: float = SIMILARITY, block: int = 2048) -> DataFrame:
    """(doc_id, class_id, group_id, kept) of every row.

    class_id is the smallest doc_id of the same text, group_id the smallest that links reach, and the
    rows of that id in the group are kept. Null texts are alone; equal empty texts are one class; texts
    without words link only with equal texts; rows without an id are kept, have null ids and connect
    nothing. Repeated rows give rows each. An id may have several texts, each in a group of its own.
    Only doc_id and text are looked at; an empty table stays empty. Long texts count whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = near_texts(rows.where("doc_id is not null"), similarity, block)
    narrow = rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), text_digest(F.col("text"))).alias("digest"))
    classes = narrow.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id")).join(texts, "digest")
    classes = materialize(classes, "class-ids")
    known = classes.join(classes.groupBy("component").agg(F.min("class_id").alias("group_id")), "component").select("digest", "class_id", "group_id")
    out = narrow.join(known, "digest", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("group_id")))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by edit similarity of 0.8 or more over words."""
    return near_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op6_order_minhash": op6_order_minhash}
ORACLES: dict[str, str] = {}
