"""Collocations: phrases whose words occur together more than apart, from suffix arrays of word ids.

Texts are stored in shards of one language as streams of word numbers. Words that occur often enough
get numbers for the whole corpus, all others become gaps, since no frequent phrase holds one. In each
shard numpy sorts the suffixes of the stream by prefix doubling, as deep as the longest phrase; runs of
suffixes that share n words (LCP intervals) are the occurrences of a phrase of n words, and their counts
are summed over all shards by phrase. Pairs go first: longer phrases are only looked for where all their
pairs are frequent, which a bitmap of bounded size tells. It may let pairs pass that are not, and their
phrases then fall by their counts; it never stops one that is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import gapless_ranks, materialize, returning, table

BLANKS, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Words of a shard, unless one document has more. It bounds what a task holds at once.
SHARD_WORDS = 1_500_000
#: The bitmap of frequent pairs has 16 bits for each pair, and at most so many.
MOST_BITS = 28
#: Scores are thousandths of a thousandth of twice a phrase's share.
SCALE = 2_000_000

SHARDS = "shard long, lang string, word string, code int, n long, stream binary"


def pack_ints(x: np.ndarray) -> bytes:
    """32-bit integers, compressed: the highest bytes, which are mostly 0, stand together."""
    import pyarrow as pa

    planes = np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_ints(body: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(pa.decompress(body[8:], decompressed_size=4 * n, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").reshape(-1)


def word_streams(docs: DataFrame) -> DataFrame:
    """The stored shards of docs (text, lang): see SHARDS.

    A shard has one row with its stream of word numbers, -1 where a piece or text begins, and one row
    for each distinct word with its number and count. Null texts are empty, a null lang is `und`.
    """

    def shards(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        from docloom.llm.words import byte_kinds, codes_of, words_of

        kinds, number = byte_kinds(BLANKS, STOPS), TaskContext.get().partitionId() << 32
        names = ["shard", "lang", "word", "code", "n", "stream"]
        held: dict[str, list] = {}

        def flush(lang):
            nonlocal number
            words, apart, _ = held.pop(lang)
            codes, distinct = codes_of(words)
            apart = np.concatenate(apart)
            if not len(codes):
                return
            stream = np.full(len(codes) + int(apart.sum()), -1, dtype=np.int32)
            stream[np.arange(len(codes)) + np.cumsum(apart)] = codes
            counts = np.bincount(codes, minlength=len(distinct))
            for at in range(0, len(distinct), 50_000):
                some = distinct[at : at + 50_000].cast(pa.string())
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), pa.array([lang] * k, pa.string()), some, pa.array(np.arange(at, at + k, dtype=np.int32)), pa.array(counts[at : at + k]), pa.nulls(k, pa.binary())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.array([len(codes)], pa.int64()), pa.array([pack_ints(stream)], pa.binary())], names=names)
            number += 1

        for batch in batches:
            langs = batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                found = words_of(batch.column(0).filter(pc.equal(langs, lang)), kinds)
                words, apart, n = held.setdefault(lang, ([], [], [0]))
                words.append(found.words)
                apart.append(found.apart)
                n[0] += len(found.words)
                if n[0] >= SHARD_WORDS:
                    yield from flush(lang)
        for lang in [*held]:
            yield from flush(lang)

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    return materialize(rows.mapInArrow(returning(shards), SHARDS), "shards")


def suffix_ranks(ids: np.ndarray, depth: int) -> np.ndarray:
    """The rank of every suffix by its first `depth` words (a power of two), by prefix doubling. What is beyond the end is 0."""
    rank, h = ids.astype(np.int64), 1
    while h < depth:
        after = np.zeros_like(rank)
        after[:-h] = rank[h:]
        rank = np.unique(rank * (rank.max(initial=0) + 1) + after, return_inverse=True)[1]
        h *= 2
    return rank


def count_phrases(ids: np.ndarray, least: int, most: int, pair_passes=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n from least to most, the distinct phrases of n words in ids (0 is a gap) as a matrix, and their counts.

    The suffix array holds the suffixes that begin with a phrase; pair_passes says which neighbours may be in one.
    """
    size = len(ids)
    pairs = np.zeros(size, dtype=bool)
    pairs[:-1] = (ids[:-1] > 0) & (ids[1:] > 0)
    if pair_passes is not None:
        at = np.flatnonzero(pairs)
        pairs[at] = pair_passes((ids[at].astype(np.int64) << 32) + ids[at + 1])
    runs = {1: ids > 0, 2: pairs}  # where n words in a row may be a phrase
    for n in range(3, most + 1):
        runs[n] = np.zeros(size, dtype=bool)
        runs[n][:-1] = runs[n - 1][1:] & pairs[:-1]
    depth = 1
    while depth < most:
        depth *= 2
    starts = np.flatnonzero(runs[least])
    if not len(starts):
        return [(np.zeros((0, n), dtype=np.int32), np.zeros(0, dtype=np.int64)) for n in range(least, most + 1)]
    if depth > 1:  # the last doubling is only for suffixes in the array
        rank = suffix_ranks(ids, depth // 2)
        after = np.zeros_like(rank)
        after[: -(depth // 2)] = rank[depth // 2 :]
        order = starts[np.argsort(rank[starts] * (rank.max() + 1) + after[starts])]
    else:
        order = starts[np.argsort(ids[starts])]
    words = np.zeros((len(order), most), dtype=np.int32)
    for k in range(most):
        inside = order + k < size
        words[inside, k] = ids[order[inside] + k]
    lcp = np.zeros(len(order), dtype=np.int8)  # words shared with the suffix before
    same = np.ones(len(order) - 1, dtype=bool)
    for k in range(most):
        same &= words[1:, k] == words[:-1, k]
        lcp[1:] += same
    out = []
    for n in range(least, most + 1):
        begins = np.flatnonzero(lcp < n)
        counts = np.diff(np.append(begins, len(order)))
        whole = runs[n][order[begins]]  # the same for all of an interval
        out.append((words[begins[whole], :n], counts[whole]))
    return out


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two bits of the bitmap for each pair."""
    mixed = keys.astype(np.uint64)
    first = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    second = (first ^ (first >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.stack([first >> np.uint64(64 - bits), second >> np.uint64(64 - bits)])


def pair_bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits in which the two slots of every pair (column k1) are set.

    Tasks set their words of 64 bits, which are merged by word; the driver receives at most 2**bits / 64 of them.
    """

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            slot = np.unique(_slots(batch.column(0).to_numpy(), bits).ravel())
            word = (slot >> np.uint64(6)).astype(np.int64)
            begin = np.flatnonzero(np.diff(word, prepend=-1))
            value = np.bitwise_or.reduceat(np.uint64(1) << (slot & np.uint64(63)), begin) if len(slot) else slot
            yield pa.RecordBatch.from_arrays([pa.array(word[begin]), pa.array(value.view(np.int64))], names=["word", "value"])

    merged = pairs.select("k1").mapInArrow(returning(words), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), dtype=np.uint64)
    bitmap[merged["word"].to_numpy()] = merged["value"].to_numpy().view(np.uint64)
    return bitmap


def phrase_counts(streams: DataFrame, least: int, most: int, bitmap=None, bits: int = 0) -> DataFrame:
    """(k1, k2, n) of each shard's phrases of least to most words, of two to four: up to four word ids of 32 bits, 0 beyond the phrase."""

    def count(batches):
        import pyarrow as pa

        def passes(keys):
            slots = _slots(keys, bits)
            kept = bitmap.value[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))
            return (kept & np.uint64(1)).all(0)

        for batch in batches:
            for body in batch.column(0).to_pylist():
                for words, n in count_phrases(unpack_ints(body), least, most, passes if bitmap is not None else None):
                    full = np.zeros((len(words), 4), dtype=np.int64)
                    full[:, : words.shape[1]] = words
                    keys = full[:, ::2] << 32 | full[:, 1::2]
                    for at in range(0, len(n), 100_000):
                        part = slice(at, at + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(keys[part, 0]), pa.array(keys[part, 1]), pa.array(n[part])], names=["k1", "k2", "n"])

    return streams.select("ids").mapInArrow(returning(count), "k1 long, k2 long, n long")


def frequent_phrases(docs: DataFrame, least: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All phrases of one to four words that occur `least` times or more in a language: (words, phrases, totals).

    words has id, lang, word and f, phrases the ids and f, and totals the number n of all words of a
    lang; a phrase's words are all of one language.
    """
    shards = word_streams(docs)
    totals = shards.where("word is null").groupBy("lang").agg(F.sum("n").alias("n"))
    words = shards.where("word is not null")
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    often = gapless_ranks(materialize(often.withColumn("all", F.lit(0)), "often", "row"), "all", "row", [], "id")
    often = materialize(often.select((F.col("id") + 1).cast("int").alias("id"), "lang", "word", "f"), "words")
    local = words.join(often, ["lang", "word"]).select(F.col("shard").alias("of"), "code", "id")

    def number(_, rows, known):
        import pyarrow as pa

        code, ids = known["code"].to_numpy(), known["id"].to_numpy()
        out = []
        for body in rows["stream"].to_pylist():
            stream = unpack_ints(body)
            to = np.zeros(stream.max() + 2, dtype=np.int32)  # the last, which -1 finds, stays 0
            to[code] = ids
            out.append(pack_ints(to[stream]))
        return pa.table({"ids": pa.array(out, pa.binary())})

    bodies = shards.where("word is null").select("shard", "stream")
    streams = materialize(bodies.groupBy("shard").cogroup(local.groupBy("of")).applyInArrow(number, "ids binary"), "streams")
    pairs = phrase_counts(streams, 2, 2).groupBy("k1").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    pairs = materialize(pairs, "pairs")
    bits = min(MOST_BITS, max(10, (16 * pairs.count()).bit_length()))
    bitmap = docs.sparkSession.sparkContext.broadcast(pair_bitmap(pairs, bits))
    longer = phrase_counts(streams, 3, 4, bitmap, bits).groupBy("k1", "k2").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    every = pairs.select("k1", F.lit(0).cast("long").alias("k2"), "f").union(longer)
    halves = [F.shiftrightunsigned("k1", 32), F.col("k1").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("k2", 32), F.col("k2").bitwiseAND(F.lit(0xFFFFFFFF))]
    ids = F.filter(F.array(*(x.cast("int") for x in halves)), lambda x: x > 0)
    return often, materialize(every.select(ids.alias("ids"), "f"), "phrases"), totals


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """The `top` phrases of two to four words of each language that occur `least` times or more, by score.

    Cutting a phrase after its first k words gives parts that occur l and r times; its score is the
    lowest floor(2000000 a / (l + r)), of the smallest k where cuts tie. Phrases that a longer one
    holds, which occurs at least share % as often, are dropped. Null texts are empty and have no words;
    a null lang is `und`; repeated rows count each. An empty table gives no rows. Ties go to the more
    frequent phrase, then to the smaller one in UTF-8.
    """
    words, phrases, totals = frequent_phrases(docs, least)
    counts = words.select(F.array("id").alias("part"), "f", "lang").union(phrases.select("ids", "f", F.lit(None).cast("string")))
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.slice("ids", F.lit(1), F.col("k"))).withColumn("tail", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    cuts = cuts.join(counts.select(F.col("part").alias("head"), F.col("f").alias("l"), "lang"), "head").join(counts.select(F.col("part").alias("tail"), F.col("f").alias("r")), "tail")
    whole = "decimal(38,0)"
    score = F.expr(f"cast(({SCALE} * cast(a as {whole})) div (cast(l as {whole}) + r) as long)")
    # a cut after one word finds it with its language
    scored = cuts.withColumn("score", score).groupBy("ids").agg(F.first("a").alias("a"), F.max("lang").alias("lang"), F.min(F.struct("score", "k", "l", "r")).alias("low"))
    parts = phrases.where(F.size("ids") > 2).select("f", F.explode(F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), i -> slice(ids, i, n))))")).alias("ids"))
    held = parts.groupBy("ids").agg(F.max("f").alias("longer"))
    scored = scored.join(held, "ids", "left").where(f"longer is null or 100 * cast(longer as {whole}) < {share} * cast(a as {whole})")
    scored = scored.select("ids", "lang", "a", "low.score", "low.l", "low.r")
    # phrases that tie with the last one stay until their words decide
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = materialize(scored.withColumn("_rank", F.rank().over(by_score)).where(F.col("_rank") <= top).drop("_rank"), "first")
    spelled = first.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = first.join(spelled, "ids").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language, over all documents."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {
    "op12_collocations": r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
    p AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d, unnest(pieces) AS x(piece)),
    w AS (SELECT pid, lang, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM p),
    g AS (SELECT lang, w, w || ' ' || lead(w, 1) OVER piece AS w2, w || ' ' || lead(w, 1) OVER piece || ' ' || lead(w, 2) OVER piece AS w3,
            w || ' ' || lead(w, 1) OVER piece || ' ' || lead(w, 2) OVER piece || ' ' || lead(w, 3) OVER piece AS w4 FROM w WINDOW piece AS (PARTITION BY pid ORDER BY i)),
    f AS (SELECT lang, size, phrase, count(*) AS f FROM (SELECT lang, unnest([1, 2, 3, 4]) AS size, unnest([w, w2, w3, w4]) AS phrase FROM g) WHERE phrase IS NOT NULL GROUP BY ALL),
    totals AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE size > 1 AND f >= 30),
    cuts AS (SELECT c.lang, c.phrase, size, k, a, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail FROM c, unnest(range(1, size)) AS x(k)),
    scored AS (SELECT cuts.lang, cuts.phrase, cuts.size, k, a, h.f AS l, t.f AS r, (2000000 * a::HUGEINT) // (h.f + t.f) AS score
      FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
    low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    parts AS (SELECT lang, array_to_string(words[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM c, unnest(range(2, size)) AS x(m), unnest(range(1, size - m + 2)) AS y(i) GROUP BY ALL),
    ranked AS (SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
      FROM low LEFT JOIN parts ON parts.lang = low.lang AND parts.phrase = low.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
    SELECT ranked.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
    """,
}
