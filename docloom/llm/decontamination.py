"""Benchmark passages in documents, by a distributed positional inverted index.

The index is stored in segments of some million words. A segment numbers the words of its documents one
after another, a number apart between documents, so that no phrase spans two; for each term it has one
row with all places of the term. Test items go to the segments that hold the globally rarest term of
some window of theirs; there, each window starts from the places of its rarest term and meets the lists
of its other terms, adjusted by their offsets in the window, in order of rarity. What is left are exact
occurrences: no text is read again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import materialize, returning, table

#: Words are made of what this leaves: digits, letters, all that is not ASCII.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WORD_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Words of a segment, unless one document has more. It bounds what a task holds at once.
SEGMENT_WORDS = 4_000_000
#: Terms of the test set are sent to all tasks up to so many bytes, and joined by shuffle beyond.
TERM_BYTES = 32 << 20
#: Places that are looked up at once in a segment.
PORTION = 1_000_000

INDEX = "segment long, term string, n long, places binary, doc_id long, `first` long"
MATCHES = "segment long, `first` long, doc_id long, item string, `start` long, length long"


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of docs (doc_id, text): see INDEX.

    Rows with a term hold its places in the segment, as differences in 32 bits; rows without one are
    the documents, every row of docs one, with their first place and number of words. Null texts have
    no words; ids may be null or repeat.
    """

    def segments(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from docloom.llm.words import byte_kinds, codes_of, stable_order, words_of

        kinds, number = byte_kinds(SEPARATORS), TaskContext.get().partitionId() << 32
        names = ["segment", "term", "n", "places", "doc_id", "first"]
        held, ids, counts, size = [], [], [], 0

        def flush():
            nonlocal number, size
            codes, terms = codes_of(held)
            n = np.concatenate(counts)
            first = np.cumsum(n + 1) - n - 1
            places = np.arange(len(codes)) + np.repeat(np.arange(len(n)), n)
            order = stable_order(codes)
            df = np.bincount(codes, minlength=len(terms))
            ends = np.cumsum(df)
            places = places[order]
            steps = np.diff(places, prepend=0)
            steps[(ends - df)[df > 0]] = places[(ends - df)[df > 0]]
            bounds = np.zeros(len(terms) + 1, dtype=np.int64)
            bounds[1:] = 4 * ends
            blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(terms), [None, pa.py_buffer(bounds), pa.py_buffer(steps.astype("<u4"))])
            doc_ids = pa.chunked_array(ids).combine_chunks()
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                none = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), some.cast(pa.string()), pa.array(df[at : at + 50_000]), blob[at : at + 50_000].cast(pa.binary()), none, none], names=names)
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), pa.nulls(k, pa.string()), pa.array(n), pa.nulls(k, pa.binary()), doc_ids, pa.array(first)], names=names)
            number, size = number + 1, 0
            for x in (held, ids, counts):
                x.clear()

        for batch in batches:
            found = words_of(batch.column(1), kinds)
            held.append(found.words)
            ids.append(batch.column(0))
            counts.append(np.bincount(found.doc, minlength=batch.num_rows))
            size += len(found.words) + batch.num_rows
            if size >= SEGMENT_WORDS:
                yield from flush()
        if ids:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(returning(segments), INDEX), "positions")


def words_column(text: Column) -> Column:
    """The words of a text, as the index has them; a null text has none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(WORD_PATTERN), F.lit(0))


def _bounded(df: DataFrame, *columns: str) -> DataFrame:
    """df for a join that sends it to all tasks if it is small, by the bytes of these columns."""
    size = df.agg(F.coalesce(F.sum(sum(F.octet_length(c) + 40 for c in columns)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= TERM_BYTES else df


class _Segment:
    """The lists of a segment that its items need, as one sorted array of (term << 32) + place."""

    def __init__(self, rows):
        import pyarrow.compute as pc

        terms, docs = rows.filter(pc.is_valid(rows["term"])), rows.filter(pc.is_null(rows["term"])).sort_by("first")
        self.number = {t: i for i, t in enumerate(terms["term"].to_pylist())}
        self.df = terms["n"].to_numpy()
        steps = np.frombuffer(b"".join(terms["places"].to_pylist()), dtype="<u4").astype(np.int64)
        self.ends = np.cumsum(self.df)
        run, begins = np.cumsum(steps), self.ends - self.df
        base = (run - steps)[begins] if len(steps) else np.zeros(0, dtype=np.int64)
        self.places = run - np.repeat(base, self.df)
        self.keys = (np.repeat(np.arange(len(self.df)), self.df) << 32) + self.places
        self.first, self.n, self.doc_id = docs["first"].to_numpy(), docs["n"].to_numpy(), docs["doc_id"]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = (term << 32) + place
        at = np.searchsorted(self.keys, key)
        return (place >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == key)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.array([self.number.get(w, -1) for w in words], dtype=np.int64)


def _occurrences(segment: _Segment, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every occurrence; windows is a matrix of term numbers, a row each."""
    order = np.argsort(segment.df[windows], axis=1, kind="stable")
    found = []
    rarest = np.take_along_axis(windows, order[:, :1], 1)[:, 0]
    sizes = segment.df[rarest]
    bounds = np.searchsorted(np.cumsum(sizes), np.arange(PORTION, sizes.sum() + PORTION, PORTION))
    begin = 0
    for end in np.unique(np.append(bounds + 1, len(windows)).clip(max=len(windows))):
        rows, n = np.arange(begin, end), sizes[begin:end]
        begin = end
        row = np.repeat(rows, n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = segment.places[(segment.ends - segment.df)[rarest[row]] + inner] - order[row, 0]
        for k in range(1, windows.shape[1]):
            offset = order[row, k]
            keep = segment.has(windows[row, offset], at + offset)
            row, at = row[keep], at[keep]
        if windows.shape[1] == 1:
            keep = at >= 0
            row, at = row[keep], at[keep]
        found.append((row, at))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def _passages(segment: _Segment, words: list[list[str]], window: int | None) -> list[np.ndarray]:
    """item, place and length of the longest passages all of whose windows occur."""
    lengths = np.array([len(w) for w in words])
    flat = segment.numbers([w for item in words for w in item])
    base = np.cumsum(lengths) - lengths
    width = lengths if window is None else np.minimum(lengths, window)
    items, starts, places, widths = [], [], [], []
    for w in np.unique(width[width > 0]):
        of = np.flatnonzero(width == w)
        n = lengths[of] - w + 1
        item = np.repeat(of, n)
        start = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        matrix = flat[(base[item] + start)[:, None] + np.arange(w)]
        there = (matrix >= 0).all(1)
        item, start = item[there], start[there]
        if len(item):
            row, place = _occurrences(segment, matrix[there])
            items.append(item[row])
            starts.append(start[row])
            places.append(place)
            widths.append(np.full(len(row), w))
    if not items:
        return [np.zeros(0, np.int64)] * 3
    item, start, place, w = (np.concatenate(x) for x in (items, starts, places, widths))
    order = np.lexsort((place, place - start, item))  # along diagonals: the same item at the same shift
    item, start, place, w = item[order], start[order], place[order], w[order]
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (place[1:] - start[1:] != place[:-1] - start[:-1]) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(item)) - 1
    return [item[begin], place[begin], place[last] + w[last] - place[begin]]


def _near(segment: _Segment, words: list[list[str]], slack: int) -> list[np.ndarray]:
    """item, place and length of the shortest spans that hold all words of an item, in any order, within its length and slack."""
    items, places, lengths = [], [], []
    for item, phrase in enumerate(words):
        terms, times = np.unique(segment.numbers(phrase), return_counts=True)
        if not len(terms) or terms[0] < 0 or (segment.df[terms] < times).any():
            continue
        widest = len(phrase) + slack
        lists = [segment.places[segment.ends[t] - segment.df[t] : segment.ends[t]] for t in terms]
        start = np.sort(np.concatenate(lists))
        end = np.zeros(len(start), dtype=np.int64)
        for k in np.argsort(segment.df[terms], kind="stable"):  # from the rarest, which leaves few starts for the others
            at = np.searchsorted(lists[k], start) + times[k] - 1
            reached = np.where(at < len(lists[k]), lists[k][np.minimum(at, len(lists[k]) - 1)], np.iinfo(np.int64).max)
            keep = reached - start < widest
            start, end = start[keep], np.maximum(end[keep], reached[keep])
        doc = np.searchsorted(segment.first, start, "right") - 1
        keep = (end < (segment.first + segment.n)[doc]) if len(start) else np.zeros(0, dtype=bool)
        start, end = start[keep], end[keep]
        if len(start):
            shortest = np.append(end[1:] != end[:-1], True)
            items.append(np.full(shortest.sum(), item))
            places.append(start[shortest])
            lengths.append((end - start + 1)[shortest])
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (items, places, lengths)]


def _search(index: DataFrame, items: DataFrame, window: int | None, find) -> DataFrame:
    """find in every segment, for the items that its rarest terms call for."""
    items = materialize(items.select("item", "words").where(F.size("words") > 0), "items")
    word = items.select("item", F.posexplode("words").alias("at", "term"))
    terms = _bounded(materialize(word.select("term").distinct(), "terms"), "term")
    lists = index.where("term is not null")
    df = materialize(lists.select("term", "n").join(terms, "term").groupBy("term").agg(F.sum("n").alias("df")), "frequencies")
    each = word.join(df, "term", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "df", "term"))).alias("all"))
    width = F.size("all") if window is None else F.least(F.size("all"), F.lit(window))
    windows = F.transform(F.sequence(F.lit(1), F.size("all") - width + 1), lambda i: F.slice("all", i, width))
    whole = F.filter(windows, lambda w: F.forall(w, lambda x: x["df"].isNotNull()))
    rarest = F.transform(whole, lambda w: F.array_min(F.transform(w, lambda x: F.struct(x["df"].alias("df"), x["term"].alias("term"))))["term"])
    anchors = materialize(each.select("item", F.explode(F.array_distinct(rarest)).alias("term")), "anchors")
    routes = lists.select("segment", "term").join(_bounded(anchors, "term", "item"), "term").select(F.col("segment").alias("to"), "item").distinct().join(items, "item")
    # only terms of items that have a window whose terms all occur
    live = materialize(word.join(anchors.select("item").distinct(), "item", "left_semi").select("term").distinct(), "live")
    columns = ["segment", "term", "n", "places", "doc_id", "first"]
    needed = lists.join(_bounded(live, "term"), "term", "left_semi").select(*columns).union(index.where("term is null").select(*columns))

    def run(_, rows, wanted):
        import pyarrow as pa

        names = ["segment", "first", "doc_id", "item", "start", "length"]
        schema = pa.schema([("segment", pa.int64()), ("first", pa.int64()), ("doc_id", pa.int64()), ("item", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
        if not wanted.num_rows or not rows.num_rows:
            return schema.empty_table()
        segment = _Segment(rows)
        item, place, length = find(segment, wanted["words"].to_pylist())
        doc = np.searchsorted(segment.first, place, "right") - 1
        first = segment.first[doc] if len(doc) else np.zeros(0, np.int64)
        columns = [pa.array(np.full(len(item), rows["segment"][0].as_py(), dtype=np.int64)), pa.array(first), segment.doc_id.take(pa.array(doc)), wanted["item"].take(pa.array(item)).cast(pa.string()), pa.array(place - first), pa.array(length)]
        return pa.table(columns, names=names).cast(schema)

    return needed.groupBy("segment").cogroup(routes.groupBy("to")).applyInArrow(run, MATCHES)


def phrase_matches(index: DataFrame, items: DataFrame, window: int | None = None) -> DataFrame:
    """Where items (item string, words array) occur in the indexed documents: see MATCHES.

    window: so many consecutive words of an item make an occurrence, all words of an item that has
    fewer; without it, only whole items do. Occurrences that follow one another in item and document
    are one passage. `start` counts the words of the document before it; segment and `first` tell rows
    apart whose doc_id is the same. Items without words match nothing, and no two items may share a key.
    """
    return _search(index, items, window, lambda segment, words: _passages(segment, words, window))


def proximity_matches(index: DataFrame, items: DataFrame, slack: int) -> DataFrame:
    """Spans that hold all words of an item, repeated ones as often, in any order, and at most slack words more: see MATCHES.

    Of spans with one end only the shortest counts.
    """
    return _search(index, items, None, lambda segment, words: _near(segment, words, slack))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Each row of docs with the words that occurrences of benchmark windows cover, and the items they are from.

    Null texts have no words, and no words no windows. Items of the same words are searched once; of
    repeated item_ids one is counted, and an item without an id counts under the empty string. Rows of
    docs that share an id are rated each by its own text. Without documents there are no rows; without
    items none is hit.
    """
    index = build_index(docs)
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_column(F.col("text").cast("string")).alias("words"))
    texts = materialize(texts.withColumn("item", F.sha2(F.array_join("words", " "), 256)), "benchmark")
    items = texts.groupBy("item").agg(F.first("words").alias("words"))
    found = materialize(phrase_matches(index, items, window), "passages")
    row = ["segment", "first"]
    before = Window.partitionBy(*row).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    hits = found.withColumn("new", new).groupBy(*row).agg(F.sum("new").alias("n_hit"))
    named = found.select(*row, "item").distinct().join(texts.select("item", "item_id").distinct(), "item")
    named = named.groupBy(*row).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = index.where("term is null").select(*row, "doc_id", F.col("n").alias("n_words"))
    out = rows.join(hits.join(named, row), row, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, by windows of ten words."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_decontamination": op11_decontamination}
ORACLES = {
    "op11_decontamination": r"""
    WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM lowered),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(words), 10) AS w, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS p FROM b, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS r(i) WHERE len(words) > 0),
    widths AS (SELECT list(DISTINCT w) AS ws FROM bw),
    dl AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l
      FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d)),
    dw AS (SELECT doc_id, i, w, array_to_string(l[1:w], ' ') AS p FROM dl, widths, unnest(ws) AS x(w) WHERE w <= len(l)),
    m AS (SELECT DISTINCT doc_id, item_id, i, dw.w FROM dw JOIN bw ON dw.p = bw.p AND dw.w = bw.w),
    hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, w)) AS r(k) GROUP BY doc_id),
    its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM m GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
      sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
}
