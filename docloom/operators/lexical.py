"""An inverted index in files, and BM25 over it for all queries at once.

Below its path an index has

* ``postings/_segment=s/_part=p``: term, document, group, tf, dl, sorted by term. A term's part is a hash of it, so a
  search that joins on segment, part and term reads the parts of its terms alone (dynamic partition pruning). Part -1 has
  one row for each document, without a term.
* ``terms/_segment=s``: for each term and group its part, df, occurrences, largest tf and smallest dl, which bound every gain in them.
* ``documents/_segment=s``: documents, lengths and a digest of the texts by group; ``files/_segment=s``: what was read.
* ``manifest``: the segments of each version, written last, so that what is half written is never read.

Segments are appended and merged; they never change.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.storage import materialize, new_path

K1, B = 1.2, 0.75
#: Documents for one part of a segment, within bounds.
DOCUMENTS_A_PART, LEAST_PARTS, MOST_PARTS = 20_000, 8, 4096
#: Pairs of a query and a posting, for each core, up to which all are added up.
DIRECT_PAIRS = 10_000_000
#: Scores are compared with bounds up to this, which is more than sums of doubles differ by.
SLACK = 1e-6
MANIFEST = "version long, segment long, doc string, doc_type string, grouped boolean, documents long, digest decimal(38,0)"
TABLES = {
    "postings": "term string, `{doc}` {doc_type}, `group` string, tf long, dl long, _segment int, _part int",
    "terms": "part int, term string, `group` string, df long, cf long, most_tf long, least_dl long, _segment int",
    "documents": "`group` string, n long, length long, digest decimal(38,0), _segment int",
    "files": "file string, size long, changed timestamp, _segment int",
}


def top_k(rows: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes before the shuffle to k a task and group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


@dataclass(frozen=True)
class LexicalIndex:
    """A version of a stored index. doc: the name of the document column; grouped: whether postings have a group."""

    spark: SparkSession
    path: str
    doc: str
    doc_type: str
    version: int
    segments: tuple[int, ...]
    grouped: bool
    documents: int
    average_length: float
    digest: int

    def table(self, name: str) -> DataFrame:
        """A table of the index, of this version's segments."""
        schema = TABLES[name].format(doc=self.doc, doc_type=self.doc_type)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/_segment={s}" for s in self.segments))

    @property
    def postings(self) -> DataFrame:
        return self.table("postings").where("_part >= 0")

    def statistics(self) -> DataFrame:
        """n and avgdl of each group."""
        return self.table("documents").groupBy("group").agg(F.sum("n").alias("n"), (F.coalesce(F.sum("length"), F.lit(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("avgdl"))

    def save(self, path: str) -> None:
        """A copy of this version below another path, as one segment."""
        _store(self.spark, path, self.table("postings"), self.doc, self.grouped, self.table("files").drop("_segment"), 1, ())


def source_digest(docs: DataFrame, doc: str, text: str) -> tuple[int, int]:
    """Number of rows, and the sum of a hash of each row's id and text: another order gives the same, another text does not."""
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(doc, text).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return n, int(total)


def _counts(docs: DataFrame, doc: str, text: str, group: str | None) -> DataFrame:
    """(term, doc, group, dl, tf) of all terms, and for each document a row without a term whose tf is a hash of it.

    n tokens have n - 1 pairs, so lengths need no pairs. Counting begins in the tasks that read the texts.
    """
    by = F.col(group).cast("string") if group else F.lit(None).cast("string")
    tokens = docs.select(F.col(doc), by.alias("group"), F.xxhash64(doc, text).alias("mark"), T.lexical_tokens(T.normal_form(F.col(text)), lower=False).alias("_t"))
    tokens = tokens.withColumn("dl", F.greatest(2 * F.size("_t").cast("long") - 1, F.lit(0)))
    terms = tokens.select(doc, "group", "dl", "mark", F.explode(F.concat(F.array(F.lit(None).cast("string")), "_t", T.neighbours(F.col("_t")))).alias("term"))
    terms = terms.withColumn("mark", F.when(F.col("term").isNull(), F.col("mark")))
    counted = terms.groupBy("term", doc, "group", "dl", "mark").agg(F.count(F.lit(1)).alias("tf"))
    return counted.select("term", doc, "group", F.coalesce("mark", "tf").alias("tf"), "dl")


def _store(spark: SparkSession, path: str, counted: DataFrame, doc: str, grouped: bool, files: DataFrame | None, version: int, older: tuple[int, ...], documents: int | None = None) -> LexicalIndex:
    """Write counted as a new segment, and a version of it and the older ones."""
    index = LexicalIndex(spark, path, doc, dict(counted.dtypes)[doc], version, (version,), grouped, 0, 0.0, 0)
    at = f"_segment={version}"
    if documents is None:
        documents = counted.where("term is null").count()
    parts = min(MOST_PARTS, max(LEAST_PARTS, -(-documents // DOCUMENTS_A_PART)))
    part = F.when(F.col("term").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    placed = counted.select("term", doc, "group", "tf", "dl", part.alias("_part"))
    # parts that hold hot terms are split over as many tasks and files as their bytes need
    placed.hint("rebalance", F.col("_part")).sortWithinPartitions("_part", "term").write.partitionBy("_part").parquet(f"{path}/postings/{at}")
    known = index.postings.groupBy(F.col("_part").alias("part"), "term", "group")
    known.agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl")).write.parquet(f"{path}/terms/{at}")
    sums = index.table("postings").where("_part = -1").groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("length"), F.sum(F.col("tf").cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest"))
    sums.coalesce(1).write.parquet(f"{path}/documents/{at}")
    (files if files is not None else spark.createDataFrame([], "file string, size long, changed timestamp")).write.parquet(f"{path}/files/{at}")
    index = _with_sums(replace(index, segments=(*older, version)))
    rows = [(version, s, doc, index.doc_type, grouped, index.documents, Decimal(index.digest)) for s in index.segments]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return index


def _with_sums(index: LexicalIndex) -> LexicalIndex:
    n, length, digest = index.table("documents").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.sum("digest"), F.lit(0).cast("decimal(38,0)"))).first()
    return replace(index, documents=n, average_length=length / max(n, 1), digest=int(digest))


def build_index(docs: DataFrame, doc: str = "doc_id", text: str = "text", group: str | None = None, path: str | None = None) -> LexicalIndex:
    """The index of all documents in one segment, below path or the session's shared folder.

    Ids are unique; rows that share one would count as one document in scores and as several in df.
    group: a column, such as the language, by which searches may be routed; each group has statistics of its own.
    """
    spark = docs.sparkSession
    return _store(spark, path or new_path(spark, "lexical"), _counts(docs, doc, text, group), doc, group is not None, None, 1, (), docs.count())


def append_documents(index: LexicalIndex, docs: DataFrame, text: str = "text", group: str | None = None, files: DataFrame | None = None) -> LexicalIndex:
    """A version with one more segment, of docs, whose ids are new. What is stored is not read again but for its statistics."""
    if index.grouped != (group is not None):
        raise ValueError("all segments have groups or none has")
    return _store(index.spark, index.path, _counts(docs, index.doc, text, group), index.doc, index.grouped, files, index.version + 1, index.segments, docs.count())


def merge_segments(index: LexicalIndex) -> LexicalIndex:
    """A version whose segments are one; texts are not read again."""
    return _store(index.spark, index.path, index.table("postings"), index.doc, index.grouped, index.table("files").drop("_segment"), index.version + 1, (), index.documents)


def part_of(index: LexicalIndex, keys: DataFrame) -> LexicalIndex:
    """The index of the documents of keys (a column as index.doc), with statistics of its own; texts are not read again."""
    found = index.table("postings").join(keys.select(index.doc).distinct(), index.doc, "left_semi")
    return _store(index.spark, new_path(index.spark, "lexical"), found, index.doc, index.grouped, None, 1, ())


def open_index(spark: SparkSession, path: str, documents: int | None = None, source: DataFrame | None = None, text: str = "text") -> LexicalIndex:
    """The last version of a stored index.

    documents: how many the corpus has; source: the corpus itself. An index of another number, or of
    other ids or texts, is refused.
    """
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    last = rows.join(rows.agg(F.max("version").alias("version")), "version").orderBy("segment").collect()
    if not last:
        raise ValueError(f"no index at {path}")
    one = last[0]
    if documents is not None and one.documents != documents:
        raise ValueError(f"the index at {path} is of {one.documents} documents, not {documents}")
    if source is not None and (found := source_digest(source, one.doc, text)) != (one.documents, int(one.digest)):
        raise ValueError(f"the index at {path} is of other texts: {one.documents} documents and digest {one.digest}, not {found}")
    return _with_sums(LexicalIndex(spark, path, one.doc, one.doc_type, one.version, tuple(r.segment for r in last), one.grouped, one.documents, 0.0, int(one.digest)))


def source_files(docs: DataFrame) -> DataFrame:
    """(file, size, changed) of the files that a table is read from."""
    return docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed")).distinct()


def current_index(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", group: str | None = None) -> LexicalIndex:
    """The index at path, brought up to the files of docs (a table as read from files).

    New files become a new segment; where a file has gone or changed, all are indexed anew.
    """
    spark = docs.sparkSession
    files = materialize(source_files(docs), "files")
    try:
        index = open_index(spark, path)
    except (AnalysisException, ValueError):  # none yet
        index = None
    if index is not None:
        held = index.table("files").drop("_segment")
        if not held.join(files, ["file", "size", "changed"], "left_anti").limit(1).count():
            new = files.join(held, ["file", "size", "changed"], "left_anti")
            if not new.limit(1).count():
                return index
            added = docs.select("*", F.col("_metadata.file_path").alias("_file")).join(new.select(F.col("file").alias("_file")), "_file", "left_semi")
            return append_documents(index, added, text, group, new)
    version = index.version + 1 if index is not None else 1
    return _store(spark, path, _counts(docs, doc, text, group), doc, group is not None, files, version, (), docs.count())


#: By application and table: the path of its index, the digest of its files when it was last opened, and the index.
_OPEN: dict[tuple[str, str], tuple[str, tuple, LexicalIndex]] = {}


def index_of(docs: DataFrame, name: str, doc: str = "doc_id", text: str = "text", group: str | None = None) -> LexicalIndex:
    """current_index of a table, kept by name for the application and opened again only when the table's files are others.

    It is below spark.docloom.index.dir, where it outlives the session, or else in the shared folder, where it does not.
    """
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, name)
    seen = tuple(source_files(docs).agg(F.count(F.lit(1)), F.sum(F.xxhash64("file", "size", "changed").cast("decimal(38,0)"))).first())
    if key not in _OPEN or _OPEN[key][1] != seen:
        kept = spark.conf.get("spark.docloom.index.dir", None)
        path = _OPEN[key][0] if key in _OPEN else f"{kept.rstrip('/')}/{spark.range(1).select(F.sha2(F.lit(name), 256)).first()[0][:32]}" if kept else new_path(spark, "lexical")
        _OPEN[key] = (path, seen, current_index(docs, path, doc, text, group))
    return _OPEN[key][2]


def query_terms(queries: DataFrame, query: str, text: str, route: str | None = None) -> DataFrame:
    tokens = T.lexical_tokens(T.normal_form(F.col(text)), bigrams=True, lower=False)
    return queries.select(query, *([F.col(route).cast("string").alias("group")] if route else []), F.explode(F.array_distinct(tokens)).alias("term"))


def search_index(
    index: LexicalIndex, queries: DataFrame, query: str, k: int, query_text: str = "text", exclude_self: bool = False, k1: float = K1, b: float = B, route: str | None = None
) -> DataFrame:
    """(query, rank, doc, score): documents with a term of the query, by score and then id.

    route: a column of queries that names the group each row searches; ranks are then within query and
    group, which is a column of the result, and statistics are the group's own.

    Exact, without meeting every posting of common words: a query's rarest terms give k documents and
    so a score that the k best reach. Terms whose bounds together stay below it cannot alone bring a
    document in. Documents are found by the other terms, those that cannot reach the score with the
    bounds of the rest go, and only the remaining ones look up the common terms. Where all pairs of
    query and posting are few for the cluster's cores, they are simply added up, which takes fewer jobs.
    """
    doc, by = index.doc, [query, "group"] if route else [query]
    on = ["group", "term"] if route else ["term"]
    asked = materialize(query_terms(queries, query, query_text, route), "asked")
    there = index.table("terms").join(asked.select(*on).distinct(), on)
    each = Window.partitionBy(*on)  # the rows of a term: a few for each segment
    there = there.select("_segment", F.col("part").alias("_part"), *on, F.sum("df").over(each).alias("n_docs"), F.max("most_tf").over(each).alias("tf"), F.min("least_dl").over(each).alias("dl")).distinct()
    if route:
        there = there.join(index.statistics(), "group")
    else:
        there = there.withColumn("n", F.lit(index.documents)).withColumn("avgdl", F.lit(index.average_length))
    idf = F.log(1 + (F.col("n").cast("double") - F.col("n_docs") + 0.5) / (F.col("n_docs") + 0.5))
    there = there.withColumn("idf", idf).withColumn("average", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.lit(1.0)))
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("average")))
    # stored, so that the planner knows their size: what is small goes to every task, what is not is shuffled
    places = materialize(there.select("_segment", "_part", *on, "n_docs", "idf", "average", gain.alias("bound")), "places")
    weighed = asked.join(places.select(*on, "n_docs", "bound").distinct(), on)

    def postings_of(pairs: DataFrame) -> DataFrame:
        """(term, doc, gain) of the terms of pairs. The condition on n_docs lets Spark prune partitions by the terms' places."""
        wanted = places.join(pairs.select(*on).distinct(), on, "left_semi").where("n_docs > 0")
        return index.postings.select("_segment", "_part", *on, doc, "tf", "dl").join(wanted, ["_segment", "_part", *on]).select(*on, doc, gain.alias("gain"))

    def gains(pairs: DataFrame) -> DataFrame:
        """(by, term, doc, gain) of pairs (by, term)."""
        found = postings_of(pairs).join(pairs, on)
        return found.where(F.col(query) != F.col(doc)) if exclude_self else found

    def best(scores: DataFrame) -> DataFrame:
        return top_k(scores, k, by, [F.desc("score"), F.asc(doc)]).select(*by, "rank", doc, "score")

    pairs = weighed.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    if pairs <= DIRECT_PAIRS * index.spark.sparkContext.defaultParallelism:
        return best(gains(weighed.select(*by, "term")).groupBy(*by, doc).agg(F.round(F.sum("gain"), 6).alias("score")))
    before = Window.partitionBy(*by).orderBy("n_docs", "term").rowsBetween(Window.unboundedPreceding, -1)
    seeds = weighed.withColumn("_before", F.coalesce(F.sum("n_docs").over(before), F.lit(0))).where(F.col("_before") < 8 * k).select(*by, "term")
    first = gains(seeds).groupBy(*by, doc).agg(F.sum("gain").alias("score"))
    kth = top_k(first, k, by, [F.desc("score"), F.asc(doc)]).groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("reached"))
    upto = Window.partitionBy(*by).orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    split = weighed.join(kth.where(F.col("_n") == k).select(*by, "reached"), by, "left").withColumn("_sum", F.sum("bound").over(upto))
    split = materialize(split.select(*by, "term", "bound", "reached", F.coalesce(F.col("_sum") < F.col("reached") - SLACK, F.lit(False)).alias("common")), "split")
    limits = split.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("common"), F.col("bound"))), F.lit(0.0)).alias("rest"), F.max("reached").alias("reached"))
    rare = gains(split.where("not common").select(*by, "term")).groupBy(*by, doc).agg(F.sum("gain").alias("gain"))
    rare = rare.join(limits, by).where(F.col("reached").isNull() | (F.col("gain") + F.col("rest") >= F.col("reached") - SLACK))
    rare = materialize(rare.select(*by, doc, "gain"), "rare")
    common = split.where("common").select(*by, "term")
    more = rare.select(*by, doc).join(common, by).join(postings_of(common), [*on, doc]).select(*by, doc, "gain")
    scores = rare.union(more.select(*rare.columns)).groupBy(*by, doc).agg(F.round(F.sum("gain"), 6).alias("score"))
    return best(scores)


def term_statistics(index: LexicalIndex, pairs: bool = False) -> DataFrame:
    """(term, df, total) of all tokens, and of pairs if asked: in how many documents each occurs, and how often. Read from what the index has of terms, not from postings."""
    terms = index.table("terms") if pairs else index.table("terms").where(~F.contains(F.col("term"), F.lit("::")))
    return terms.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("total"))


def bm25(docs: DataFrame, queries: DataFrame, query: str, k: int, doc: str = "doc_id", text: str = "text", query_text: str = "text", exclude_self: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """search_index over an index that is built for it."""
    return search_index(build_index(docs, doc, text), queries, query, k, query_text, exclude_self, k1, b)
