"""Queries of joins, set operations and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.operators import selection as S
from docloom.sources import records as REC
from docloom.sources.tables import table


def left_join_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the review of each, if there is one."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "quality", "toxic", F.coalesce("quality", F.lit(-1)).alias("known"))


LEFT_SQL = "SELECT doc_id, quality, toxic, coalesce(quality, -1) AS known FROM documents LEFT JOIN labels USING (doc_id)"


def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only one side has, and which side."""
    a, b = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return a.join(b, "doc_id", "left_anti").select("doc_id", F.lit("unlabelled").alias("side")).unionByName(b.join(a, "doc_id", "left_anti").select("doc_id", F.lit("unknown").alias("side")))


ANTI_SQL = "SELECT doc_id, 'unlabelled' AS side FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'unknown' FROM labels ANTI JOIN documents USING (doc_id)"


def semi_join_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a conversation of the same number cites."""
    cited = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").join(cited, "doc_id", "left_semi").select("doc_id", "lang")


SEMI_SQL = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')"


def full_outer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and vectors of one number, whichever side has it."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return docs.join(vectors, "id", "full_outer").select("id", "lang", F.col("label").cast("int").alias("label"))


OUTER_SQL = "SELECT coalesce(doc_id, vec_id) AS id, lang, CAST(label AS INT) AS label FROM documents FULL JOIN embeddings ON doc_id = vec_id"


def nearest_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as value boxes, orders' parts as label boxes above them: range join and nearest."""
    items = table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("id"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + 60).alias("x1"), (F.col("l_quantity") + 200).alias("y0"), (F.col("l_quantity") + 220).alias("y1"))
    labels = table(spark, sf_dir, "lineitem").where("l_linenumber <> 2").select(F.col("l_orderkey").alias("g"), F.col("l_partkey").alias("id"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + 60).alias("x1"), (F.col("l_quantity") * 4).alias("y0"), (F.col("l_quantity") * 4 + 20).alias("y1"))
    return C.nearest_labels(items, labels, "g").select(F.col("g").alias("orderkey"), "value_id", "label_id")


NEAREST_SQL = """WITH b AS (SELECT l_orderkey AS g, l_partkey AS id, l_linenumber AS n, l_quantity * 10 AS x0, l_quantity * 10 + 60 AS x1, l_quantity AS q FROM lineitem),
    p AS (SELECT v.g, v.id AS value_id, l.id AS label_id, (v.q + 200) - (l.q * 4 + 20) AS gap, least(v.x1, l.x1) - greatest(v.x0, l.x0) AS shared, abs((v.x0 + v.x1) / 2 - (l.x0 + l.x1) / 2) AS shift
          FROM b v JOIN b l ON v.g = l.g AND v.n = 2 AND l.n <> 2)
    SELECT g AS orderkey, value_id, arg_min(label_id, (gap, shift, label_id)) AS label_id FROM p WHERE gap BETWEEN 0 AND 220 AND (shared / 60 >= 0.25e0 OR shift <= 100) GROUP BY g, value_id"""

LEXICON = [("legal", "licensed under"), ("legal", "copyright"), ("greek", "alpha"), ("short", " of the "), ("short", " and the ")]


def theta_lexicon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a term, by term. The lexicon is a few rows of configuration."""
    lexicon = spark.createDataFrame(LEXICON, "topic string, term string")
    docs = table(spark, sf_dir, "documents").select(F.lower("text").alias("t"))
    return docs.join(F.broadcast(lexicon), F.contains("t", "term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))


THETA_SQL = "WITH x(topic, term) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LEXICON) + ") SELECT topic, term, count(*) AS n FROM documents JOIN x ON contains(lower(text), term) GROUP BY ALL"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of every question with made-up latencies and outcomes."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n"))
    arms = spark.createDataFrame([("a", 3), ("b", 5), ("c", 7)], "arm string, f int")
    return asked.crossJoin(F.broadcast(arms)).select("item_id", "arm", (F.col("n") * F.col("f") % 101).cast("long").alias("ms"), (F.col("n") % F.col("f") < 2).alias("correct"))


RUNS_SQL = "runs AS (SELECT item_id, arm, CAST(length(text) * f % 101 AS BIGINT) AS ms, length(text) % f < 2 AS correct FROM benchmark, (VALUES ('a', 3), ('b', 5), ('c', 7)) x(arm, f))"


def nway_join_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    one = lambda arm: runs.where(F.col("arm") == arm).select("item_id", F.col("ms").alias(f"ms_{arm}"))
    return one("a").join(one("b"), "item_id").join(one("c"), "item_id")


NWAY_SQL = f"WITH {RUNS_SQL} SELECT item_id, a.ms AS ms_a, b.ms AS ms_b, c.ms AS ms_c FROM runs a JOIN runs b USING (item_id) JOIN runs c USING (item_id) WHERE a.arm = 'a' AND b.arm = 'b' AND c.arm = 'c'"


def delta_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean latency and accuracy of each arm less those of arm a."""
    means = _runs(spark, sf_dir).groupBy("arm").agg(F.avg("ms").alias("ms"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    base = means.where("arm = 'a'").select(F.col("ms").alias("ms0"), F.col("accuracy").alias("a0"))
    return means.crossJoin(F.broadcast(base)).select("arm", F.round(F.col("ms") - F.col("ms0"), 6).alias("ms_delta"), F.round(F.col("accuracy") - F.col("a0"), 6).alias("accuracy_delta"))


DELTA_SQL = f"WITH {RUNS_SQL}, m AS (SELECT arm, avg(ms) AS ms, avg(correct::INT::DOUBLE) AS acc FROM runs GROUP BY arm) SELECT m.arm, round(m.ms - b.ms, 6) AS ms_delta, round(m.acc - b.acc, 6) AS accuracy_delta FROM m, m b WHERE b.arm = 'a'"


def union_representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, lines and headings as one bag of rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = docs.select("doc_id", F.lit(0).alias("seq"), F.lit("page").alias("kind"), F.length("text").alias("n"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line")).select("doc_id", "seq", F.lit("row").alias("kind"), F.length("line").alias("n"))
    heads = docs.select("doc_id", F.lit("block").alias("kind"), F.length(F.split("text", "\n")[0]).alias("n"))
    rows = pages.unionByName(lines).unionByName(heads, allowMissingColumns=True)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("n").cast("long")).alias("chars"), F.count("seq").alias("with_seq"))


UNION_SQL = """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), r AS (SELECT 'page' AS kind, length(text) AS n, 0 AS seq FROM documents UNION ALL SELECT 'row', length(line), 1 FROM l
    UNION ALL SELECT 'block', length(string_split(text, chr(10))[1]), NULL FROM documents) SELECT kind, count(*) AS rows, CAST(sum(n) AS BIGINT) AS chars, count(seq) AS with_seq FROM r GROUP BY kind"""


def intersect_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that both questions and documents use."""
    words = lambda name: table(spark, sf_dir, name).select(F.explode(T.word_set(F.col("text"))).alias("word"))
    return words("benchmark").intersect(words("documents"))


_W = r"unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_%]+'))"
INTERSECT_SQL = f"SELECT {_W} AS word FROM benchmark INTERSECT SELECT {_W} FROM documents"


def intersect_all_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages and sources that labelled and unlabelled documents share, as often as both have them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    a = docs.join(labels, "doc_id", "left_semi").select("lang", "source")
    return a.intersectAll(docs.join(labels, "doc_id", "left_anti").select("lang", "source"))


INTERSECT_ALL_SQL = "SELECT lang, source FROM documents SEMI JOIN labels USING (doc_id) INTERSECT ALL SELECT lang, source FROM documents ANTI JOIN labels USING (doc_id)"


def except_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents that are no year."""
    found = table(spark, sf_dir, "documents").select(F.explode(T.numbers(F.col("text"))).alias("number")).distinct()
    years = table(spark, sf_dir, "documents").select(F.explode(T.numbers(F.col("text"))).alias("number")).where(T.is_year(F.col("number")))
    return found.exceptAll(years.distinct())


EXCEPT_SQL = "WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[0-9]+(?:[.,][0-9]+)*%?')) AS number FROM documents) SELECT number FROM n EXCEPT SELECT number FROM n WHERE regexp_matches(number, '^[0-9]{4}$') AND number BETWEEN '1900' AND '2100'"


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a printed number three behind their place, where one is printed and not misread."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("logical_index"))
    seen = F.when(F.col("logical_index") % 4 != 1, F.when(F.col("logical_index") % 11 == 0, F.col("logical_index") + 9).otherwise(F.col("logical_index") + 3))
    return pages.select("logical_index", F.when(seen.isNotNull(), F.array(seen)).otherwise(F.array()).alias("candidates"))


_FRAGMENTS = "f AS (SELECT page_id AS i, CASE WHEN page_id % 4 <> 1 THEN CASE WHEN page_id % 11 = 0 THEN page_id + 9 ELSE page_id + 3 END END AS c FROM pages)"


def mode_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REC.dominant_offset(_fragments(spark, sf_dir), "logical_index", "candidates")


MODE_SQL = f"WITH {_FRAGMENTS} SELECT c - i AS \"offset\", count(*) AS votes FROM f WHERE c IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY votes DESC, 1 LIMIT 1"


def printed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = spark.createDataFrame([(4, 99), (9, 98)], "logical_index long, override long")
    return REC.assign_pages(_fragments(spark, sf_dir), overrides, "logical_index", "candidates").select("logical_index", "printed_page", "mapping_method")


PAGES_SQL = f"""WITH {_FRAGMENTS}, o AS (SELECT c - i AS k FROM f WHERE c IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), v(i, override) AS (VALUES (4, 99), (9, 98))
    SELECT f.i AS logical_index, CASE WHEN override IS NOT NULL THEN CAST(override AS BIGINT) ELSE f.i + k END AS printed_page,
    CASE WHEN override IS NOT NULL THEN 'override' WHEN c = f.i + k THEN 'detected' ELSE 'inferred' END AS mapping_method FROM f CROSS JOIN o LEFT JOIN v ON v.i = f.i"""


def group_concat_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation joined in order and cut at 2400 characters."""
    rows = S.joined_prefix(table(spark, sf_dir, "conversations"), ["conv_id"], [F.asc("turn"), F.asc("role"), F.asc("text")], "text", "\n\n", 2400)
    body = F.rtrim("text")
    return rows.select("conv_id", F.md5(body).alias("parent_md5"), F.length(body).cast("long").alias("n"))


CONCAT_SQL = "WITH p AS (SELECT conv_id, rtrim(left(string_agg(text, chr(10) || chr(10) ORDER BY turn, role, text), 2400), ' ') AS b FROM conversations GROUP BY conv_id) SELECT conv_id, md5(b) AS parent_md5, length(b) AS n FROM p"


def best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest order of each customer; the first of equal ones."""
    orders = table(spark, sf_dir, "orders")
    return S.best_per_key(orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


BEST_SQL = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"


def priority_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each source by priority of language, then number."""
    priority = F.when(F.col("lang") == "fr", 3).when(F.col("lang") == "de", 2).otherwise(1)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(priority, -F.col("doc_id"))).alias("doc_id"))


PRIORITY_SQL = "SELECT source, arg_max(doc_id, (CASE lang WHEN 'fr' THEN 3 WHEN 'de' THEN 2 ELSE 1 END, -doc_id)) AS doc_id FROM documents GROUP BY source"


def split_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landscape sheets become a left and a right page."""
    sheets = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sheet"), (F.col("p_size") * 20.0).alias("w"), (F.col("p_retailprice") / 4).alias("h"))
    return REC.page_parts(sheets, "w", "h").select("sheet", "page_part")


SHEETS_SQL = "SELECT p_partkey AS sheet, unnest(CASE WHEN p_size * 20.0e0 >= 1.2e0 * (p_retailprice / 4) THEN ['left', 'right'] ELSE ['full'] END) AS page_part FROM part"


def sharded_resumable_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of shard 1 of 4 that are not done yet."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    return REC.open_shard(pages, pages.where("page_id % 10 = 5"), "page_id", 4, 1)


SHARD_SQL = "SELECT page_id FROM pages WHERE page_id % 4 = 1 AND page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 10 = 5)"


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric by entity and year: revenue of the five tables' star."""
    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    rows = items.join(t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "year").agg(F.round(F.sum("v"), 2).alias("revenue"))


REVENUE_SQL = "SELECT n_name, CAST(year(o_orderdate) AS INT) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"


def cube_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


CUBE_SQL = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count(F.lit(1)).alias("n"))


SETS_SQL = "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())"


def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


def categorical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.count_if(F.col("n_chars") > 2000).alias("long"))


COUNTS_SQL = "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, CAST(count(*) FILTER (n_chars > 2000) AS BIGINT) AS long FROM documents GROUP BY lang"


def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two splits of the documents share: ids, which must be none, and texts, which copies may bring into both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    held, rest = docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0")
    shared = lambda c: held.select(c).where(F.col(c).isNotNull()).intersect(rest.select(c)).agg(F.lit(c).alias("by"), F.count(F.lit(1)).alias("shared"))
    return shared("doc_id").unionByName(shared("text_md5"))


DISJOINT_SQL = """SELECT 'doc_id' AS "by", count(*) AS shared FROM documents a JOIN documents b USING (doc_id) WHERE a.doc_id % 5 = 0 AND b.doc_id % 5 <> 0
    UNION ALL SELECT 'text_md5', count(DISTINCT text) FROM documents WHERE doc_id % 5 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 5 <> 0 AND text IS NOT NULL)"""

QUERIES = {f.__name__: f for f in (left_join_labels, anti_join_missing, semi_join_cited, full_outer_scores, nearest_range_join, theta_lexicon_join, nway_join_runs, delta_vs_baseline, union_representations, intersect_terms, intersect_all_multiset, except_years, mode_offset, printed_pages, group_concat_parent, best_per_key, priority_pick, split_sheets, sharded_resumable_scan, revenue_by_nation, cube_rollup, grouping_sets, approx_distinct, categorical_counts, split_disjoint)}
ORACLES = {
    "left_join_labels": LEFT_SQL, "anti_join_missing": ANTI_SQL, "semi_join_cited": SEMI_SQL, "full_outer_scores": OUTER_SQL, "nearest_range_join": NEAREST_SQL, "theta_lexicon_join": THETA_SQL, "nway_join_runs": NWAY_SQL,
    "delta_vs_baseline": DELTA_SQL, "union_representations": UNION_SQL, "intersect_terms": INTERSECT_SQL, "intersect_all_multiset": INTERSECT_ALL_SQL, "except_years": EXCEPT_SQL, "mode_offset": MODE_SQL, "printed_pages": PAGES_SQL,
    "group_concat_parent": CONCAT_SQL, "best_per_key": BEST_SQL, "priority_pick": PRIORITY_SQL, "split_sheets": SHEETS_SQL, "sharded_resumable_scan": SHARD_SQL, "revenue_by_nation": REVENUE_SQL, "cube_rollup": CUBE_SQL,
    "grouping_sets": SETS_SQL, "categorical_counts": COUNTS_SQL, "split_disjoint": DISJOINT_SQL,
}
