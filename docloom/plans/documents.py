"""Queries from pages to chunks to answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.config import RetrievalConfig
from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.functions.register import register
from docloom.operators import assembly as AS
from docloom.operators import chunking as C
from docloom.operators import conversation as V
from docloom.operators import coverage as COV
from docloom.operators import layout as L
from docloom.operators import retrieval as R
from docloom.operators.factory import create_retriever
from docloom.plans.control import _YEARLY, _evidence, _yearly
from docloom.sources.tables import table
from docloom.storage import materialize

BLOCK = r"(?is)<(?:h1|p|li)[^>]*>.*?</(?:h1|p|li)>"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs and items of pages in order."""
    found = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(0))).alias("seq", "b"))
    kind = F.when(F.lower("b").startswith("<h1"), "title").when(F.lower("b").startswith("<li"), "subtitle").otherwise("text")
    return found.select("page_id", "seq", kind.alias("kind"), T.squeeze(F.regexp_replace("b", "<[^>]+>", " ")).alias("text"))


_BLOCKS = rf"""x AS (SELECT page_id, regexp_extract_all(html, '{BLOCK}') AS l FROM pages), y AS (SELECT page_id, unnest(l) AS b, unnest(range(0, len(l))) AS seq FROM x),
    blocks AS (SELECT page_id, CAST(seq AS INT) AS seq, CASE WHEN starts_with(lower(b), '<h1') THEN 'title' WHEN starts_with(lower(b), '<li') THEN 'subtitle' ELSE 'text' END AS kind, trim(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM y)"""


def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the headings that hold for them."""
    rows = C.headings_with_reset(_blocks(spark, sf_dir), ["page_id"], ["seq"], "kind", "text")
    return rows.select("page_id", "seq", "kind", F.md5("text").alias("text_md5"), F.md5(F.concat_ws(" > ", "title", "subtitle")).alias("path_md5"))


LAYOUT_SQL = f"""WITH {_BLOCKS}, p AS (SELECT *, count(*) FILTER (kind = 'title') OVER w AS part, last_value(CASE WHEN kind = 'title' THEN text END IGNORE NULLS) OVER w AS title FROM blocks WINDOW w AS (PARTITION BY page_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT *, last_value(CASE WHEN kind = 'subtitle' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id, part ORDER BY seq ROWS UNBOUNDED PRECEDING) AS subtitle FROM p)
    SELECT page_id, seq, kind, md5(text) AS text_md5, md5(concat_ws(' > ', title, subtitle)) AS path_md5 FROM q"""


def _recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as records of recognition: headings, paragraphs, advertisements and footers as margins, and menus as tables of their items."""
    part = r"(?is)<h1[^>]*>.*?</h1>|<p>.*?</p>|<ul>.*?</ul>|<div[^>]*>.*?</div>|<footer>.*?</footer>"
    kind = lambda b: F.when(F.startswith(b, F.lit("<h1")), "doc_title").when(F.startswith(b, F.lit("<ul")), "table").when(F.startswith(b, F.lit("<div")), "header").when(F.startswith(b, F.lit("<footer")), "footer").otherwise("text")
    items = lambda b: F.transform(F.regexp_extract_all(b, F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1)), lambda x, i: F.concat(F.lit("<tr><td>"), x, F.lit("</td><td>"), (i + 1).cast("string"), F.lit("</td></tr>")))
    grid = lambda b: F.concat(F.lit("<table><tr><th>Item</th><th>Place</th></tr>"), F.array_join(items(b), ""), F.lit("</table>"))
    block = lambda b, i: F.struct(kind(b).alias("block_label"), F.when(F.startswith(b, F.lit("<ul")), grid(b)).otherwise(b).alias("block_content"), F.lit(None).cast("array<double>").alias("block_bbox"), i.alias("block_order"))
    pages = table(spark, sf_dir, "pages").withColumn("l", F.transform(F.regexp_extract_all("html", F.lit(part), F.lit(0)), block))
    place = [F.col("page_id").cast("int").alias(c) for c in ("logical_index", "pdf_page_index", "pdf_page", "printed_page")]
    return pages.select(
        F.format_string("p%06d", "page_id").alias("raw_id"), *place, F.lit("full").alias("page_part"), F.lit("inferred").alias("mapping_method"), F.lit("pages").alias("source"), F.lit(None).cast("string").alias("markdown"),
        F.struct(F.struct(F.col("l").alias("parsing_res_list")).alias("res")).alias("structured_result"),
    )


def layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as chunks of at most 800 characters that keep headings and whole table rows."""
    out = L.layout_chunks(_recognised(spark, sf_dir), size=800, overlap=100)
    return out.select("chunk_id", "block_type", "printed_page", F.md5("text").alias("text_md5"), F.length("text").alias("length"))


def multi_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed blocks, table rows and signatures of pages."""
    out = L.multi_granularity(_recognised(spark, sf_dir), 800, 100)
    return out.select("chunk_id", "block_type", "granularity", F.md5("text").alias("text_md5"))


def cascade_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the plain text of pages, and their tables by row."""
    pages = table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))
    out = L.cascade_chunks(pages, _recognised(spark, sf_dir), 800, 100)
    return out.select("chunk_id", "block_type", "granularity", F.md5("text").alias("text_md5"))


def cascade_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items count as regions of their own only on pages that have many of them."""
    many = F.count_if(F.col("kind") == "subtitle").over(Window.partitionBy("page_id")) >= 3
    return _blocks(spark, sf_dir).withColumn("complex", many).where("kind <> 'subtitle' or complex").groupBy("page_id", "complex").agg(F.count(F.lit(1)).alias("n"))


CASCADE_SQL = f"WITH {_BLOCKS}, c AS (SELECT *, count(*) FILTER (kind = 'subtitle') OVER (PARTITION BY page_id) >= 3 AS complex FROM blocks) SELECT page_id, complex, count(*) AS n FROM c WHERE kind <> 'subtitle' OR complex GROUP BY ALL"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as records of recognition: a label and a figure box for each block, and a total that only the text has. Odd pages say nothing in their heading."""
    label = F.array_join(F.slice(T.all_matches(F.col("text"), r"\p{L}+"), 1, 2), " ")
    blocks = _blocks(spark, sf_dir).withColumn("label", label).where("label <> ''")
    top = F.col("seq") * 400.0
    box = lambda content, y: F.struct(F.lit("text").alias("block_label"), content.alias("block_content"), F.array(F.lit(0.0), top + y, F.lit(100.0), top + y + 20).alias("block_bbox"), F.col("seq").alias("block_order"))
    pair = F.array(box(F.col("label"), 0), box(F.concat(F.length("text").cast("string"), F.lit(" tỷ đồng")), 30))
    rows = blocks.groupBy("page_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", pair.alias("p")))), lambda x: x["p"])).alias("boxes"), F.max(F.when(F.col("kind") == "title", F.array_join(T.all_matches(F.col("text"), r"\p{L}+"), " "))).alias("title"))
    heading = F.when(F.col("page_id") % 2 == 1, F.lit("Tổng quan")).otherwise(F.coalesce("title", F.lit("")))
    markdown = F.concat(F.lit("# "), heading, F.lit("\nTổng cộng\n"), (F.size("boxes") / 2).cast("int").cast("string"))
    return rows.select(
        "page_id", F.format_string("p%06d", "page_id").alias("raw_id"), F.format_string("s%02d", F.col("page_id") % 50).alias("source"), F.col("page_id").cast("int").alias("logical_index"), F.col("page_id").cast("int").alias("printed_page"), markdown.alias("markdown"),
        F.struct(F.struct(F.col("boxes").alias("parsing_res_list")).alias("res")).alias("structured_result"),
    )


def assembled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages under their sections, and a chunk for each figure that an extractor finds."""
    chunks = _blocks(spark, sf_dir).select(F.format_string("a3_p%06d_block_%04d", "page_id", "seq").alias("chunk_id"), F.format_string("p%06d", "page_id").alias("raw_id"), "seq", "text", F.lit("block").alias("granularity"))
    out = AS.assembled_chunks(chunks, _records(spark, sf_dir), year=2025)
    return out.select("chunk_id", "granularity", F.md5("text").alias("text_md5"), F.md5("parent_text").alias("parent_md5"), F.col("semantic_fields.metric").alias("metric"), F.col("semantic_fields.value").alias("value"), F.array_join("semantic_fields.numbers", "|").alias("numbers"), F.col("semantic_fields.unit").alias("unit"), "method", "confidence")


ASSEMBLED_SQL = rf"""WITH {_BLOCKS},
    b AS (SELECT *, array_to_string(regexp_extract_all(text, '\p{{L}}+')[:2], ' ') AS label FROM blocks),
    r AS (SELECT page_id, count(*) AS n, CASE WHEN page_id % 2 = 1 THEN 'Tổng quan' ELSE coalesce(max(CASE WHEN kind = 'title' THEN array_to_string(regexp_extract_all(text, '\p{{L}}+'), ' ') END), '') END AS heading FROM b WHERE label <> '' GROUP BY page_id),
    s AS (SELECT *, last_value(CASE WHEN heading NOT IN ('', 'Tổng quan') THEN heading END IGNORE NULLS) OVER (PARTITION BY page_id % 50 ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS section FROM r),
    p AS (SELECT page_id, n, 'Kỳ báo cáo: 2025' || chr(10) || CASE WHEN section IS NULL AND heading = '' THEN '' ELSE 'Ngữ cảnh tài liệu: ' || concat_ws(' > ', section, CASE WHEN heading <> coalesce(section, '') AND heading <> '' THEN heading END) || chr(10) END AS scope FROM s),
    par AS (SELECT page_id, rtrim(left(string_agg(text, chr(10) || chr(10) ORDER BY seq), 2400), ' ' || chr(10) || chr(9) || chr(13)) AS parent FROM blocks GROUP BY page_id),
    v AS (SELECT page_id, label AS metric, length(text) AS value, seq FROM b WHERE label <> '' QUALIFY row_number() OVER (PARTITION BY page_id, lower(label) ORDER BY seq) = 1),
    m AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS k, metric, value || ' tỷ đồng' AS value, CAST(value AS VARCHAR) AS numbers, 'tỷ đồng' AS unit, 'layout_nearest_label' AS method, 0.92e0 AS confidence FROM v
      UNION ALL SELECT page_id, (SELECT count(*) FROM v WHERE v.page_id = p.page_id) + 1, 'Tổng cộng', CAST(n AS VARCHAR), CAST(n AS VARCHAR), NULL, 'markdown_sequence_fallback', 0.68e0 FROM p)
    SELECT printf('a31_p%06d_block_%04d', page_id, seq) AS chunk_id, 'block' AS granularity, md5(coalesce(scope, 'Kỳ báo cáo: 2025' || chr(10)) || text) AS text_md5, NULL::VARCHAR AS parent_md5, NULL::VARCHAR AS metric, NULL::VARCHAR AS value, NULL::VARCHAR AS numbers, NULL::VARCHAR AS unit, NULL::VARCHAR AS method, NULL::DOUBLE AS confidence
    FROM blocks LEFT JOIN p USING (page_id)
    UNION ALL SELECT printf('a31_p%06d_metric_%04d', page_id, k), 'metric', md5(scope || 'Chỉ tiêu: ' || metric || chr(10) || 'Giá trị: ' || value), md5(parent), metric, value, numbers, unit, method, confidence FROM m JOIN p USING (page_id) JOIN par USING (page_id)"""


def metric_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key of a document's metric: kind of text and its first words that are not all capitals."""
    words = F.filter(F.slice(T.all_matches(F.col("text"), T.WORD), 1, 12), lambda w: w != F.upper(w))
    label = F.lower(F.array_join(F.slice(words, 1, 4), " "))
    kind = T.first_case(F.col("text"), [("licen", "legal"), ("www", "web")], "plain")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("::", kind, label).alias("metric_key"), F.size(T.years(F.col("text"))).cast("long").alias("n_years"))


IDENTITY_SQL = r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+')[:12], lambda w: w <> upper(w))[:4] AS w FROM documents)
    SELECT doc_id, (CASE WHEN contains(lower(text), 'licen') THEN 'legal' WHEN contains(lower(text), 'www') THEN 'web' ELSE 'plain' END) || '::' || lower(array_to_string(w, ' ')) AS metric_key,
    len(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'), lambda v: regexp_matches(v, '^(19|20)[0-9]{2}$')))) AS n_years FROM w"""


def follow_up_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that lean on the question before, rewritten with the year they name."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.when((F.col("role") == "user") & (F.col("turn") > 1), F.concat(F.lit("and in 20"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("?"))).otherwise(F.concat("text", F.lit(" in 2001"))))
    return V.rewrite_follow_up(turns).select("conv_id", "turn", "role", F.md5("rewritten").alias("rewritten"))


REWRITE_SQL = r"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' AND turn > 1 THEN 'and in 20' || lpad(turn::VARCHAR, 2, '0') || '?' ELSE text || ' in 2001' END AS text FROM conversations),
    a AS (SELECT *, NOT regexp_matches(lower(text), '^(and|what about|it|that|this|those) ') AS alone FROM c),
    b AS (SELECT *, last_value(CASE WHEN role = 'user' AND alone THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor, regexp_extract(text, '(19|20)[0-9]{2}', 0) AS y FROM a)
    SELECT conv_id, turn, role, md5(CASE WHEN NOT alone AND anchor IS NOT NULL AND y <> '' THEN regexp_replace(anchor, '(19|20)[0-9]{2}', y, 'g') ELSE text END) AS rewritten FROM b"""


def same_row_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact difference and percentage of the last two years of each priority, written out."""
    w = Window.partitionBy("o_orderpriority").orderBy("year")
    rows = _yearly(spark, sf_dir).withColumn("old", F.lag("v").over(w))
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("year")))).where("_n = 1 and old is not null")
    change = (F.col("v") - F.col("old")).cast("decimal(20,2)")
    return last.select("o_orderpriority", N.format_decimal(change, 2).alias("difference"), F.round(N.change_percent(F.col("old").cast("double"), F.col("v").cast("double")), 6).alias("percent"))


COMPARISON_SQL = f"""WITH {_YEARLY}, l AS (SELECT *, lag(v) OVER (PARTITION BY o_orderpriority ORDER BY year) AS old, row_number() OVER (PARTITION BY o_orderpriority ORDER BY year DESC) AS n FROM y)
    SELECT o_orderpriority, translate(format('{{:,.2f}}', (v - old)::DOUBLE), ',.', '.,') AS difference, round((v::DOUBLE - old::DOUBLE) * 100 / abs(old::DOUBLE), 6) AS percent FROM l WHERE n = 1 AND old IS NOT NULL"""


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a Markdown table of a run's metrics."""
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 2).alias("mean"))
    return rows.select("lang", F.concat(F.lit("| "), F.concat_ws(" | ", "lang", F.col("n").cast("string"), F.format_number("mean", 2)), F.lit(" |")).alias("line"))


REPORT_SQL = "SELECT lang, '| ' || concat_ws(' | ', lang, count(*)::VARCHAR, format('{:,.2f}', round(avg(n_chars), 2))) || ' |' AS line FROM documents GROUP BY lang"


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an encoder would embed texts: counts of hashed words in 64 places, of length one."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.all_matches(F.lower("text"), T.WORD)).alias("w"))
    counts = words.groupBy("doc_id", F.pmod(F.xxhash64("w"), F.lit(64)).cast("int").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: (F.coalesce(F.try_element_at("m", d), F.lit(0.0)) / F.col("norm")).cast("float"))
    return cells.select("doc_id", vector.alias("embedding"))


def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions from retrieval to a cited answer or a refusal, in one job. The first line of the best row stands in for a written answer."""
    evidence = _evidence(spark, sf_dir)
    state = COV.sufficiency(evidence, "item_id", "asked", "text", "base", ["thing", "licen", "with"])
    best = evidence.where("rank = 1").select("item_id", "doc_id", "text", F.split("text", "\n")[0].alias("line"))
    rows = best.join(state, "item_id").withColumn("answer", F.concat("line", F.lit(" [p. "), F.col("doc_id").cast("string"), F.lit("]")))
    valid = F.array_contains(T.citations(F.col("answer")), F.col("doc_id")) & COV.numbers_supported(F.col("line"), F.col("text"))
    refused = ~F.col("sufficient") | ~valid
    return rows.select("item_id", refused.alias("refused"), F.when(~refused, F.col("answer")).alias("answer"), T.citations(F.when(~refused, F.col("answer")).otherwise(F.lit(""))).alias("citations"), "confidence")


def dense_on_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route's part of the index by semi join on ids: vectors are used again, not made again."""
    part = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(part, "vec_id", "left_semi")
    return R.dense_top_k(vectors, vectors.where("vec_id % 20 = 0"), 5)


SUBSET_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')),
    d AS (SELECT q.vec_id AS query, e.vec_id, round(list_dot_product(e.v, q.v), 6) AS score FROM e, e q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)
    SELECT * FROM (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM d) WHERE rank <= 5"""

def udtf_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker as a table function in SQL."""
    register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("docloom_documents")
    return spark.sql("SELECT doc_id, seq, md5(w.text) AS text_md5 FROM docloom_documents d, LATERAL text_windows(d.text, 1000, 100) w")


def hybrid_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured retriever over documents that have a vector; documents ask with their own whole text and vector."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    # stored: the search passes over them several times, and their join would shuffle all texts each time; dealt out, since they may lie in a few files of the table
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(vectors.select("doc_id"), "doc_id", "left_semi")
    docs = materialize(docs.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id"), "with-vectors")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")
    retrieve = create_retriever(docs, vectors, RetrievalConfig(mode="constraint_rerank", k=5), ["the", "and"])
    return retrieve(asked, vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query"))


QUERIES = {f.__name__: f for f in (udtf_windows, hybrid_factory, layout_blocks, layout_chunks, multi_granularity, cascade_chunks, cascade_regions, assembled_chunks, metric_identity, follow_up_rewrite, same_row_comparison, report_lines, hash_embeddings, answer_batch, dense_on_subset)}
ORACLES = {"layout_blocks": LAYOUT_SQL, "cascade_regions": CASCADE_SQL, "assembled_chunks": ASSEMBLED_SQL, "metric_identity": IDENTITY_SQL, "follow_up_rewrite": REWRITE_SQL, "same_row_comparison": COMPARISON_SQL, "report_lines": REPORT_SQL, "dense_on_subset": SUBSET_SQL}
