"""Queries of metric values. Their chunks are made of the order table: a row of yearly totals for each priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import evaluation as E
from docloom.operators import metrics as M
from docloom.plans.control import _YEARLY, _yearly
from docloom.plans.evaluation import F1_SQL
from docloom.sources.tables import table

UNIT = "triệu đồng"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderpriority, text): a table's rows as text, values with dots that group and a decimal comma; the change to the year before in a second row."""
    whole, cents = F.floor(F.col("v").cast("double")).cast("long"), F.col("v") % 1
    digits = F.replace(F.format_number(whole, 0), F.lit(","), F.lit("."))
    value = F.concat(F.lit(" | "), F.col("year").cast("string"), F.lit(f" {UNIT}: "), digits, F.lit(","), F.lpad((cents * 100).cast("int").cast("string"), 2, "0"))
    lines = _yearly(spark, sf_dir).groupBy("o_orderpriority").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", value.alias("t")))), lambda x: x["t"]), "").alias("body"))
    text = F.concat(F.lit("Báo cáo lưu chuyển tiên tệ\nChỉ tiêu: TỔNG\nCột 1: Doanh thu thuần "), "o_orderpriority", "body", F.lit(f"\nCột 1: Chi phí | 1990 {UNIT}: (12,5) | 1991 {UNIT}: -"))
    return lines.select("o_orderpriority", text.alias("text"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of rows read back from their texts, as numbers."""
    found = M.metric_rows(_chunks(spark, sf_dir), ["o_orderpriority"], "text")
    return found.select("o_orderpriority", "label", F.col("year").cast("int").alias("year"), "unit", M.table_number(F.col("value")).cast("double").alias("value"))


ROWS_SQL = f"""WITH {_YEARLY} SELECT o_orderpriority, 'Doanh thu thuần ' || o_orderpriority AS label, year, '{UNIT}' AS unit, v::DOUBLE AS value FROM y
    UNION ALL SELECT DISTINCT o_orderpriority, 'Chi phí', 1990 + k::INT, '{UNIT}', CASE WHEN k = 0 THEN -12.5e0 END FROM y, range(2) t(k)"""


def metric_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, key, statement and search text of chunks, with words that recognition confused put right."""
    chunks = _chunks(spark, sf_dir).withColumn("heading", F.lit("Phần một")).withColumn("metric", F.when(F.col("o_orderpriority").startswith("1"), F.lit("Chi phí đã trả")))
    out = M.with_identity(chunks, "text", "heading", "metric")
    return out.select("o_orderpriority", "metric_label", "metric_key", "statement_type", F.array_join("metric_qualifiers", "|").alias("qualifiers"), F.size("metric_years").cast("long").alias("n_years"), F.substring_index("search_text", "\n", 3).alias("prefix"))


ENRICHMENT_SQL = f"""WITH {_YEARLY}, p AS (SELECT o_orderpriority, count(*) + 2 AS n FROM y GROUP BY 1), l AS (SELECT *, CASE WHEN starts_with(o_orderpriority, '1') THEN 'Chi phí đã trả' ELSE 'Doanh thu thuần ' || o_orderpriority END AS label,
      CASE WHEN starts_with(o_orderpriority, '1') THEN 'đã trả' ELSE 'thuần' END AS q FROM p)
    SELECT o_orderpriority, label AS metric_label, 'cash_flow::' || trim(regexp_replace(lower(label), '[^\\p{{L}}0-9]+', ' ', 'g')) AS metric_key, 'cash_flow' AS statement_type, q AS qualifiers, n AS n_years,
      'Loại báo cáo: cash_flow' || chr(10) || 'Nhãn chỉ tiêu chuẩn hóa: ' || label || chr(10) || 'Từ khóa phân biệt: ' || q AS prefix FROM l"""


ASKED = ("năm 1993", "năm 1995 so với 1994", "năm 1980", "năm 1994 và 1995", "")


def metric_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from one row: a year, two years compared, a year without a row, two years without comparison, none; and costs, of which one is a dash."""
    chunks = _chunks(spark, sf_dir)
    rows = M.metric_rows(chunks, ["o_orderpriority"], "text")
    asked = chunks.select("o_orderpriority", F.explode(F.array(*map(F.lit, ASKED))).alias("years"))
    asked = asked.withColumn("question", F.concat(F.lit("Doanh thu thuần "), "o_orderpriority", F.lit(" "), "years", F.lit(" là bao nhiêu?"))).withColumn("query", F.concat_ws("/", "o_orderpriority", "years"))
    costs = chunks.select("o_orderpriority", F.lit("").alias("years"), F.lit("Chi phí thay đổi từ 1991 so với 1990").alias("question"), F.concat(F.col("o_orderpriority"), F.lit("/costs")).alias("query"))
    found = M.answers_from_rows(asked.unionByName(costs), rows, "query", "question", ["o_orderpriority"])
    first = M.table_number(F.split(F.get("values", F.lit(0)), ": ")[1])
    return found.select("query", "kind", "label", "unit", first.cast("double").alias("value"), F.col("delta").cast("double").alias("delta"), F.round("percent", 4).alias("percent"), "reason")


ANSWER_SQL = f"""WITH {_YEARLY}, p AS (SELECT o_orderpriority, max(v) FILTER (year = 1993) AS v93, max(v) FILTER (year = 1994) AS v94, max(v) FILTER (year = 1995) AS v95 FROM y GROUP BY 1),
    a AS (SELECT *, unnest(['năm 1993', 'năm 1995 so với 1994', 'năm 1980', 'năm 1994 và 1995', '', 'costs']) AS k FROM p),
    r AS (SELECT *, CASE WHEN k = 'năm 1993' AND v93 IS NULL OR k LIKE '%1994%' AND (v94 IS NULL OR v95 IS NULL) OR k = 'năm 1980' THEN 'no_row' WHEN k = '' THEN 'no_years' WHEN k = 'costs' THEN 'no_number' WHEN k = 'năm 1994 và 1995' THEN 'neither_lookup_nor_comparison' END AS reason FROM a)
    SELECT o_orderpriority || '/' || k AS query, CASE WHEN reason IS NULL THEN CASE WHEN k LIKE '%so với%' THEN 'comparison' ELSE 'lookup' END END AS kind,
      CASE WHEN reason IS NULL THEN 'Doanh thu thuần ' || o_orderpriority END AS label, CASE WHEN reason IS NULL THEN '{UNIT}' END AS unit,
      CASE WHEN reason IS NULL THEN (CASE WHEN k = 'năm 1993' THEN v93 ELSE v95 END)::DOUBLE END AS value, CASE WHEN reason IS NULL AND k LIKE '%so với%' THEN (v95 - v94)::DOUBLE END AS delta,
      CASE WHEN reason IS NULL AND k LIKE '%so với%' THEN round((v95 - v94)::DOUBLE * 100 / v94::DOUBLE, 4) END AS percent, reason FROM r"""


def number_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals written in eight ways, each as the three readers take it."""
    k, total = F.col("o_orderkey") % 8, F.col("o_totalprice").cast("decimal(18,2)")
    commas, whole = F.format_number(total, 2), F.format_number(F.floor(total), 0)
    dots = F.translate(commas, ",.", ".,")
    written = (
        F.when(k == 0, commas).when(k == 1, dots).when(k == 2, whole).when(k == 3, F.translate(whole, ",", ".")).when(k == 4, F.concat(F.lit("("), dots, F.lit(")")))
        .when(k == 5, F.concat(F.lit("+"), total.cast("string"), F.lit("%"))).when(k == 6, F.concat(F.lit("-"), F.translate(total.cast("string"), ".", ","))).otherwise(F.concat(F.translate(whole, ",", "."), F.lit("x")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return rows.select("o_orderkey", "written", *(read(F.col("written")).cast("double").alias(name) for name, read in (("either", M.either_number), ("table", M.table_number), ("report", M.financial_number))))


VARIANTS_SQL = r"""WITH t AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_totalprice::DECIMAL(18,2) AS v FROM orders),
    f AS (SELECT o_orderkey, k, v, format('{:,.2f}', v::DOUBLE) AS c, format('{:,}', floor(v)::BIGINT) AS w FROM t),
    w AS (SELECT o_orderkey, CASE k WHEN 0 THEN c WHEN 1 THEN translate(c, ',.', '.,') WHEN 2 THEN w WHEN 3 THEN replace(w, ',', '.') WHEN 4 THEN '(' || translate(c, ',.', '.,') || ')' WHEN 5 THEN '+' || v || '%' WHEN 6 THEN '-' || replace(v::VARCHAR, '.', ',') ELSE replace(w, ',', '.') || 'x' END AS s FROM f),
    p AS (SELECT *, CASE WHEN regexp_full_match(s, '-?[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?') THEN replace(s, ',', '') WHEN regexp_full_match(s, '-?[0-9]{1,3}([.][0-9]{3})+(,[0-9]+)?') THEN replace(replace(s, '.', ''), ',', '.') ELSE replace(s, ',', '.') END AS e,
      replace(replace(regexp_replace(s, '[()]', '', 'g'), '.', ''), ',', '.') AS b, regexp_replace(s, '^[+]|[%xX]+$', '', 'g') AS r FROM w)
    SELECT o_orderkey, s AS written, TRY_CAST(e AS DECIMAL(38,6))::DOUBLE AS either, CASE WHEN regexp_full_match(s, '[(].*[)]') THEN -1 ELSE 1 END * TRY_CAST(b AS DECIMAL(38,6))::DOUBLE AS "table",
      TRY_CAST(CASE WHEN regexp_full_match(r, '[0-9]{1,3}([.][0-9]{3})+') THEN replace(r, '.', '') WHEN contains(r, ',') THEN replace(replace(r, '.', ''), ',', '.') ELSE r END AS DECIMAL(38,6))::DOUBLE AS report FROM p"""



def ocr_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a phrase put before them, in search form."""
    text = F.concat(F.lit("Tiên  tử dựng, đông ﬁ "), F.coalesce("text", F.lit("")))
    form = M.search_text(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(form).alias("form_md5"), F.size(M.search_terms(form)).cast("long").alias("n_terms"))


OCR_SQL = r"""WITH f AS (SELECT doc_id, trim(regexp_replace('tiền từ dụng, đồng fi ' || coalesce(text, ''), '\s+', ' ', 'g')) AS f FROM documents)
    SELECT doc_id, md5(f) AS form_md5, len(regexp_extract_all(lower(f), '[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*')) AS n_terms FROM f"""


def phrase_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold each of a few phrases as whole words, accents aside."""
    phrases = ["licence", "license", "der", "été", "thing"]
    docs = table(spark, sf_dir, "documents").select("doc_id", T.fold(F.coalesce("text", F.lit(""))).alias("f"))
    return docs.select("doc_id", *(M.holds_phrase(F.col("f"), F.lit(T.folded(p))).alias(f"has_{i}") for i, p in enumerate(phrases)))


_PHRASES = ["licence", "license", "der", "ete", "thing"]
PHRASE_SQL = r"WITH f AS (SELECT doc_id, strip_accents(lower(coalesce(text, ''))) AS f FROM documents) SELECT doc_id, " + ", ".join(rf"regexp_matches(f, '(^|[^\p{{L}}\p{{N}}_]){p}([^\p{{L}}\p{{N}}_]|$)') AS has_{i}" for i, p in enumerate(_PHRASES)) + " FROM f"


def alias_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of questions with their aliases; words without any stand for themselves."""
    aliases = spark.createDataFrame([("the", "der"), ("the", "le"), ("the", "the"), ("of", "von")], "term string, alias string")
    terms = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.slice(T.word_set(F.col("text")), 1, 5)).alias("term"))
    return M.expanded(terms, aliases, "term", "alias").select("item_id", "term", "aliases")


ALIAS_SQL = r"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_%]+') AS a FROM benchmark), u AS (SELECT item_id, unnest(list_filter(a, lambda v, i: list_position(a, v) = i)[:5]) AS term FROM t)
    SELECT item_id, term, CASE term WHEN 'the' THEN ['der', 'le', 'the'] WHEN 'of' THEN ['von'] ELSE [term] END AS aliases FROM u"""


def generic_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    heading = F.when(F.col("page_id") % 3 == 0, F.lit(" Mục  lục")).when(F.col("page_id") % 3 == 1, T.first_heading(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", M.is_generic(heading, ["mục lục", "phụ lục"]).alias("generic"))


GENERIC_SQL = r"SELECT page_id, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\s+', ' ', 'g')) = '' ELSE true END AS generic FROM pages"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of suppliers on the page of their nation, as their keys place them; every third is a value, others are texts."""
    k = F.col("s_suppkey")
    x0, y0 = (k * 37 % 500).cast("double"), (k * 101 % 900).cast("double")
    text = F.when(k % 4 == 0, F.lit("tăng 5%")).when(k % 4 == 1, F.lit("12 Tỷ đồng")).when(k % 4 == 2, F.lit("taxi")).otherwise(F.lit("lời nói"))
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("page"), k.cast("long").alias("id"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 60).alias("x1"), (y0 + 20).alias("y1"))


def detail_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return M.details_below(boxes.where("id % 3 = 0"), boxes.where("id % 3 <> 0"), "page")


BOXES_SQL = """WITH b AS (SELECT s_nationkey::BIGINT AS page, s_suppkey::BIGINT AS id, CASE s_suppkey % 4 WHEN 0 THEN 'tăng 5%' WHEN 1 THEN '12 Tỷ đồng' WHEN 2 THEN 'taxi' ELSE 'lời nói' END AS text, (s_suppkey * 37 % 500)::DOUBLE AS x0, (s_suppkey * 101 % 900)::DOUBLE AS y0 FROM supplier),
    p AS (SELECT v.page, v.id AS value_id, d.id, d.text, row_number() OVER (PARTITION BY v.page, v.id ORDER BY d.id) AS n FROM b v JOIN b d ON v.page = d.page AND v.id % 3 = 0 AND d.id % 3 <> 0 AND d.id % 4 < 2
      AND d.y0 - v.y0 - 20 BETWEEN 0 AND 230 AND (greatest(0, 60 - abs(d.x0 - v.x0)) / 60 >= 0.25 OR abs(d.x0 - v.x0) <= 100))
    SELECT page, value_id, list(text ORDER BY n) AS details FROM p WHERE n <= 3 GROUP BY ALL"""


def representation_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question against every representation of a short list; words of the test corpus play the intents."""
    kinds = F.explode(F.array(*map(F.lit, ("table_row", "block", "page", "narrative")))).alias("representation")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t"), kinds)
    return asked.select("item_id", "representation", M.representation_bonus(F.contains("t", F.lit("the ")), F.contains("t", F.lit("of ")), F.col("representation")).alias("bonus"))


BONUS_SQL = """WITH q AS (SELECT item_id, contains(lower(text), 'the ') AS n, contains(lower(text), 'of ') AS e, unnest(['table_row', 'block', 'page', 'narrative']) AS representation FROM benchmark)
    SELECT item_id, representation, CASE WHEN e THEN CASE representation WHEN 'table_row' THEN -0.03e0 WHEN 'block' THEN 0.03e0 WHEN 'narrative' THEN 0.05e0 ELSE 0e0 END
      WHEN n THEN CASE representation WHEN 'table_row' THEN 0.06e0 WHEN 'block' THEN 0.03e0 WHEN 'page' THEN -0.03e0 ELSE 0e0 END ELSE 0e0 END AS bonus FROM q"""


def entity_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of suppliers' sections, and which of a few is named in them."""
    k = F.col("s_suppkey")
    section = F.when(k % 3 == 0, F.concat(F.lit("Công ty "), "s_name")).when(k % 3 == 1, F.lit("Khối Bán lẻ")).otherwise(F.lit("Tổng quan"))
    entity = M.resolved_entity(section, F.lit("Tập đoàn Á"), "công ty", "khối")
    return table(spark, sf_dir, "supplier").select("s_suppkey", entity.alias("entity"), M.scope(T.fold(entity), [("retail", "bán lẻ"), ("group", "Tập đoàn")], "other").alias("scope"))


SCOPE_SQL = "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Công ty ' || s_name WHEN 1 THEN 'Tập đoàn Á — Khối Bán lẻ' ELSE 'Tập đoàn Á' END AS entity, CASE s_suppkey % 3 WHEN 0 THEN 'other' WHEN 1 THEN 'retail' ELSE 'group' END AS scope FROM supplier"


def automatic_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers to be compared with the turn before, by their own F1; some are refused, some golds and answers have a figure more."""
    t, key = F.col("turn"), ["conv_id", "turn", "role"]
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    pairs = table(spark, sf_dir, "conversations").withColumn("gold", before).where("gold is not null").select(*key, "text", "gold")
    rows = pairs.join(E.token_f1(pairs, key, "text", "gold"), key)
    gold = F.when(t % 3 != 2, F.concat("gold", F.when(t % 3 == 1, " 42").otherwise("")))
    verdict = M.automatic_correct(t % 4 != 3, t % 5 == 0, F.concat("text", F.when(t % 2 == 0, " 42").otherwise("")), gold, F.col("f1"))
    return rows.select(*key, "f1", verdict.alias("correct"))


CORRECT_SQL = rf"""WITH f AS ({F1_SQL}), p AS (SELECT conv_id, turn, role, text || CASE WHEN turn % 2 = 0 THEN ' 42' ELSE '' END AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role) || CASE WHEN turn % 3 = 1 THEN ' 42' ELSE '' END AS g FROM conversations),
    n AS (SELECT p.*, f1, len(list_filter(regexp_extract_all(lower(g), '{T.NUMBER}'), lambda v: NOT list_contains(regexp_extract_all(lower(a), '{T.NUMBER}'), v))) = 0 AS complete FROM p JOIN f ON p.conv_id = f.conv_id AND p.turn = f.turn AND p.role = f.role WHERE g IS NOT NULL)
    SELECT conv_id, turn, role, f1, CASE WHEN turn % 4 = 3 THEN turn % 5 = 0 WHEN turn % 3 <> 2 AND g <> '' THEN turn % 5 <> 0 AND complete AND f1 >= 0.45 END AS correct FROM n"""

QUERIES = {f.__name__: f for f in (metric_rows, metric_enrichment, metric_answer, number_variants, ocr_normalise, phrase_containment, alias_expansion, generic_headings, detail_boxes, representation_bonus, entity_scope, automatic_correct)}
ORACLES = {
    "metric_rows": ROWS_SQL, "metric_enrichment": ENRICHMENT_SQL, "metric_answer": ANSWER_SQL, "number_variants": VARIANTS_SQL, "ocr_normalise": OCR_SQL, "phrase_containment": PHRASE_SQL, "alias_expansion": ALIAS_SQL,
    "generic_headings": GENERIC_SQL, "detail_boxes": BOXES_SQL, "representation_bonus": BONUS_SQL, "entity_scope": SCOPE_SQL, "automatic_correct": CORRECT_SQL,
}
