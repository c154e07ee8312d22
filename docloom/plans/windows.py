"""Queries of window functions and of selection over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.operators import conversation as V
from docloom.operators import retrieval as R
from docloom.operators import selection as S
from docloom.plans.retrieval import BM25_SQL, bm25_topk
from docloom.sources.tables import table


def rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ranking function over documents of a language by length."""
    return S.rank_hot_groups(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", "n_chars", "doc_id", 4).select("doc_id", "rn", "rk", "dr", "quartile")


RANK_SQL = "SELECT doc_id, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER t AS INT) AS rk, CAST(dense_rank() OVER t AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS quartile FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC, doc_id), t AS (PARTITION BY lang ORDER BY n_chars DESC)"


def heading_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last system or first-turn text of a conversation holds for the turns after it."""
    turns = table(spark, sf_dir, "conversations").withColumn("h", F.when((F.col("role") == "system") | (F.col("turn") % 3 == 0), F.col("text")).otherwise(F.lit("")))
    return C.inherit_headings(turns, ["conv_id"], ["turn", "role"], "h").select("conv_id", "turn", "role", F.md5("section").alias("section"))


FFILL_SQL = "SELECT conv_id, turn, role, md5(last_value(CASE WHEN role = 'system' OR turn % 3 = 0 THEN nullif(text, '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS section FROM conversations"


def heading_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("turn") % 4 == 0, "title").when(F.col("turn") % 4 == 1, "subtitle").otherwise("text")
    turns = table(spark, sf_dir, "conversations").withColumn("kind", kind)
    out = C.headings_with_reset(turns, ["conv_id"], ["turn", "role"], "kind", "text")
    return out.select("conv_id", "turn", "role", F.md5("title").alias("title"), F.md5("subtitle").alias("subtitle"))


RESET_SQL = """WITH k AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'subtitle' ELSE 'text' END AS kind FROM conversations),
    p AS (SELECT *, count(*) FILTER (kind = 'title') OVER w AS part, last_value(CASE WHEN kind = 'title' THEN text END IGNORE NULLS) OVER w AS t FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, turn, role, md5(t) AS title, md5(last_value(CASE WHEN kind = 'subtitle' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, part ORDER BY turn, role ROWS UNBOUNDED PRECEDING)) AS subtitle FROM p"""


def lookahead_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines as labels: the next line is the value, and up to three after it are details until the next label."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    label = F.length("line") < 40
    seen = lines.select("doc_id", "pos", "line", label.alias("is_label"), *(F.lead("line", k).over(w).alias(f"n{k}") for k in range(1, 5)))
    stops = [F.coalesce(F.length(f"n{k}") < 40, F.lit(True)) for k in range(2, 5)]
    details = F.when(stops[0], 0).when(stops[1], 1).when(stops[2], 2).otherwise(3)
    return seen.where("is_label and n1 is not null").select("doc_id", "pos", F.md5("n1").alias("value_md5"), details.alias("details"))


LOOKAHEAD_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
    s AS (SELECT *, lead(line, 1) OVER w AS n1, lead(line, 2) OVER w AS n2, lead(line, 3) OVER w AS n3, lead(line, 4) OVER w AS n4 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, CAST(pos AS INT) AS pos, md5(n1) AS value_md5, CASE WHEN coalesce(length(n2) < 40, true) THEN 0 WHEN coalesce(length(n3) < 40, true) THEN 1 WHEN coalesce(length(n4) < 40, true) THEN 2 ELSE 3 END AS details FROM s WHERE length(line) < 40 AND n1 IS NOT NULL"""


def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.last_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


HISTORY_SQL = "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 4"


def last_user_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.with_anchor(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.md5("anchor").alias("anchor"))


ANCHOR_SQL = "SELECT conv_id, turn, role, md5(last_value(CASE WHEN role = 'user' AND NOT regexp_matches(lower(text), '^(and|what about|it|that|this|those) ') THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS anchor FROM conversations"


def multi_reference_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three distinct questions of each conversation that stand alone."""
    return V.last_questions(table(spark, sf_dir, "conversations"), 3).select("conv_id", "position", F.md5("text").alias("text_md5"))


MULTI_SQL = """WITH q AS (SELECT conv_id, text, max(turn) AS turn FROM conversations WHERE role = 'user' AND NOT regexp_matches(lower(text), '^(and|what about|it|that|this|those) ') GROUP BY conv_id, text)
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS INT) AS position, md5(text) AS text_md5 FROM q QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) <= 3"""


def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rankings of questions n and n + 1 interleaved."""
    found = bm25_topk(spark, sf_dir)
    rows = found.select(F.floor(F.col("item_id") / 2).cast("long").alias("pair"), (F.col("item_id") % 2).alias("turn"), "rank", "doc_id")
    return S.round_robin(rows, ["pair"], "doc_id", "rank", "turn").select("pair", "position", "doc_id")


ROBIN_SQL = f"""WITH f AS ({BM25_SQL}), g AS (SELECT item_id // 2 AS pair, item_id % 2 AS turn, rank, doc_id FROM f),
    d AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY pair, doc_id ORDER BY rank, turn) = 1)
    SELECT pair, CAST(row_number() OVER (PARTITION BY pair ORDER BY rank, turn, doc_id) AS INT) AS position, doc_id FROM d"""


def score_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25_topk(spark, sf_dir)
    by = ["item_id"]
    return found.select("item_id", "doc_id", F.round(R.share_of_best("score", by), 6).alias("share"), F.round(R.min_max("score", by), 6).alias("min_max"), F.round(R.relevance("score", by), 6).alias("relevance"))


NORMALISE_SQL = f"""WITH f AS ({BM25_SQL}), w AS (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi FROM f WINDOW p AS (PARTITION BY item_id))
    SELECT item_id, doc_id, round(score / hi, 6) AS share, round(CASE WHEN hi = lo THEN 1e0 ELSE (score - lo) / (hi - lo) END, 6) AS min_max,
    round(CASE WHEN hi = lo THEN 1e0 WHEN lo >= 0 AND hi > 0 THEN score / hi ELSE (score - lo) / (hi - lo) END, 6) AS relevance FROM w"""


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each question within 6 rows and 5000 tokens; what does not fit is passed over."""
    found = bm25_topk(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens")), "doc_id")
    return S.token_budget(found, ["item_id"], ["rank"], "doc_id", "tokens", 6, 5000)


BUDGET_SQL = f"""WITH RECURSIVE f AS ({BM25_SQL}), x AS (SELECT item_id, rank, doc_id, CAST(greatest(1, ceil(strlen(text) / 4.0e0)) AS BIGINT) AS n FROM f JOIN documents USING (doc_id)),
    r AS (SELECT item_id, 0 AS rank, 0::BIGINT AS used, 0 AS kept, NULL::BIGINT AS doc_id, false AS taken FROM (SELECT DISTINCT item_id FROM x)
      UNION ALL SELECT x.item_id, x.rank, CASE WHEN kept < 6 AND used + n <= 5000 THEN used + n ELSE used END, CASE WHEN kept < 6 AND used + n <= 5000 THEN kept + 1 ELSE kept END, x.doc_id, kept < 6 AND used + n <= 5000
      FROM r JOIN x ON x.item_id = r.item_id AND x.rank = r.rank + 1)
    SELECT item_id, CAST(kept - 1 AS INT) AS position, doc_id FROM r WHERE taken"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), "doc_id")


def page_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two candidates of a source, none too similar to another of it."""
    return S.dedup_by_page(_pool(spark, sf_dir), ["item_id"], "source", "doc_id", "score", "text").select("item_id", "source", "doc_id")


DEDUP_SQL = rf"""WITH RECURSIVE f AS ({BM25_SQL}), x AS (SELECT item_id, source, doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_%]+')) AS w,
      row_number() OVER (PARTITION BY item_id, source ORDER BY score DESC, doc_id) AS n FROM f JOIN documents USING (doc_id)),
    r AS (SELECT item_id, source, n, [doc_id] AS kept, [w] AS ws FROM x WHERE n = 1
      UNION ALL SELECT r.item_id, r.source, x.n, CASE WHEN ok THEN list_append(kept, doc_id) ELSE kept END, CASE WHEN ok THEN list_append(ws, w) ELSE ws END
      FROM (SELECT r.*, x.n AS m, x.doc_id, x.w, len(kept) < 2 AND len(list_filter(ws, lambda k: greatest(len(list_intersect(k, w))::DOUBLE / (len(k) + len(w) - len(list_intersect(k, w))), len(list_intersect(k, w))::DOUBLE / least(len(k), len(w))) >= 0.88e0)) = 0 AS ok
            FROM r JOIN x ON x.item_id = r.item_id AND x.source = r.source AND x.n = r.n + 1) r JOIN (SELECT item_id, source, n FROM x) x ON x.item_id = r.item_id AND x.source = r.source AND x.n = r.m)
    SELECT item_id, source, unnest(kept) AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id, source ORDER BY n DESC) AS last FROM r) WHERE last = 1"""


def mmr_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diverse candidates of each question, direct matches kept."""
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return S.diverse(_pool(spark, sf_dir).join(asked, "item_id"), "item_id", "doc_id", "source", "lang", "score", "text", 5, question="question")


def set_cover_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts are a question's first words; evidence covers each once before it fills up."""
    facts = table(spark, sf_dir, "benchmark").select("item_id", F.slice(T.word_set(F.col("text")), 1, 6).alias("want"))
    rows = _pool(spark, sf_dir).join(facts, "item_id").withColumn("facts", F.array_intersect("want", T.word_set(F.col("text"))))
    return S.cover(rows, "item_id", "doc_id", "rank", "facts", 5)


QUERIES = {f.__name__: f for f in (rank_all, heading_ffill, heading_reset, lookahead_lines, history_last_n, last_user_anchor, multi_reference_queries, round_robin_merge, score_normalise, token_budget, page_dedup, mmr_diversity, set_cover_evidence)}
ORACLES = {
    "rank_all": RANK_SQL, "heading_ffill": FFILL_SQL, "heading_reset": RESET_SQL, "lookahead_lines": LOOKAHEAD_SQL, "history_last_n": HISTORY_SQL, "last_user_anchor": ANCHOR_SQL, "multi_reference_queries": MULTI_SQL,
    "round_robin_merge": ROBIN_SQL, "score_normalise": NORMALISE_SQL, "token_budget": BUDGET_SQL, "page_dedup": DEDUP_SQL,
}
