"""Queries over answers and decisions that models give, and what is done where they are wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import answering as W
from docloom.operators import routing as RT
from docloom.plans.retrieval import _POOL, _nonyears, _pool
from docloom.sources.tables import table

SETTINGS = W.AnswerSettings(k=3, least=1.0)


def answer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered by a stand-in that cites nothing, a page it was not shown, a figure of its own, or well; a second one mends half of what fails."""
    pool = _pool(spark, sf_dir, 20).where("rank <= 3").select(F.col("item_id").alias("query"), "rank", F.col("doc_id").alias("page"), "score", "text")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    best = pool.where("rank = 1").select("query", F.left(F.split("text", "\n")[0], F.lit(120)).alias("line"), F.concat(F.lit(" [p. "), F.col("page").cast("string"), F.lit("]")).alias("cited"))
    m = F.col("query") % 5
    first = F.when(m == 0, F.col("line")).when(m == 1, F.concat("line", F.lit(" [p. 999999999]"))).when(m == 2, F.concat("line", F.lit(" 7777777"), "cited")).when(m == 3, F.concat("line", "cited")).otherwise(F.lit("Không đủ thông tin."))
    write = lambda prompts: prompts.join(best, "query").select("query", first.alias("reply"))
    mended = F.when(F.col("query") % 10 < 5, F.concat("line", "cited")).otherwise(F.col("line"))
    repair = lambda prompts: prompts.join(best, "query").select("query", mended.alias("reply"))
    out = W.answered(questions, pool, write, repair, SETTINGS)
    return out.select(F.col("query").alias("item_id"), F.md5("answer").alias("answer"), "citations", "refused", "valid", "mode", "calls")


REPAIR_SQL = rf"""WITH {_POOL}, e AS (SELECT item_id, max(score) AS top, list({{'p': doc_id, 't': t}} ORDER BY rank) AS l FROM pool WHERE rank <= 3 GROUP BY item_id),
    b AS (SELECT b.item_id, coalesce(top >= 1, false) AS heard, l, left(string_split(l[1].t, chr(10))[1], 120) AS line, ' [p. ' || l[1].p || ']' AS c FROM benchmark b LEFT JOIN e USING (item_id)),
    w AS (SELECT *, CASE item_id % 5 WHEN 0 THEN line WHEN 1 THEN line || ' [p. 999999999]' WHEN 2 THEN line || ' 7777777' || c WHEN 3 THEN line || c ELSE 'Không đủ thông tin.' END AS r1, CASE WHEN item_id % 10 < 5 THEN line || c ELSE line END AS r2 FROM b),
    x AS (SELECT item_id, heard, 1 AS k, r1 AS r, l FROM w UNION ALL SELECT item_id, heard, 2, r2, l FROM w),
    y AS (SELECT *, list_distinct(list_transform(regexp_extract_all(r, '\[p\. ?([0-9]+)\]', 1), lambda v: v::BIGINT)) AS cs, contains(lower(r), 'không đủ thông tin') AS ref, {_nonyears(r"regexp_replace(r, '\[p\. ?[0-9]+(?:, ?[0-9]+)*\]', '', 'g')")} AS ns FROM x),
    z AS (SELECT *, len(list_filter(cs, lambda v: NOT list_contains(list_transform(l, lambda a: a.p), v))) = 0 AS known, regexp_replace(lower(array_to_string(list_transform(list_filter(l, lambda a: list_contains(cs, a.p)), lambda a: a.t), ' ')), '\s', '', 'g') AS rd FROM y),
    v AS (SELECT *, CASE WHEN ref THEN known ELSE len(cs) > 0 AND known AND len(list_filter(ns, lambda n: NOT contains(rd, n))) = 0 END AS ok FROM z),
    o AS (SELECT a.item_id, a.heard, a.ok AS ok1, b.ok AS ok2, a.r AS r1, b.r AS r2, a.cs AS c1, b.cs AS c2, a.ref AS f1, b.ref AS f2 FROM v a JOIN v b ON a.item_id = b.item_id AND a.k = 1 AND b.k = 2)
    SELECT item_id, md5(CASE WHEN NOT heard THEN '{SETTINGS.refusal}' WHEN ok1 THEN r1 WHEN ok2 THEN r2 ELSE '{SETTINGS.closed}' END) AS answer,
      CASE WHEN NOT heard THEN [] WHEN ok1 THEN c1 WHEN ok2 THEN c2 ELSE [] END AS citations, CASE WHEN NOT heard THEN true WHEN ok1 THEN f1 WHEN ok2 THEN f2 ELSE true END AS refused, NOT heard OR ok1 OR ok2 AS valid,
      CASE WHEN NOT heard THEN 'no_evidence' WHEN ok1 THEN 'written' WHEN ok2 THEN 'repaired' ELSE 'closed' END AS mode, CASE WHEN NOT heard THEN 0 WHEN ok1 THEN 1 ELSE 2 END AS calls FROM o"""


def _reply(length: Column) -> Column:
    """A router's reply that depends on how long the question is."""
    confidence = F.concat(F.lit("0."), F.lpad((length % 100).cast("string"), 2, "0"))
    head = F.concat(F.lit('{"route": "narrative", "confidence": '), confidence)
    m = length % 7
    return (
        F.when(m == 0, F.concat(head, F.lit(', "reasons": "asks why"}'))).when(m == 1, F.concat(F.lit("Sure: "), head, F.lit(', "reasons": [" a ", "b", "c", "d", "e"]} done'))).when(m == 2, F.concat(head, F.lit(', "reasons": []}')))
        .when(m == 3, F.lit('{"route": "elsewhere", "confidence": 1, "reasons": ["x"]}')).when(m == 4, F.lit('{"route": "structured", "confidence": true, "reasons": ["x"]}')).when(m == 5, F.lit("no object")).otherwise(F.concat(head, F.lit(', "reasons": ["x"], "query_features": {"has_year": true}}')))
    )


def router_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router decisions for every document as a question, from replies whose form follows from its length."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    decision = RT.router_decision(_reply(F.length("text")), tuple(RT.ROUTES), ("has_year",))
    return docs.select("doc_id", decision.alias("d")).select("doc_id", "d.*")


ROUTER_SQL = f"""WITH d AS (SELECT doc_id, length(text) % 7 AS m, (length(text) % 100) / 100e0 AS c FROM documents WHERE text IS NOT NULL),
    e AS (SELECT *, CASE m WHEN 2 THEN 'no reasons' WHEN 3 THEN 'unknown route' WHEN 4 THEN 'confidence is no number' WHEN 5 THEN 'no JSON object' END AS error,
      CASE m WHEN 0 THEN ['asks why'] WHEN 1 THEN ['a', 'b', 'c', 'd'] ELSE ['x'] END AS told, 'confidence ' || format('{{:.3f}}', c) || ' below 0.500; instead of narrative' AS low FROM d)
    SELECT doc_id, CASE WHEN error IS NOT NULL OR c < 0.5 THEN '{RT.FALLBACK}' ELSE 'narrative' END AS route, CASE WHEN error IS NOT NULL THEN 0e0 ELSE c END AS confidence,
      CASE WHEN error IS NOT NULL THEN [error] WHEN c < 0.5 THEN list_append(told, low) ELSE told END AS reasons,
      CASE WHEN error IS NOT NULL THEN 'error_fallback' WHEN c < 0.5 THEN 'low_confidence_fallback' WHEN m = 0 THEN 'model_normalized' ELSE 'model' END AS source,
      CASE WHEN error IS NULL THEN 'narrative' END AS raw_route, CASE WHEN error IS NOT NULL THEN error WHEN c < 0.5 THEN low END AS why FROM e"""

QUERIES = {f.__name__: f for f in (answer_repair, router_contract)}
ORACLES = {"answer_repair": REPAIR_SQL, "router_contract": ROUTER_SQL}
