"""Queries of routing, coverage and financial reasoning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators import adaptive as A
from docloom.operators import agent as AG
from docloom.operators import coverage as COV
from docloom.operators import finance as FI
from docloom.operators import retrieval as R
from docloom.operators import routing as RT
from docloom.plans.retrieval import _POOL, _bm25_sql, _nonyears, _pool, _years, index
from docloom.sources.tables import table

#: Words of the test corpus in the parts of a question lexicon.
LEXICON = {"metric": ["the", "and"], "comparison": ["with"], "ratio": ["er"], "lookup": ["of"], "explanatory": ["that"], "followup": ["is", "a"], "entity": ["thing", "tion", "able"]}
_FLAGS = {"has_metric": "metric", "has_comparison": "comparison", "has_ratio": "ratio", "has_lookup": "lookup", "is_explanatory": "explanatory"}


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RT.features(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", LEXICON)


def route_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.col(f"n_{x}").cast("long").alias(f"n_{x}") for x in ("metric", "entity")]
    return _features(spark, sf_dir).select("item_id", "has_number", "has_year", *counts, *_FLAGS, "is_followup")


def _any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + ")"


def _n(terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower(text), '{t}')::BIGINT" for t in terms) + ")"


_FEATURES = f"""feat AS (SELECT item_id, regexp_matches(text, '[0-9]') AS has_number, len({_years('text')}) > 0 AS has_year, {_n(LEXICON['metric'])} AS n_metric, {_n(LEXICON['entity'])} AS n_entity,
    {', '.join(f'{_any(LEXICON[v])} AS {k}' for k, v in _FLAGS.items())}, len(regexp_extract_all(lower(text), '{T.LEXICAL}')) <= 6 AND {_any(LEXICON['followup'])} AS is_followup FROM benchmark)"""
FEATURES_SQL = f"WITH {_FEATURES} SELECT * FROM feat"


def route_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RT.route(_features(spark, sf_dir)).select("item_id", "route", "confidence")


def _route_sql() -> str:
    def test(r: RT.Rule) -> str:
        return " AND ".join([*r.all, *(f"NOT {x}" for x in r.none), *(f"n_{k} >= {v}" for k, v in r.min_counts.items())])

    scores = ", ".join(f"round(least(1e0, greatest(0e0, {r.base}e0" + "".join(f" + CASE WHEN {test(x)} THEN {x.add}e0 ELSE 0e0 END" for x in r.rules) + f")), 6) AS s_{n}" for n, r in RT.ROUTES.items())
    best = "greatest(" + ", ".join(f"s_{n}" for n in RT.ROUTES) + ")"
    pick = "CASE " + f"WHEN {best} < {RT.THRESHOLD} THEN '{RT.FALLBACK}' " + " ".join(f"WHEN s_{n} = {best} THEN '{n}'" for n in RT.ROUTES) + " END"
    return f"WITH {_FEATURES}, sc AS (SELECT item_id, {scores} FROM feat) SELECT item_id, {pick} AS route, {best} AS confidence FROM sc"


def llm_route_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a router model might give, valid and not."""
    raw = (
        F.when(F.col("item_id") % 4 == 0, F.concat(F.lit('Sure: {"route": "narrative", "confidence": 0.'), (F.col("item_id") % 9 + 1).cast("string"), F.lit(', "reasons": []} done')))
        .when(F.col("item_id") % 4 == 1, F.lit('{"route": "elsewhere", "confidence": 0.9}')).when(F.col("item_id") % 4 == 2, F.lit("{broken")).otherwise(F.lit('{"route": "structured", "confidence": 0.8}'))
    )
    plan = RT.validated_plan(raw, tuple(RT.ROUTES))
    return table(spark, sf_dir, "benchmark").select("item_id", plan.alias("p")).select("item_id", "p.route", "p.confidence", "p.source")


VALIDATE_SQL = """WITH b AS (SELECT item_id, item_id % 4 AS m, (item_id % 9 + 1) / 10.0e0 AS c FROM benchmark)
    SELECT item_id, CASE WHEN m = 0 AND c >= 0.5 THEN 'narrative' WHEN m = 3 THEN 'structured' ELSE 'multi_repr' END AS route, CASE WHEN m = 0 AND c >= 0.5 THEN c WHEN m = 3 THEN 0.8e0 END AS confidence,
    CASE WHEN (m = 0 AND c >= 0.5) OR m = 3 THEN 'model' ELSE 'fallback' END AS source FROM b"""

FACTS = {"first": [["the", "der"], ["and", "und"]], "second": [["licen"]], "third": [["idiot", "trash", "clown"]]}


def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return COV.fact_coverage(_pool(spark, sf_dir, 20), "item_id", "rank", "source", "text", FACTS)


def _facts_sql() -> str:
    tests = {f: " AND ".join("(" + " OR ".join(f"contains(strip_accents(lower(t)), '{x}')" for x in g) + ")" for g in groups) for f, groups in FACTS.items()}
    union = " UNION ALL ".join(f"SELECT item_id, '{f}' AS fact, rank, source FROM pool WHERE {t}" for f, t in tests.items())
    return f"""WITH {_POOL}, f AS ({union}), g AS (SELECT item_id, fact, source, min(rank) AS r FROM f GROUP BY ALL), p AS (SELECT item_id, fact, list(source ORDER BY r) AS pages FROM g GROUP BY ALL),
    w AS (SELECT DISTINCT item_id, fact FROM pool, (VALUES ('first'), ('second'), ('third')) x(fact))
    SELECT w.item_id, w.fact, coalesce(pages, []) AS pages, pages IS NOT NULL AS covered FROM w LEFT JOIN p ON p.item_id = w.item_id AND p.fact = w.fact"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions dressed up to ask for numbers, years and comparisons, with their best three candidates."""
    pool = _pool(spark, sf_dir, 20).where("rank <= 3")
    asked = F.concat("query_text", F.when(F.col("item_id") % 3 == 0, F.lit(" how many in 2021")).when(F.col("item_id") % 3 == 1, F.lit(" compare 2019 with 2020")).otherwise(F.lit("")))
    return pool.withColumn("asked", asked)


def sufficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return COV.sufficiency(_evidence(spark, sf_dir), "item_id", "asked", "text", "base", ["thing", "licen", "with"])


_SUFFICIENT = f"""{_POOL}, e AS (SELECT item_id, any_value(q || CASE item_id % 3 WHEN 0 THEN ' how many in 2021' WHEN 1 THEN ' compare 2019 with 2020' ELSE '' END) AS q, string_agg(t, chr(10) ORDER BY rank) AS t, max(base) AS s FROM pool WHERE rank <= 3 GROUP BY item_id),
    y AS (SELECT *, list_filter(regexp_extract_all(q, '[0-9]+'), lambda v, i: regexp_matches(v, '^(19|20)[0-9]{{2}}$') AND list_position(regexp_extract_all(q, '[0-9]+'), v) = i) AS ys, list_filter(['thing', 'licen', 'with'], lambda v: contains(lower(q), v)) AS ts, len({_nonyears('t')}) AS n, regexp_matches(lower(q), 'how (many|much)') AS num FROM e),
    z AS (SELECT *, contains(lower(q), 'compare') OR len(ys) >= 2 AS cmp FROM y),
    m AS (SELECT *, list_concat(list_concat(list_transform(list_filter(ys, lambda v: NOT contains(t, v)), lambda v: 'year:' || v), list_transform(list_filter(ts, lambda v: NOT contains(lower(t), v)), lambda v: 'term:' || v)),
      list_concat(CASE WHEN num AND n = 0 THEN ['numeric_value'] ELSE [] END, CASE WHEN cmp AND n < 2 THEN ['comparison_values'] ELSE [] END)) AS missing, len(ys) + len(ts) + num::INT + cmp::INT + 1 AS checks FROM z)"""
SUFFICIENCY_SQL = f"WITH {_SUFFICIENT} SELECT item_id, len(missing) = 0 AND s >= 0.5 AS sufficient, round((checks - len(missing) - (s < 0.5)::INT)::DOUBLE / checks, 6) AS confidence, missing FROM m"


def followup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(spark, sf_dir)
    missing = COV.sufficiency(evidence, "item_id", "asked", "text", "base", ["thing", "licen", "with"])
    asked = evidence.where("rank = 1").select("item_id", "asked")
    return missing.where("not sufficient").join(asked, "item_id").select("item_id", COV.follow_up(F.col("missing"), F.lit("figures"), T.years(F.col("asked"))).alias("query"))


FOLLOWUP_SQL = f"""WITH {_SUFFICIENT}, x AS (SELECT *, list_transform(list_filter(missing, lambda v: starts_with(v, 'year:')), lambda v: substr(v, 6)) AS my, list_transform(list_filter(missing, lambda v: starts_with(v, 'term:')), lambda v: substr(v, 6)) AS mt, array_to_string(ys, ' ') AS yt FROM m WHERE NOT (len(missing) = 0 AND s >= 0.5))
    SELECT item_id, trim(CASE WHEN len(my) > 0 THEN 'figures in ' || array_to_string(my, ' ') || ' exact figures' WHEN len(mt) > 0 THEN array_to_string(mt, ' ') || ' ' || yt || ' report'
      WHEN list_contains(missing, 'comparison_values') THEN 'figures ' || yt || ' figures of the year before' WHEN list_contains(missing, 'numeric_value') THEN 'figures ' || yt || ' table of figures' ELSE 'figures ' || yt || ' report' END) AS query FROM x"""

INTENTS = [("growth", "er"), ("plan", "tion"), ("share", "ing"), ("other", "")]


def intent_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule whose pattern a question matches; rules are a few rows of configuration."""
    rules = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(INTENTS)], "ord int, intent string, pattern string")
    found = table(spark, sf_dir, "benchmark").join(F.broadcast(rules), F.contains(F.lower("text"), F.concat("pattern", F.lit(" "))) | (F.col("pattern") == ""))
    return found.groupBy("item_id").agg(F.min_by("intent", "ord").alias("intent"))


INTENT_SQL = "SELECT item_id, CASE " + " ".join(f"WHEN contains(lower(text), '{p} ') THEN '{n}'" for n, p in INTENTS[:-1]) + " ELSE 'other' END AS intent FROM benchmark"


def financial_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose language fits first, then by facts, score and place: base + .32 facts + .18 overlap with the first words + .08 numeric density - 1.25 mismatch."""
    pool = _pool(spark, sf_dir, 20)
    facts = sum((COV.has_fact(F.col("text"), g).cast("int") for g in FACTS.values()), F.lit(0))
    heading, words = F.slice(T.word_set(F.col("text")), 1, 8), T.word_set(F.col("query_text"))
    overlap = F.size(F.array_intersect(heading, words)) / F.greatest(F.lit(1), F.size(words))
    density = F.least(F.lit(1.0), F.size(T.non_year_numbers(F.col("text"))) / F.lit(10.0))
    mismatch = (F.col("lang") != "en").cast("int")
    scored = pool.withColumn("facts", facts).withColumn("mismatch", mismatch).withColumn("place", F.col("rank"))
    scored = scored.withColumn("rank_score", F.round(F.col("base") + 0.32 * (F.col("facts") / 3.0) + 0.18 * overlap + 0.08 * density - 1.25 * F.col("mismatch"), 6)).drop("rank")
    order = [F.asc("mismatch"), F.desc("facts"), F.desc("rank_score"), F.asc("place")]
    return R.top_k(scored, 10, ["item_id"], order).select("item_id", "rank", "doc_id", "rank_score")


def _rank_sql() -> str:
    facts = " + ".join("(" + " AND ".join("(" + " OR ".join(f"contains(strip_accents(lower(t)), '{x}')" for x in g) + ")" for g in groups) + ")::INT" for groups in FACTS.values())
    return rf"""WITH {_POOL}, w AS (SELECT *, regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_%]+') AS ta, list_distinct(regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}_%]+')) AS qw, {facts} AS facts, (lang <> 'en')::INT AS mismatch FROM pool),
    s AS (SELECT *, round(base + 0.32e0 * (facts / 3.0e0) + 0.18e0 * (len(list_intersect(list_filter(ta, lambda v, i: list_position(ta, v) = i)[:8], qw))::DOUBLE / greatest(1, len(qw))) + 0.08e0 * least(1e0, len({_nonyears('t')}) / 10.0e0) - 1.25e0 * mismatch, 6) AS rank_score FROM w)
    SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY mismatch, facts DESC, rank_score DESC, rank) AS INT) AS rank, doc_id, rank_score FROM s) WHERE rank <= 10"""


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals of each priority and year, in exact decimals."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return orders.groupBy("o_orderpriority", "year").agg(F.sum("v").alias("v"))


_YEARLY = "y AS (SELECT o_orderpriority, CAST(year(o_orderdate) AS INT) AS year, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders GROUP BY ALL)"


def growth_calc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change to the year before and what that growth implies for it."""
    w = Window.partitionBy("o_orderpriority").orderBy("year")
    rows = _yearly(spark, sf_dir).withColumn("old", F.lag("v").over(w).cast("double")).withColumn("new", F.col("v").cast("double"))
    change = N.change_percent(F.col("old"), F.col("new"))
    return rows.select("o_orderpriority", "year", F.round(change, 6).alias("growth"), F.round(N.prior_value(F.col("new"), change), 2).alias("prior"))


GROWTH_SQL = f"""WITH {_YEARLY}, l AS (SELECT *, v::DOUBLE AS new, lag(v) OVER (PARTITION BY o_orderpriority ORDER BY year)::DOUBLE AS old FROM y), c AS (SELECT *, (new - old) * 100 / abs(old) AS ch FROM l)
    SELECT o_orderpriority, year, round(ch, 6) AS growth, round(new / (1 + ch / 100), 2) AS prior FROM c"""


def plan_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual less plan, where the plan is the year before plus a tenth."""
    w = Window.partitionBy("o_orderpriority").orderBy("year")
    rows = _yearly(spark, sf_dir).withColumn("plan", F.lag("v").over(w).cast("double") * 1.1)
    return rows.where("plan is not null").select("o_orderpriority", "year", F.round(F.col("v").cast("double") - F.col("plan"), 2).alias("variance"))


VARIANCE_SQL = f"WITH {_YEARLY}, l AS (SELECT *, lag(v) OVER (PARTITION BY o_orderpriority ORDER BY year)::DOUBLE * 1.1e0 AS plan FROM y) SELECT o_orderpriority, year, round(v::DOUBLE - plan, 2) AS variance FROM l WHERE plan IS NOT NULL"


def pp_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each priority's share of its year's total, in percentage points."""
    total = Window.partitionBy("year")
    rows = _yearly(spark, sf_dir).withColumn("share", F.col("v").cast("double") / F.sum(F.col("v").cast("double")).over(total))
    w = Window.partitionBy("o_orderpriority").orderBy("year")
    rows = rows.withColumn("old", F.lag("share").over(w)).where("old is not null")
    return rows.select("o_orderpriority", "year", F.round(N.points_difference(F.col("old"), F.col("share")), 6).alias("points"))


POINTS_SQL = f"WITH {_YEARLY}, s AS (SELECT *, v::DOUBLE / sum(v::DOUBLE) OVER (PARTITION BY year) AS share FROM y), l AS (SELECT *, lag(share) OVER (PARTITION BY o_orderpriority ORDER BY year) AS old FROM s) SELECT o_orderpriority, year, round((share - old) * 100, 6) AS points FROM l WHERE old IS NOT NULL"


def cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _yearly(spark, sf_dir).groupBy("o_orderpriority").agg(F.min_by("v", "year").cast("double").alias("a"), F.max_by("v", "year").cast("double").alias("b"), (F.max("year") - F.min("year")).cast("double").alias("n"))
    return ends.select("o_orderpriority", F.round(N.cagr_percent(F.col("a"), F.col("b"), F.col("n")), 6).alias("cagr"))


CAGR_SQL = f"WITH {_YEARLY}, e AS (SELECT o_orderpriority, arg_min(v, year)::DOUBLE AS a, arg_max(v, year)::DOUBLE AS b, (max(year) - min(year))::DOUBLE AS n FROM y GROUP BY 1) SELECT o_orderpriority, round((pow(b / a, 1 / n) - 1) * 100, 6) AS cagr FROM e"


def tool_calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences whose operands stand in the text of the page, word for word; null where one does not."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    page = F.concat(F.lit("total "), F.col("v").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" tax 10.00")).otherwise(F.lit("")))
    there = F.contains(page, F.col("v").cast("string")) & F.contains(page, F.lit("10.00"))
    return orders.select("o_orderkey", F.when(there, F.round(F.col("v").cast("double") - 10, 2)).alias("difference"))


CALCULATOR_SQL = """WITH v AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS v FROM orders), p AS (SELECT *, 'total ' || v::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN ' tax 10.00' ELSE '' END AS page FROM v)
    SELECT o_orderkey, CASE WHEN contains(page, v::VARCHAR) AND contains(page, '10.00') THEN round(v::DOUBLE - 10, 2) END AS difference FROM p"""


def canonical_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a question's candidates, the page that an answer made of the first one's beginning should cite."""
    pool = _pool(spark, sf_dir, 20)
    answers = pool.where("rank = 1").select("item_id", F.left("text", F.lit(200)).alias("answer"))
    return COV.canonical_pages(pool.select("item_id", "doc_id", "text"), answers, "item_id", "doc_id", "text", "answer")


CITATION_SQL = rf"""WITH {_POOL}, a AS (SELECT item_id, left(t, 200) AS a FROM pool WHERE rank = 1),
    x AS (SELECT p.item_id, p.doc_id, lower(t) AS t, list_filter(list_distinct(regexp_extract_all(lower(a), '[\p{{L}}\p{{N}}_%]+')), lambda w: length(w) > 1 AND NOT regexp_matches(w, '^[0-9]+%?$')) AS ws, {_nonyears('a')} AS ns FROM pool p JOIN a USING (item_id)),
    s AS (SELECT item_id, doc_id, CASE WHEN len(ws) = 0 THEN 0e0 ELSE len(list_intersect(ws, regexp_extract_all(t, '[\p{{L}}\p{{N}}_%]+')))::DOUBLE / len(ws) END AS share FROM x WHERE len(list_filter(ns, lambda n: NOT contains(t, n))) = 0),
    b AS (SELECT *, max(share) OVER (PARTITION BY item_id) AS best FROM s WHERE share >= 0.62e0) SELECT item_id, min(doc_id) AS doc_id FROM b WHERE share >= best - 0.05e0 GROUP BY item_id"""


def numeric_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the numbers of each turn occur in the document of its conversation's number."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("evidence"))
    turns = table(spark, sf_dir, "conversations").join(docs, "conv_id")
    return turns.select("conv_id", "turn", "role", COV.numbers_supported(F.concat("text", F.lit(" 12 "), F.col("conv_id") % 7), F.col("evidence")).alias("supported"))


SUPPORT_SQL = rf"WITH x AS (SELECT conv_id, turn, role, c.text || ' 12 ' || (conv_id % 7) AS a, regexp_replace(lower(d.text), '\s', '', 'g') AS e FROM conversations c JOIN documents d ON doc_id = conv_id) SELECT conv_id, turn, role, len(list_filter({_nonyears('a')}, lambda n: NOT contains(e, n))) = 0 AS supported FROM x"


def adaptive_two_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose evidence does not suffice ask again with what is missing; both rounds merge, the better score of a document staying."""
    evidence = _evidence(spark, sf_dir)
    state = COV.sufficiency(evidence, "item_id", "asked", "text", "base", ["thing", "licen", "with"])
    again = state.where("not sufficient").select("item_id", COV.follow_up(F.col("missing"), F.lit("figures"), F.array().cast("array<string>")).alias("text"))
    second = R.search_lexical(index(spark, sf_dir), again, "item_id", 5).select("item_id", "doc_id", "score", F.lit(2).alias("round"))
    both = evidence.select("item_id", "doc_id", "score", F.lit(1).alias("round")).unionByName(second)
    best = both.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"), F.min("round").alias("round"))
    return R.top_k(best, 5, ["item_id"], [F.desc("score"), F.asc("doc_id")]).select("item_id", "rank", "doc_id", "score", "round")


ADAPTIVE_SQL = f"""WITH {_SUFFICIENT}, again AS (SELECT item_id, query AS text FROM ({FOLLOWUP_SQL.replace("' || yt || '", "' || '' || '").replace(f"WITH {_SUFFICIENT}, x AS", "WITH x AS")})),
    second AS (WITH {_bm25_sql('again', 'item_id', 5)} SELECT * FROM lexical),
    b AS (SELECT item_id, doc_id, score, 1 AS round FROM pool WHERE rank <= 3 UNION ALL SELECT item_id, doc_id, score, 2 FROM second), g AS (SELECT item_id, doc_id, max(score) AS score, min(round) AS round FROM b GROUP BY ALL)
    SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score, CAST(round AS INT) AS round FROM g) WHERE rank <= 5"""


def adaptive_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each question's search ended, and what its last round had: two rounds with dedup, diversity and budget in each."""
    docs, lexicon = table(spark, sf_dir, "documents"), index(spark, sf_dir)

    def search(queries: DataFrame, k: int) -> DataFrame:
        found = R.search_lexical(lexicon, queries, "query", k)
        best = R.share_of_best("score", ["query"])
        return found.select("query", F.col("doc_id").alias("key"), best.alias("score")).join(docs.select(F.col("doc_id").alias("key"), F.col("source").alias("page"), F.col("lang").alias("kind"), "text"), "key")

    asked = F.concat("text", F.when(F.col("item_id") % 3 == 0, F.lit(" how many in 2021")).when(F.col("item_id") % 3 == 1, F.lit(" compare 2019 with 2020")).otherwise(F.lit("")))
    state, _ = A.adaptive_search(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), asked.alias("text")), search, ["thing", "licen", "with"], "figures")
    return state.select(F.col("query").alias("item_id"), "rounds", "stop_reason", "sufficient", "confidence", "missing", "candidates", "after_dedup", "after_diversity", "evidence", "tokens", "again")


FINANCE = FI.FinanceConfig(
    intents=(FI.Intent("linked", "multi_hop", ("of",), ("first", "second")), FI.Intent("joined", "calculation", ("with",), ("third", "first"))),
    facts={"first": {"groups": FACTS["first"], "query": "the and"}, "second": {"groups": FACTS["second"], "query": "licence license"}, "third": {"groups": FACTS["third"], "query": "idiot trash"}},
)


def financial_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of all questions, their facts after a round more for those that lack some, and what they asked."""
    docs, lexicon = table(spark, sf_dir, "documents"), index(spark, sf_dir)

    def search(queries: DataFrame, k: int) -> DataFrame:
        found = R.search_lexical(lexicon, queries, "query", k).withColumn("score", R.share_of_best("score", ["query"]))
        return found.join(docs.select("doc_id", "text", F.col("lang").alias("heading"), F.lit("").alias("entity")), "doc_id").withColumn("page", F.col("doc_id")).withColumnRenamed("doc_id", "key")

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), "text")
    state = FI.controlled_search(asked, search, FINANCE)
    facts = state.coverage.where("covered").groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "fact"))), lambda x: x["fact"]).alias("covered"))
    out = state.plan.select("query", "intent").join(state.trace, "query").join(facts, "query", "left")
    return out.select(F.col("query").cast("long").alias("item_id"), "intent", F.coalesce("covered", F.array().cast("array<string>")).alias("covered"), "rounds", "follow_ups", "initial_candidates", "final_candidates")


def _finance_sql() -> str:
    tests = ", ".join(f"CASE WHEN {' AND '.join('(' + ' OR '.join(f"contains(f, '{x}')" for x in g) + ')' for g in groups)} THEN '{name}' END" for name, groups in FACTS.items())
    return f"""WITH {_bm25_sql('benchmark', 'item_id', 20)}, asks AS (SELECT * FROM (VALUES ('first', 'the and'), ('second', 'licence license'), ('third', 'idiot trash')) v(fact, text)),
    second AS (WITH {_bm25_sql('asks', 'fact', 8)} SELECT fact, doc_id FROM lexical),
    h AS (SELECT doc_id, list_filter([{tests}], lambda x: x IS NOT NULL) AS has FROM (SELECT doc_id, strip_accents(lower(text)) AS f FROM documents)),
    p AS (SELECT item_id, CASE WHEN contains(strip_accents(lower(text)), 'of') THEN 'linked' WHEN contains(strip_accents(lower(text)), 'with') THEN 'joined' ELSE 'generic' END AS intent,
      CASE WHEN contains(strip_accents(lower(text)), 'of') THEN ['first', 'second'] WHEN contains(strip_accents(lower(text)), 'with') THEN ['third', 'first'] ELSE [] END AS facts FROM benchmark),
    r1 AS (SELECT p.item_id, count(doc_id) AS n, coalesce(list_distinct(flatten(list(has) FILTER (has IS NOT NULL))), []) AS has FROM p LEFT JOIN lexical USING (item_id) LEFT JOIN h USING (doc_id) GROUP BY p.item_id),
    m AS (SELECT p.item_id, intent, facts, n, list_filter(facts, lambda x: NOT list_contains(r1.has, x)) AS missing FROM p JOIN r1 USING (item_id)),
    d AS (SELECT item_id, doc_id FROM lexical UNION SELECT item_id, doc_id FROM m JOIN second ON list_contains(missing, fact)),
    r2 AS (SELECT item_id, count(*) AS n2, list_distinct(flatten(list(has))) AS has2 FROM d JOIN h USING (doc_id) GROUP BY item_id)
    SELECT item_id, intent, list_filter(facts, lambda x: list_contains(coalesce(has2, []), x)) AS covered, CAST(CASE WHEN len(missing) > 0 THEN 2 ELSE 1 END AS INT) AS rounds,
      list_transform(missing, lambda x: CASE x WHEN 'first' THEN 'the and' WHEN 'second' THEN 'licence license' ELSE 'idiot trash' END) AS follow_ups, n AS initial_candidates, coalesce(n2, 0) AS final_candidates
    FROM m LEFT JOIN r2 USING (item_id)"""


def tool_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came of one tool call for each question. No model is here: a planner by rule names another question, a difference of figures, nothing, or no JSON."""
    docs, lexicon = table(spark, sf_dir, "documents"), index(spark, sf_dir)

    def search(queries: DataFrame, k: int) -> DataFrame:
        found = R.search_lexical(lexicon, queries, "query", k).withColumn("score", R.share_of_best("score", ["query"]))
        return found.join(docs.select("doc_id", "text"), "doc_id").select("query", F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("key"), F.col("doc_id").cast("int").alias("page"), "score", "text")

    def planner(shown: DataFrame) -> DataFrame:
        page = F.regexp_extract("preview", "page=([0-9]+)", 1)
        operand = F.concat(F.lit('{"value": "1", "page": '), F.when(page == "", "0").otherwise(page), F.lit("}"))
        calculation = F.concat(F.lit('I call {"calculator": {"operation": "subtract", "left": '), operand, F.lit(', "right": '), operand, F.lit("}}"))
        kind = F.col("query") % 4
        return shown.select("query", F.when(kind == 0, '{"tool": "hybrid_retrieve", "query": "licence license"}').when(kind == 1, calculation).when(kind == 2, '{"finish": {}}').otherwise("no idea").alias("reply"))

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    _, trace = AG.tool_search(asked, search, planner, AG.AgentSettings(triggers=("the",)))
    return trace.withColumnRenamed("query", "item_id")


AGENT_SQL = f"""WITH {_bm25_sql('benchmark', 'item_id', 20)}, asks AS (SELECT 1 AS one, 'licence license' AS text), follow AS (WITH {_bm25_sql('asks', 'one', 8)} SELECT doc_id FROM lexical),
    t AS (SELECT item_id, contains(lower(text), 'the') AS asked, item_id % 4 AS m FROM benchmark),
    n AS (SELECT t.item_id, count(doc_id) AS n, coalesce(bool_or(rank = 1 AND contains(text, '1')), false) AS held FROM t LEFT JOIN lexical USING (item_id) LEFT JOIN documents USING (doc_id) GROUP BY t.item_id),
    u AS (SELECT item_id, count(*) AS n FROM (SELECT item_id, doc_id FROM lexical UNION SELECT item_id, doc_id FROM t, follow WHERE asked AND m = 0) GROUP BY item_id)
    SELECT item_id, CASE WHEN NOT asked THEN 'not_triggered' WHEN m IN (1, 2) THEN 'planner_nested_tool_json' WHEN m = 0 THEN 'planner' ELSE 'planner_invalid_json' END AS source,
      CASE WHEN NOT asked THEN NULL WHEN m = 0 THEN 'hybrid_retrieve' WHEN m = 1 THEN 'calculator' ELSE 'finish' END AS tool,
      CASE WHEN NOT asked THEN NULL WHEN m = 1 AND NOT held THEN 'rejected:operands_not_verbatim_in_evidence' ELSE 'ok' END AS outcome,
      least(10, CASE WHEN asked AND m = 0 THEN coalesce(u.n, 0) WHEN asked AND m = 1 AND held THEN n.n + 1 ELSE n.n END) AS evidence
    FROM t JOIN n USING (item_id) LEFT JOIN u USING (item_id)"""


def score_udf_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a cross-encoder would score pairs in batches: word overlap stands in for the model."""

    def overlap(q: pd.Series, t: pd.Series) -> pd.Series:
        words = lambda x: set(x.lower().split())
        return pd.Series([len(words(a) & words(b)) / max(1, len(words(a) | words(b))) for a, b in zip(q, t)])

    score = F.pandas_udf(overlap, "double")
    pool = _pool(spark, sf_dir, 20).withColumn("model_score", F.round(score("query_text", "text"), 6)).drop("rank")
    return R.top_k(pool, 5, ["item_id"], [F.desc("model_score"), F.asc("doc_id")]).select("item_id", "rank", "doc_id", "model_score")


def fold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms that need Python, of every whole text: NFKC, NFC, accent folding and number redaction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    return docs.select("doc_id", F.md5(T.nfkc(F.col("t"))).alias("nfkc"), F.md5(T.nfc(F.col("t"))).alias("nfc"), T.fold(F.col("t")).alias("folded"), T.redact_new_numbers(F.lit("in 2020"), F.concat(F.lit("2020 and 37: "), F.col("t"))).alias("redacted"))


QUERIES = {f.__name__: f for f in (route_features, route_score, llm_route_validate, fact_coverage, sufficiency, followup_query, intent_first_match, financial_rank, growth_calc, plan_variance, pp_difference, cagr, tool_calculator, canonical_citation, numeric_support, adaptive_two_round, adaptive_outcome, financial_controller, tool_agent, score_udf_stub, fold_search)}
ORACLES = {
    "route_features": FEATURES_SQL, "route_score": _route_sql(), "llm_route_validate": VALIDATE_SQL, "fact_coverage": _facts_sql(), "sufficiency": SUFFICIENCY_SQL, "followup_query": FOLLOWUP_SQL, "intent_first_match": INTENT_SQL,
    "financial_rank": _rank_sql(), "growth_calc": GROWTH_SQL, "plan_variance": VARIANCE_SQL, "pp_difference": POINTS_SQL, "cagr": CAGR_SQL, "tool_calculator": CALCULATOR_SQL, "canonical_citation": CITATION_SQL, "numeric_support": SUPPORT_SQL, "adaptive_two_round": ADAPTIVE_SQL, "financial_controller": _finance_sql(), "tool_agent": AGENT_SQL,
}
