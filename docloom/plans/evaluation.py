"""Queries that score rankings, answers and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import evaluation as E
from docloom.plans.relational import RUNS_SQL, _runs
from docloom.plans.retrieval import DENSE_SQL, dense_topk
from docloom.sources.tables import table


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the dense ranking of each query; relevant are all other vectors of its label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query"), F.col("label").alias("wanted"))
    sizes = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "wanted")
    found = dense_topk(spark, sf_dir).join(vectors, "vec_id").join(asked, "query").select("query", "rank", (F.col("label") == F.col("wanted")).alias("relevant"))
    return E.ranking_scores(found, asked.join(sizes, "wanted").select("query", (F.col("n") - 1).alias("gold_n")), "query")


_SCORES = f"""d AS ({DENSE_SQL}), a AS (SELECT vec_id AS query, label, (SELECT count(*) FROM embeddings x WHERE x.label = e.label) - 1 AS gold FROM embeddings e WHERE vec_id % 20 = 0),
    h AS (SELECT a.query, gold, rank, v.label = a.label AS ok FROM a LEFT JOIN d ON d.query = a.query LEFT JOIN embeddings v ON v.vec_id = d.vec_id),
    ranked AS (SELECT query, any_value(gold) AS gold, count(*) FILTER (ok AND rank <= 1) AS r1, count(*) FILTER (ok AND rank <= 5) AS r5, count(*) FILTER (ok AND rank <= 10) AS r10, min(rank) FILTER (ok) AS first,
      count(*) FILTER (rank <= 3) AS cited, count(*) FILTER (ok AND rank <= 3) AS good FROM h GROUP BY query)"""


def hit_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("query", *(f"recall_{k}" for k in (1, 5, 10)), *(f"hit_{k}" for k in (1, 5, 10)))


HIT_SQL = f"WITH {_SCORES} SELECT query, " + ", ".join(f"round(CASE WHEN gold > 0 THEN r{k}::DOUBLE / gold END, 6) AS recall_{k}, r{k} > 0 AS hit_{k}" for k in (1, 5, 10)) + " FROM ranked"


def mrr10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("first") <= 10, F.col("first"))
    return _scores(spark, sf_dir).agg(F.round(F.avg(F.coalesce(1 / rank, F.lit(0.0))), 6).alias("mrr10"), F.count(F.lit(1)).alias("queries"))


MRR_SQL = f"WITH {_SCORES} SELECT round(avg(coalesce(1e0 / CASE WHEN first <= 10 THEN first END, 0e0)), 6) AS mrr10, count(*) AS queries FROM ranked"


def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer of each turn against the question before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    pairs = table(spark, sf_dir, "conversations").withColumn("gold", F.lag("text").over(w)).where("gold is not null").select("conv_id", "turn", "role", "text", "gold")
    return E.token_f1(pairs, ["conv_id", "turn", "role"], "text", "gold")


F1_SQL = r"""WITH p AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role) AS gold FROM conversations), q AS (SELECT * FROM p WHERE gold IS NOT NULL),
    a AS (SELECT conv_id, turn, role, w, count(*) AS n FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM q) GROUP BY ALL),
    b AS (SELECT conv_id, turn, role, w, count(*) AS m FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all(lower(gold), '[\p{L}\p{N}_]+')) AS w FROM q) GROUP BY ALL),
    o AS (SELECT conv_id, turn, role, sum(least(n, m)) AS o FROM a JOIN b USING (conv_id, turn, role, w) GROUP BY ALL),
    s AS (SELECT q.conv_id, q.turn, q.role, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS x, len(regexp_extract_all(lower(gold), '[\p{L}\p{N}_]+')) AS y, o.o FROM q LEFT JOIN o ON o.conv_id = q.conv_id AND o.turn = q.turn AND o.role = q.role)
    SELECT conv_id, turn, role, round(CASE WHEN x = 0 OR y = 0 THEN (x = y)::INT::DOUBLE ELSE 2e0 * coalesce(o, 0) / (x + y) END, 6) AS f1 FROM s"""


def citation_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three found are cited."""
    return _scores(spark, sf_dir).select("query", "citation_precision", "citation_recall", "citation_exact")


CITATION_SQL = f"""WITH {_SCORES}
    SELECT query, round(CASE WHEN cited > 0 THEN good::DOUBLE / cited ELSE 0e0 END, 6) AS citation_precision, round(CASE WHEN gold > 0 THEN good::DOUBLE / gold END, 6) AS citation_recall, good = cited AND good = gold AS citation_exact FROM ranked"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers with made-up outcomes; labels are manual reviews."""
    n = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    answerable = F.when(n % 5 != 0, n % 3 != 0)
    correct = F.coalesce(F.col("quality") == 1, n % 4 != 1)
    failure = E.failure(n % 97 == 0, answerable, n % 7 != 0, n % 11 == 0, F.when(n % 13 == 0, 0.5).otherwise(1.0), F.when(n % 17 == 0, F.lit(None).cast("double")).otherwise(1.0), n % 19 != 0, correct)
    return docs.select("doc_id", "lang", answerable.alias("answerable"), correct.alias("correct"), failure.alias("failure"), (n * 37 % 1000).alias("ms"), (n % 6).alias("calls"))


_SCORED = """s AS (SELECT d.doc_id, lang, CASE WHEN d.doc_id % 5 <> 0 THEN d.doc_id % 3 <> 0 END AS answerable, coalesce(quality = 1, d.doc_id % 4 <> 1) AS correct, d.doc_id * 37 % 1000 AS ms, d.doc_id % 6 AS calls FROM documents d LEFT JOIN labels USING (doc_id)),
    scored AS (SELECT *, CASE WHEN doc_id % 97 = 0 THEN 'runtime_error' WHEN answerable AND doc_id % 7 = 0 THEN 'retrieval_miss' WHEN answerable AND doc_id % 11 = 0 THEN 'false_refusal' WHEN NOT answerable AND doc_id % 11 <> 0 THEN 'unsafe_answer'
      WHEN answerable AND (doc_id % 13 = 0 OR doc_id % 19 = 0) THEN 'citation_error' WHEN NOT correct THEN 'answer_error' ELSE 'none' END AS failure FROM s)"""


def failure_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", "failure")


FAILURE_SQL = f"WITH {_SCORED} SELECT doc_id, failure FROM scored"


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All aggregates of a run in one pass."""
    mean = lambda c: F.round(F.avg(c.cast("double")), 6)
    return _scored(spark, sf_dir).groupBy("lang").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if("answerable").alias("answerable"), mean(F.col("correct")).alias("accuracy"), mean(F.when(F.col("answerable"), F.col("correct"))).alias("accuracy_answerable"),
        mean(F.col("ms")).alias("mean_ms"), F.max("ms").alias("max_ms"), F.sum("calls").alias("calls"), F.count_if(F.col("failure") != "none").alias("failures"),
    )


SUMMARY_SQL = f"""WITH {_SCORED} SELECT lang, count(*) AS questions, CAST(count(*) FILTER (answerable) AS BIGINT) AS answerable, round(avg(correct::INT::DOUBLE), 6) AS accuracy, round(avg(CASE WHEN answerable THEN correct::INT::DOUBLE END), 6) AS accuracy_answerable,
    round(avg(ms::DOUBLE), 6) AS mean_ms, max(ms) AS max_ms, CAST(sum(calls) AS BIGINT) AS calls, CAST(count(*) FILTER (failure <> 'none') AS BIGINT) AS failures FROM scored GROUP BY lang"""


def isolated_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch in which questions fail one by one: what a question's step cannot do is that row's error, and the others go on."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 7 == 0, F.lit("n/a")).otherwise(F.col("n_chars").cast("string")).alias("raw"))
    out = E.attempted(rows, {"figure": F.col("raw").try_cast("double"), "ratio": F.try_divide(F.lit(1000.0), F.col("doc_id") % 5)}, {"figure": F.col("raw")})
    return out.select("doc_id", "figure", F.round("ratio", 6).alias("ratio"), "error", F.col("trace.steps").alias("steps"), F.col("trace.failed").alias("failed"))


ISOLATED_SQL = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN n_chars::DOUBLE END AS figure, CASE WHEN doc_id % 5 <> 0 THEN round(1000e0 / (doc_id % 5), 6) END AS ratio FROM documents)
    SELECT doc_id, figure, ratio, CASE WHEN figure IS NULL THEN 'figure' WHEN ratio IS NULL THEN 'ratio' END AS error, 2::BIGINT AS steps, (figure IS NULL)::BIGINT + (ratio IS NULL)::BIGINT AS failed FROM d"""


def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


HISTOGRAM_SQL = f"WITH {_SCORED} SELECT failure, count(*) AS n FROM scored GROUP BY failure"


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.round(F.percentile("value", p), 6).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95))), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("max"))


PERCENTILES_SQL = "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events GROUP BY event_type"


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of vectors against those of their nearest neighbour."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    nearest = dense_topk(spark, sf_dir).where("rank = 1").join(vectors.withColumnRenamed("label", "selected"), "vec_id")
    rows = nearest.join(vectors.select(F.col("vec_id").alias("query"), F.col("label").alias("expected")), "query")
    counts = rows.groupBy("expected", "selected").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("expected"))
    right = F.sum(F.when(F.col("expected") == F.col("selected"), F.col("n")).otherwise(0)).over(Window.partitionBy("expected"))
    return counts.select(F.col("expected").cast("int").alias("expected"), F.col("selected").cast("int").alias("selected"), "n", F.round(right / total, 6).alias("accuracy"))


CONFUSION_SQL = f"""WITH d AS ({DENSE_SQL}), c AS (SELECT e.label AS expected, v.label AS selected, count(*) AS n FROM d JOIN embeddings v USING (vec_id) JOIN embeddings e ON e.vec_id = d.query WHERE rank = 1 GROUP BY ALL)
    SELECT CAST(expected AS INT) AS expected, CAST(selected AS INT) AS selected, n, round(sum(CASE WHEN expected = selected THEN n ELSE 0 END) OVER p::DOUBLE / sum(n) OVER p, 6) AS accuracy FROM c WINDOW p AS (PARTITION BY expected)"""

RATES = [("small", 0.5, 0.05, 2.0), ("large", 2.0, 0.2, 10.0)]


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of each conversation's turns by rates a million tokens; null for models without rates."""
    rates = spark.createDataFrame(RATES, "model string, input double, cached double, output double")
    turns = table(spark, sf_dir, "conversations").withColumn("model", F.element_at(F.array(F.lit("small"), F.lit("large"), F.lit("other")), (F.col("turn") % 3 + 1).cast("int")))
    size = T.token_estimate(F.col("text"))
    used = turns.withColumn("n_in", F.when(F.col("role") != "assistant", size).otherwise(0)).withColumn("n_out", F.when(F.col("role") == "assistant", size).otherwise(0)).withColumn("n_cached", F.col("turn"))
    priced = used.join(F.broadcast(rates), "model", "left").withColumn("cost", E.cost({"i": "n_in", "c": "n_cached", "o": "n_out"}, {"i": "input", "c": "cached", "o": "output"}))
    source = F.when(F.count_distinct("model") == 1, F.max("model")).otherwise("mixed")
    return priced.groupBy("conv_id").agg(F.sum("n_in").alias("input"), F.sum("n_out").alias("output"), source.alias("source"), F.round(F.when(F.count("cost") == F.count(F.lit(1)), F.sum("cost")), 8).alias("cost"), F.round(F.sum("cost"), 8).alias("known_cost"))


USAGE_SQL = """WITH r(model, input, cached, output) AS (VALUES ('small', 0.5e0, 0.05e0, 2e0), ('large', 2e0, 0.2e0, 10e0)),
    u AS (SELECT conv_id, ['small', 'large', 'other'][turn % 3 + 1] AS model, turn AS n_cached, CASE WHEN role <> 'assistant' THEN CAST(greatest(1, ceil(strlen(text) / 4.0e0)) AS BIGINT) ELSE 0 END AS n_in, CASE WHEN role = 'assistant' THEN CAST(greatest(1, ceil(strlen(text) / 4.0e0)) AS BIGINT) ELSE 0 END AS n_out FROM conversations),
    p AS (SELECT u.*, round((n_in * r.input + n_cached * r.cached + n_out * r.output) / 1e6, 8) AS cost FROM u LEFT JOIN r USING (model))
    SELECT conv_id, CAST(sum(n_in) AS BIGINT) AS input, CAST(sum(n_out) AS BIGINT) AS output, CASE WHEN count(DISTINCT model) = 1 THEN max(model) ELSE 'mixed' END AS source, round(CASE WHEN count(cost) = count(*) THEN sum(cost) END, 8) AS cost, round(sum(cost), 8) AS known_cost FROM p GROUP BY conv_id"""


def ablation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency of each question by arm, side by side, and which arms are right."""
    runs = _runs(spark, sf_dir)
    return runs.groupBy("item_id").pivot("arm", ["a", "b", "c"]).agg(F.first("ms").alias("ms"), F.first("correct").alias("ok")).select("item_id", "a_ms", "b_ms", "c_ms", "a_ok", "b_ok", "c_ok")


PIVOT_SQL = f"WITH {RUNS_SQL} SELECT item_id, " + ", ".join(f"max(CASE WHEN arm = '{a}' THEN ms END) AS {a}_ms, bool_or(correct) FILTER (arm = '{a}') AS {a}_ok" for a in "abc") + " FROM runs GROUP BY item_id"


def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir)
    return rows.groupBy("arm").agg(F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.percentile("ms", 0.95), 6).alias("p95_ms"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"), (F.count(F.lit(1)) - F.count_distinct("ms")).alias("repeated_ms"))


ARM_SQL = f"WITH {RUNS_SQL} SELECT arm, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(avg(correct::INT::DOUBLE), 6) AS accuracy, count(*) - count(DISTINCT ms) AS repeated_ms FROM runs GROUP BY arm"


def complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that only arm a, only arm b, both or neither get right."""
    wide = ablation_pivot(spark, sf_dir)
    kind = F.when(F.col("a_ok") & F.col("b_ok"), "both").when(F.col("a_ok"), "a_only").when(F.col("b_ok"), "b_only").otherwise("missed")
    return wide.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


COMPLEMENT_SQL = f"WITH w AS ({PIVOT_SQL}) SELECT CASE WHEN a_ok AND b_ok THEN 'both' WHEN a_ok THEN 'a_only' WHEN b_ok THEN 'b_only' ELSE 'missed' END AS kind, count(*) AS n FROM w GROUP BY 1"


def multiturn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: turns whose numbers the turn before had, and mean length."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w))
    covered = F.size(F.array_except(T.numbers(F.col("text")), T.numbers(F.coalesce("before", F.lit(""))))) == 0
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.round(F.avg(covered.cast("double")), 6).alias("covered"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


MULTITURN_SQL = """WITH r AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role), '') AS before FROM conversations),
    n AS (SELECT conv_id, text, list_distinct(regexp_extract_all(lower(text), '[0-9]+(?:[.,][0-9]+)*%?')) AS a, regexp_extract_all(lower(before), '[0-9]+(?:[.,][0-9]+)*%?') AS b FROM r)
    SELECT conv_id, count(*) AS turns, round(avg((len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0)::INT::DOUBLE), 6) AS covered, round(avg(length(text)), 6) AS mean_length FROM n GROUP BY conv_id"""

QUERIES = {f.__name__: f for f in (hit_recall_at_k, mrr10, token_f1, citation_pr, failure_case, isolated_errors, run_summary, failure_histogram, percentiles, confusion, usage_cost, ablation_pivot, arm_summary, complementarity, multiturn_metrics)}
ORACLES = {
    "hit_recall_at_k": HIT_SQL, "mrr10": MRR_SQL, "token_f1": F1_SQL, "citation_pr": CITATION_SQL, "failure_case": FAILURE_SQL, "isolated_errors": ISOLATED_SQL, "run_summary": SUMMARY_SQL, "failure_histogram": HISTOGRAM_SQL, "percentiles": PERCENTILES_SQL,
    "confusion": CONFUSION_SQL, "usage_cost": USAGE_SQL, "ablation_pivot": PIVOT_SQL, "arm_summary": ARM_SQL, "complementarity": COMPLEMENT_SQL, "multiturn_metrics": MULTITURN_SQL,
}
