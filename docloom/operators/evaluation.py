"""Scores of answers and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def recall_at(found: Column, gold: Column, k: int) -> Column:
    """Share of distinct gold values among the first k; null without gold."""
    n = F.size(F.array_distinct(gold))
    return F.when(n > 0, F.size(F.array_intersect(F.slice(found, 1, k), gold)) / n)


def hit_at(found: Column, gold: Column, k: int) -> Column:
    return F.coalesce(recall_at(found, gold, k) > 0, F.lit(False))


def first_rank(found: Column, gold: Column) -> Column:
    """Place of the first gold value from 1, or null."""
    ranks = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda r: r.isNotNull())
    return F.array_min(ranks)


def ranking_scores(found: DataFrame, gold: DataFrame, query: str, ks: tuple[int, ...] = (1, 5, 10), cited: int = 3) -> DataFrame:
    """Scores of each query of gold: recall_k and hit_k, first (the rank of the first relevant row or null), and those of the first `cited` rows as citations.

    found: (query, rank, relevant); gold: (query, gold_n), how many relevant rows there are. Gold is
    counted and never listed, so it may be of any size. Recall is null without gold.
    """
    at = lambda k: F.count_if(F.col("relevant") & (F.col("rank") <= k))
    counts = found.groupBy(query).agg(*(at(k).alias(f"_r{k}") for k in ks), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.count_if(F.col("rank") <= cited).alias("_cited"), at(cited).alias("_right"))
    rows = gold.join(counts, query, "left")
    share = lambda a, b: F.when(b > 0, F.coalesce(a, F.lit(0)) / b)
    right, asked, n = F.coalesce("_right", F.lit(0)), F.coalesce("_cited", F.lit(0)), F.col("gold_n")
    return rows.select(
        query, *(F.round(share(F.col(f"_r{k}"), n), 6).alias(f"recall_{k}") for k in ks), *((F.coalesce(f"_r{k}", F.lit(0)) > 0).alias(f"hit_{k}") for k in ks), "first",
        F.round(F.coalesce(share(right, asked), F.lit(0.0)), 6).alias("citation_precision"), F.round(share(right, n), 6).alias("citation_recall"), ((right == asked) & (right == n)).alias("citation_exact"),
    )


def token_f1(pairs: DataFrame, key: list[str], predicted: str, gold: str) -> DataFrame:
    """(key, f1) over words with their counts; two empty texts agree."""
    words = lambda c: pairs.select(*key, F.explode(T.all_matches(F.lower(F.coalesce(F.col(c), F.lit(""))), T.WORD)).alias("w")).groupBy(*key, "w").agg(F.count(F.lit(1)).alias("n"))
    shared = words(predicted).alias("p").join(words(gold).withColumnRenamed("n", "m"), [*key, "w"]).groupBy(*key).agg(F.sum(F.least("n", "m")).alias("o"))
    size = lambda c: F.size(T.all_matches(F.lower(F.coalesce(F.col(c), F.lit(""))), T.WORD))
    rows = pairs.select(*key, size(predicted).alias("a"), size(gold).alias("b")).join(shared, key, "left")
    f1 = F.when((F.col("a") == 0) | (F.col("b") == 0), (F.col("a") == F.col("b")).cast("double")).otherwise(2.0 * F.coalesce("o", F.lit(0)) / (F.col("a") + F.col("b")))
    return rows.select(*key, F.round(f1, 6).alias("f1"))


def citation_scores(cited: Column, gold: Column) -> list[Column]:
    """precision (0 without citations), recall (null without gold), exact."""
    c, g = F.array_distinct(cited), F.array_distinct(gold)
    both = F.size(F.array_intersect(c, g))
    precision = F.when(F.size(c) > 0, both / F.size(c)).otherwise(F.lit(0.0))
    recall = F.when(F.size(g) > 0, both / F.size(g))
    return [F.round(precision, 6).alias("citation_precision"), F.round(recall, 6).alias("citation_recall"), ((both == F.size(c)) & (both == F.size(g))).alias("citation_exact")]


def failure(error: Column, answerable: Column, hit: Column, refused: Column, precision: Column, recall: Column, valid: Column, correct: Column) -> Column:
    """The first that applies, in order; answerable and correct may be null."""
    yes, no = answerable.eqNullSafe(F.lit(True)), answerable.eqNullSafe(F.lit(False))
    return (
        F.when(error, "runtime_error").when(yes & ~hit, "retrieval_miss").when(yes & refused, "false_refusal").when(no & ~refused, "unsafe_answer")
        .when(yes & ((precision < 1) | F.coalesce(recall < 1, F.lit(False)) | ~valid), "citation_error").when(correct.eqNullSafe(F.lit(False)), "answer_error").otherwise("none")
    )


def attempted(rows: DataFrame, steps: dict[str, Column], needs: dict[str, Column] | None = None) -> DataFrame:
    """rows with a column for each step, error (the first step that came to nothing, or null) and trace (how many steps, how many failed).

    Steps are expressions that give null where they fail (try_cast, try_divide and the like), so a row that
    fails stops no other. needs: by step, an input without which it is no failure to have no result.
    """
    out = rows.withColumns(steps)
    needs = needs or {}
    failed = {n: F.col(n).isNull() & (needs[n].isNotNull() if n in needs else F.lit(True)) for n in steps}
    first = F.coalesce(*(F.when(f, F.lit(n)) for n, f in failed.items()))
    trace = F.struct(F.lit(len(steps)).cast("long").alias("steps"), sum((f.cast("long") for f in failed.values()), F.lit(0).cast("long")).alias("failed"))
    return out.withColumn("error", first).withColumn("trace", trace)


def cost(tokens: dict[str, str], rates: dict[str, str]) -> Column:
    """Sum of tokens by rate a million, to 8 places; null if a rate is."""
    total = sum((F.col(tokens[k]) * F.col(rates[k]) for k in tokens), F.lit(0.0))
    return F.round(total / 1e6, 8)
