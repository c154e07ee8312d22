"""Search in two rounds: evidence is chosen and judged, and only questions that it does not answer ask again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import coverage as COV
from docloom.operators import selection as S
from docloom.storage import materialize

#: search(queries(query, text), k) -> (query, key, page, kind, score, text)
Search = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class AdaptiveSettings:
    """first, second: candidates of a round; diverse: how many of them stay; the rest as in the operators of selection."""

    first: int = 20
    second: int = 12
    most_per_page: int = 2
    threshold: float = 0.88
    diverse: int = 10
    balance: float = 0.7
    most_rows: int = 6
    most_tokens: int = 5000


def chosen_evidence(questions: DataFrame, rows: DataFrame, s: AdaptiveSettings) -> tuple[DataFrame, DataFrame]:
    """(evidence, counts): (query, position, key, page, score, text) within the budget, and how many candidates each step left.

    Near copies on a page go, then what is left is chosen for diversity, then what fits is taken in order.
    """
    rows = rows.join(questions.select("query", F.col("text").alias("_asked")), "query")
    kept = materialize(rows.join(S.dedup_by_page(rows, ["query"], "page", "key", "score", "text", s.most_per_page, s.threshold).select("query", "key"), ["query", "key"], "left_semi"), "kept")
    order = S.diverse(kept, "query", "key", "page", "kind", "score", "text", s.diverse, s.balance, question="_asked", protected=s.most_rows)
    spread = materialize(kept.join(order, ["query", "key"]), "diverse").withColumn("_tokens", T.token_estimate(F.col("text")))
    fits = S.token_budget(spread.withColumnRenamed("position", "_place"), ["query"], ["_place"], "key", "_tokens", s.most_rows, s.most_tokens)
    evidence = materialize(spread.drop("position").join(fits, ["query", "key"]).select("query", "position", "key", "page", "score", "text", "_tokens"), "evidence")
    n = lambda df, name, *more: df.groupBy("query").agg(F.count(F.lit(1)).alias(name), *more)
    counts = n(rows, "candidates").join(n(kept, "after_dedup"), "query").join(n(spread, "after_diversity"), "query").join(n(evidence, "evidence", F.sum("_tokens").alias("tokens")), "query", "left")
    return evidence.drop("_tokens"), counts.fillna(0, ["evidence", "tokens"])


def judged(questions: DataFrame, evidence: DataFrame, terms: list[str]) -> DataFrame:
    """(query, text, sufficient, confidence, missing) of every question; one without evidence lacks it."""
    asked = questions.select("query", F.col("text").alias("_asked"))
    state = COV.sufficiency(evidence.join(asked, "query"), "query", "_asked", "text", "score", terms, rank="position")
    none = F.col("sufficient").isNull()
    return questions.join(state, "query", "left").select(
        "query", "text", F.coalesce("sufficient", F.lit(False)).alias("sufficient"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(none, F.array(F.lit("no_evidence"))).otherwise(F.col("missing")).alias("missing")
    )


def adaptive_search(questions: DataFrame, search: Search, terms: list[str], subject: str, settings: AdaptiveSettings = AdaptiveSettings()) -> tuple[DataFrame, DataFrame]:
    """(state, evidence) of questions (query, text).

    Questions whose evidence does not suffice ask for what is missing, if that is another question than
    before; a candidate of both rounds keeps its better score. state has a row for each question:
    rounds, stop_reason, sufficient, confidence, missing, the counts of its last round, and the
    question of the second one. terms are the names that evidence must repeat; subject stands in where
    a question names none of them.
    """
    questions = materialize(questions.select("query", "text"), "questions")
    first = materialize(search(questions, settings.first), "round")
    evidence, counts = chosen_evidence(questions, first, settings)
    state = materialize(judged(questions, evidence, terms).join(counts, "query", "left"), "state")
    named = F.array_join(F.slice(T.terms_in(F.lower("text"), terms), 1, 2), " ")
    again = COV.follow_up(F.col("missing"), F.when(named == "", F.lit(subject)).otherwise(named), T.years(F.col("text")))
    open_ = state.where("not sufficient").withColumn("again", again).withColumn("_new", F.lower(F.trim("again")) != F.lower(F.trim("text")))
    follow = materialize(open_.where("_new").select("query", "text", "again"), "follow")
    second = search(follow.select("query", F.col("again").alias("text")), settings.second)
    pool = first.join(follow.select("query"), "query", "left_semi").withColumn("_round", F.lit(1)).unionByName(second.withColumn("_round", F.lit(2)))
    best = pool.groupBy("query", "key").agg(F.max_by(F.struct("page", "kind", "score", "text"), F.struct("score", -F.col("_round"))).alias("_r"))
    merged = materialize(best.select("query", "key", "_r.*"), "merged")
    evidence2, counts2 = chosen_evidence(follow.select("query", "text"), merged, settings)
    after = judged(follow.select("query", "text"), evidence2, terms).join(counts2, "query", "left").join(follow.select("query", "again"), "query")
    after = materialize(after.withColumn("rounds", F.lit(2)), "after")
    before = state.join(follow.select("query"), "query", "left_anti").withColumn("again", F.lit(None).cast("string")).withColumn("rounds", F.lit(1))
    both = before.unionByName(after).fillna(0, ["candidates", "after_dedup", "after_diversity", "evidence", "tokens"])
    reason = F.when(F.col("rounds") == 1, F.when(F.col("sufficient"), "sufficient_after_round_1").otherwise("no_distinct_followup_query")).when(F.col("sufficient"), "sufficient_after_round_2").otherwise("max_rounds_reached_insufficient")
    return both.withColumn("stop_reason", reason), evidence.join(follow.select("query"), "query", "left_anti").unionByName(evidence2)
