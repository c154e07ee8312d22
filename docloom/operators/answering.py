"""Answers from evidence: written once, checked, repaired once where the check fails, and refused where that fails too."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.coverage import numbers_supported
from docloom.storage import materialize

#: A model over prompts (query, prompt) in batches: gives (query, reply). Queries without a reply count as an empty one.
Writer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class AnswerSettings:
    """k: evidence rows of a question at most; least: the best score below which nothing is written."""

    k: int = 10
    least: float = 0.0
    # fixed values: what is said without an answer, and what marks a refusal
    refusal: str = "Không tìm thấy đủ thông tin trong Báo cáo thường niên để trả lời câu hỏi này."
    closed: str = "Không thể tạo câu trả lời với trích dẫn hợp lệ từ bằng chứng được truy xuất."
    sign: str = "không đủ thông tin"


def evidence_of(evidence: DataFrame, k: int) -> DataFrame:
    """(query, top, shown): the best score and the k best rows (rank, page, text) of each question, cut before they are gathered."""
    shown = F.array_sort(F.collect_list(F.struct("rank", F.col("page").cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"))))
    return evidence.where(F.col("rank") <= k).groupBy("query").agg(F.max("score").alias("top"), shown.alias("shown"))


def written_evidence(shown: Column) -> Column:
    """Evidence as a model reads it, the best row last, next to the question."""
    one = lambda e: F.concat(F.lit("[evidence "), e["rank"].cast("string"), F.lit(", page "), F.coalesce(e["page"].cast("string"), F.lit("?")), F.lit("]\n"), e["text"])
    return F.array_join(F.transform(F.reverse(shown), one), "\n\n")


def checks(reply: Column, shown: Column, settings: AnswerSettings) -> Column:
    """struct<citations, refused, valid> of a reply. A valid answer cites, cites pages of its evidence only, and has every number but years on a cited page. A refusal may cite nothing."""

    def judged(cited: Column) -> Column:
        low = F.lower(reply)
        refused = F.contains(low, F.lit(settings.refusal.lower())) | F.contains(low, F.lit(settings.sign))
        known = F.size(F.array_except(cited, F.transform(shown, lambda e: e["page"]))) == 0
        read = F.array_join(F.transform(F.filter(shown, lambda e: F.array_contains(cited, e["page"])), lambda e: e["text"]), " ")
        supported = numbers_supported(F.regexp_replace(reply, T.CITATION, ""), read)
        return F.struct(cited.alias("citations"), refused.alias("refused"), F.when(refused, known).otherwise((F.size(cited) > 0) & known & supported).alias("valid"))

    return T.let(T.citations(reply), judged)


def _replies(model: Writer, prompts: DataFrame, name: str) -> DataFrame:
    """A model is asked once for each row, whatever is recomputed later."""
    return materialize(model(prompts).select("query", "reply"), name)


def answered(questions: DataFrame, evidence: DataFrame, write: Writer, repair: Writer, settings: AnswerSettings = AnswerSettings()) -> DataFrame:
    """(query, answer, citations, refused, valid, mode, calls) of questions (query, text) with evidence (query, rank, page, score, text).

    mode: `no_evidence` (none, or the best score is below the least; no model is asked), `written`,
    `repaired`, or `closed`: the repair fails the same check, so a fixed refusal is given. Only rows that
    fail go to the repair. Null texts count as empty; a question's id is expected once.
    """
    open_ = questions.select("query", F.coalesce("text", F.lit("")).alias("question")).join(evidence_of(evidence, settings.k), "query", "left")
    silent = F.col("shown").isNull() | ~F.coalesce(F.col("top") >= settings.least, F.lit(False))
    rows = materialize(open_.withColumn("silent", silent), "questions")
    asked = rows.where("not silent")
    prompt = F.concat(written_evidence(F.col("shown")), F.lit("\n\nQuestion: "), F.col("question"))
    first = _replies(write, asked.select("query", prompt.alias("prompt")), "answers")
    said = asked.join(first, "query", "left").withColumn("reply", F.coalesce("reply", F.lit("")))
    judged = materialize(said.withColumn("check", checks(F.col("reply"), F.col("shown"), settings)), "checked")
    good = judged.where("check.valid").withColumn("mode", F.lit("written"))

    bad = judged.where("not check.valid")
    pages = F.array_join(F.array_sort(F.array_distinct(F.transform("shown", lambda e: e["page"]))), ", ")
    again = F.concat(F.lit("The answer below cites pages that are missing or wrong, or figures that they lack:\n"), F.col("reply"), F.lit("\nPages that may be cited: "), pages, F.lit("\n\n"), prompt)
    second = _replies(repair, bad.select("query", again.alias("prompt")), "repairs")
    mended = bad.drop("reply", "check").join(second, "query", "left").withColumn("reply", F.coalesce("reply", F.lit(""))).withColumn("check", checks(F.col("reply"), F.col("shown"), settings))
    mended = mended.withColumn("mode", F.when(F.col("check.valid"), "repaired").otherwise("closed"))

    def out(df: DataFrame, calls: int) -> DataFrame:
        closed = F.col("mode") == "closed"
        none = F.array().cast("array<bigint>")
        return df.select("query", F.when(closed, F.lit(settings.closed)).otherwise(F.col("reply")).alias("answer"), F.when(closed, none).otherwise(F.col("check.citations")).alias("citations"), (closed | F.col("check.refused")).alias("refused"), F.col("check.valid").alias("valid"), "mode", F.lit(calls).alias("calls"))

    mute = rows.where("silent").select("query", F.lit(settings.refusal).alias("answer"), F.array().cast("array<bigint>").alias("citations"), F.lit(True).alias("refused"), F.lit(True).alias("valid"), F.lit("no_evidence").alias("mode"), F.lit(0).alias("calls"))
    return out(good, 1).unionByName(out(mended, 2)).unionByName(mute)
