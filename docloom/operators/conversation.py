"""Conversations: bounded history, anchors of follow-ups, several references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

#: How a question begins that leans on the one before it.
FOLLOW_UP = r"^(and|what about|it|that|this|those) "


def stands_alone(text: Column) -> Column:
    return ~F.lower(text).rlike(FOLLOW_UP)


def normal_history(turns: DataFrame) -> DataFrame:
    """Turns with role and text in NFC; turns without a role are dropped, a null text is empty."""
    return turns.where("role is not null").withColumn("role", T.nfc(F.col("role"))).withColumn("text", F.coalesce(T.nfc(F.col("text")), F.lit("")))


def last_turns(turns: DataFrame, pairs: int) -> DataFrame:
    """The last 2 * pairs turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 2 * pairs).drop("_n")


def with_anchor(turns: DataFrame) -> DataFrame:
    """anchor: the last question before each turn that stands alone."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.when((F.col("role") == "user") & stands_alone(F.col("text")), F.col("text"))
    return turns.withColumn("anchor", F.last(asked, ignorenulls=True).over(w))


def rewrite_follow_up(turns: DataFrame, year: str = r"(19|20)[0-9]{2}") -> DataFrame:
    """rewritten: a follow-up that only names another year becomes its anchor with that year; others are kept."""
    named = F.regexp_extract("text", year, 0)
    swapped = F.regexp_replace(F.col("anchor"), F.lit(year), named)
    follows = ~stands_alone(F.col("text")) & F.col("anchor").isNotNull() & (named != "")
    return with_anchor(turns).withColumn("rewritten", F.when(follows, swapped).otherwise(F.col("text")))


def last_questions(turns: DataFrame, most: int) -> DataFrame:
    """(conv_id, position, text): the last distinct questions that stand alone, latest first."""
    asked = turns.where((F.col("role") == "user") & stands_alone(F.col("text"))).groupBy("conv_id", "text").agg(F.max("turn").alias("turn"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "text")
    return asked.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
