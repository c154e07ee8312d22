"""Bounded samples of labelled documents, for models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, learn: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents, the same ones on every run.

    learn: a condition on doc_id. Null labels and ids are left out; of several labels or texts of one
    id the largest counts. The chosen labels are broadcast: `most` bounds their number.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if learn is not None:
        known = known.where(learn)
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
