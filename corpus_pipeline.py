"""A training-data pipeline: quality, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each
result as Parquet to the shared folder and reads it again. All but the last return the columns of
documents. Documents with null ids pass the filters by their text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import TOKENIZER_DIR, materialize, table
from docloom.llm.order_minhash import near_texts, text_digest
from docloom.llm.packing import cut_documents, pack_pieces
from docloom.llm.quality import grade_documents, train_quality
from docloom.llm.toxicity import score_toxicity, train_toxicity
from docloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which grade 1 or better is likelier than not. Learned from the labelled documents of the corpus."""
    ship(spark)
    model = train_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return grade_documents(docs, model, wanted=1).where("selected").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5. Learned from the labelled documents of the corpus."""
    ship(spark)
    model = train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("toxicity < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id; one without an id only where all are.

    Groups are of texts, so one doc_id may have several that stay. Rows that share id and text count
    once, the smallest lang, source and n_chars staying. Null texts are copies only if their doc_id is
    the same, and rows without id and text all stay. An empty text is a text; an empty table stays empty.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    texts = docs.where("text is not null").withColumn("_digest", text_digest(F.col("text")))
    ids = texts.groupBy("_digest").agg(F.min("doc_id").alias("doc_id"))
    groups = near_texts(docs).withColumnRenamed("digest", "_digest").join(ids, "_digest")
    kept = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_digest")).alias("_first")).select("_first._digest")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "lang", "source", "n_chars")
    # one row of each text first, in the tasks that read them, so that many copies never meet in one
    one = texts.groupBy("_digest").agg(F.min_by(F.struct(*COLUMNS), order).alias("_row"))
    one = one.join(materialize(kept, "kept").hint("merge"), "_digest", "left_semi").select("_row.*")
    without = docs.where("text is null")
    same_id = without.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("lang", "source", "n_chars")).alias("_rest"))
    same_id = same_id.select("doc_id", F.lit(None).cast("string").alias("text"), "_rest.*")
    return one.union(same_id.select(*COLUMNS)).union(without.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents in sequences of at most 4096 tokens."""
    ship(spark)
    pieces = cut_documents(docs, 4096, 2, f"{TOKENIZER_DIR}/word_bpe_49k.json")
    return pack_pieces(pieces, 4096).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("packing", pack)]

#: SQL can state none of the stages; tests/llm runs them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
