"""Records, questions and reviews as files; page numbers; manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "array<struct<block_label: string, block_content: string, block_bbox: array<double>, block_order: int>>"
RECORD = f"raw_id string, logical_index int, pdf_page_index int, pdf_page int, page_part string, printed_page int, mapping_method string, source string, markdown string, structured_result struct<res: struct<parsing_res_list: {BLOCKS}>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a missing path fails."""
    return spark.read.schema(schema).json(path)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """fragment_*.json with a text, in no order; logical_index is their place."""
    rows = spark.read.schema(RECORD).option("multiLine", True).option("pathGlobFilter", "fragment_*.json").json(folder)
    return rows.where("markdown is not null")


def printed_candidates(words: DataFrame, page: list[str], clip: str = "clip") -> DataFrame:
    """(page, candidates): the distinct numbers of one to three digits near the top or bottom of a page and a side of its clip, sorted.

    words: (page, token, x0, y0, page_height, clip struct of x0 and width). Near is within 14 % of the
    height, and 20 % of the clip's width.
    """
    number = F.regexp_extract("token", r"^([0-9]{1,3})$", 1)
    up, across = F.col("y0") / F.col("page_height"), (F.col("x0") - F.col(f"{clip}.x0")) / F.col(f"{clip}.width")
    near = ((up <= 0.14) | (up >= 0.86)) & ((across <= 0.20) | (across >= 0.80)) & (number != "")
    return words.groupBy(*page).agg(F.array_sort(F.collect_set(F.when(near, number.cast("int")))).alias("candidates"))


def save_mapping(pages: DataFrame, path: str) -> None:
    """Write the page mapping as JSON lines."""
    pages.select("logical_index", "printed_page", "mapping_method").write.json(path)


def text_leaves(value: Column) -> Column:
    """All texts in a JSON value, in order, whatever it nests; blank ones are left out. Null and broken JSON have none."""
    tokens = F.regexp_extract_all(value, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    strings = F.filter(tokens, lambda s: ~F.endswith(s, F.lit(":")))  # keys have a colon after them
    read = F.transform(strings, lambda s: F.get_json_object(F.concat(F.lit('{"s":'), s, F.lit("}")), "$.s"))
    return F.when(F.try_parse_json(value).isNull(), F.array().cast("array<string>")).otherwise(F.filter(read, lambda s: F.trim(s) != ""))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of strings or objects; ids q-001 and so on where none is given.

    Fails on repeated ids and on answerable questions without pages. One list is one document, so it is read whole.
    """
    item = "struct<id: string, question: string, gold_answer: string, gold_printed_pages: array<int>, answerable: boolean, question_type: string, category: string, requires_calculation: boolean>"
    raw = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.from_json("value", "array<string>")).alias("_at", "_item"))
    one = F.when(F.col("_item").startswith("{"), F.from_json("_item", item)).otherwise(F.struct(F.lit(None).cast("string").alias("id"), F.col("_item").alias("question"), F.lit(None).cast("string").alias("gold_answer"), F.array().cast("array<int>").alias("gold_printed_pages"), F.lit(None).cast("boolean").alias("answerable"), F.lit(None).cast("string").alias("question_type"), F.lit(None).cast("string").alias("category"), F.lit(False).alias("requires_calculation")))
    rows = raw.withColumn("q", one).select(
        F.coalesce("q.id", F.format_string("q-%03d", F.col("_at") + 1)).alias("id"), "q.question", "q.gold_answer", F.coalesce("q.gold_printed_pages", F.array().cast("array<int>")).alias("gold_printed_pages"),
        "q.answerable", F.coalesce("q.question_type", "q.category", F.lit("unspecified")).alias("question_type"), F.coalesce("q.requires_calculation", F.lit(False)).alias("requires_calculation"),
    )
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("question ids repeat")
    if rows.where("answerable and size(gold_printed_pages) = 0").limit(1).count():
        raise ValueError("an answerable question has no pages")
    return rows


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews as a list of objects with ids or as a map from id to object."""
    review = "correct: boolean, failure_category: string, notes: string"
    text = spark.read.option("wholetext", True).text(path)
    listed = text.where(F.trim("value").startswith("[")).select(F.explode(F.from_json("value", f"array<struct<id: string, {review}>>")).alias("r")).select("r.id", "r.correct", "r.failure_category", "r.notes")
    mapped = text.where(~F.trim("value").startswith("[")).select(F.explode(F.from_json("value", f"map<string, struct<{review}>>")).alias("id", "r")).select("id", "r.correct", "r.failure_category", "r.notes")
    return listed.unionByName(mapped)


def blocks(records: DataFrame) -> DataFrame:
    """A row for each layout block: its place, label, text and box; boxes without four numbers are null."""
    listed = F.coalesce("structured_result.res.parsing_res_list", F.array().cast(BLOCKS))
    rows = records.select("raw_id", F.posexplode(listed).alias("seq", "b"))
    box = F.when(F.size("b.block_bbox") == 4, F.col("b.block_bbox"))
    return rows.select("raw_id", "seq", F.col("b.block_label").alias("label"), F.col("b.block_content").alias("text"), box.alias("bbox"))


def page_parts(sheets: DataFrame, width: str, height: str) -> DataFrame:
    """Sheets at least 1.2 times as wide as high are split into left and right."""
    wide = F.col(width) >= F.lit(1.2) * F.col(height)
    return sheets.withColumn("page_part", F.explode(F.when(wide, F.array(F.lit("left"), F.lit("right"))).otherwise(F.array(F.lit("full")))))


def dominant_offset(pages: DataFrame, index: str, candidates: str, least: int = 3) -> DataFrame:
    """One row (offset, votes): the most frequent difference of printed numbers and places; none below `least` votes."""
    seen = pages.select(index, F.explode(candidates).alias("_seen"))
    votes = seen.groupBy((F.col("_seen") - F.col(index)).alias("offset")).agg(F.count(F.lit(1)).alias("votes"))
    return votes.where(F.col("votes") >= least).orderBy(F.desc("votes"), "offset").limit(1)


def assign_pages(pages: DataFrame, overrides: DataFrame, index: str, candidates: str) -> DataFrame:
    """printed_page and mapping_method: an override, a number detected where the offset expects it, or the offset alone."""
    offset = dominant_offset(pages, index, candidates).select("offset")
    rows = pages.crossJoin(F.broadcast(offset)).join(overrides, index, "left")
    expected = F.col(index) + F.col("offset")
    method = F.when(F.col("override").isNotNull(), "override").when(F.array_contains(candidates, expected), "detected").otherwise("inferred")
    return rows.withColumn("printed_page", F.coalesce("override", expected)).withColumn("mapping_method", method).drop("offset", "override")


def open_shard(rows: DataFrame, done: DataFrame, key: str, shards: int, shard: int) -> DataFrame:
    """Rows of one shard that are not among those done."""
    return rows.where(F.pmod(F.col(key), F.lit(shards)) == shard).join(done, key, "left_anti")


def row_digest(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def write_manifest(rows: DataFrame, columns: list[str], path: str, partition_by: str | None = None) -> DataFrame:
    """Write rows as Parquet with a digest of each; returns the one-row manifest: count and a digest that is independent of order."""
    digested = rows.withColumn("_sha256", row_digest(*columns))
    writer = digested.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return manifest(rows.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("_sha256").cast("decimal(38,0)")).alias("digest"))


def verify(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows whose digest no longer fits their columns."""
    return spark.read.parquet(path).where(row_digest(*columns) != F.col("_sha256"))


def append_log(rows: DataFrame, path: str) -> None:
    """Append decisions as JSON lines; the committer makes each append whole or absent."""
    rows.write.mode("append").json(path)
