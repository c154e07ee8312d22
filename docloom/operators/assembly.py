"""Chunks with their section, parent and metrics: figures read from pages by three extractors, merged by priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.operators import metrics as M
from docloom.sources import records as R
from docloom.storage import materialize

#: Headings that say nothing of what follows.
GENERIC_HEADING = r"(?iu)^(?:điểm nhấn(?:\s+[0-9]{4})?|tổng quan|kết quả(?:\s+[0-9]{4})?|tiếp theo|thành tựu|[“”\"']+)$"
#: How a figure begins, a number in a text, and what no label begins with.
VALUE_START = r"(?iu)^(?:[▲▼+-]\s*)?(?:top\s*)?(?:~\s*)?\(?[0-9]"
NUMBER = r"(?iu)(?<![\p{L}\p{N}_])(?:~\s*)?\(?[0-9][0-9.,]*(?:%|x)?\)?"
NO_LABEL = r"(?iu)^(?:nghìn tỷ đồng|tỷ đồng|triệu đồng|triệu khách hàng|triệu người|tăng|giảm|tăng trưởng|trung bình|tại(?![\p{L}\p{N}_])|dẫn đầu|thuộc nhóm|được thực hiện|chất lượng|n/n|yoy|cagr)"
#: Kinds of boxes that hold no figures.
NO_FIGURES = ("header", "footer", "number", "image")
#: The extractors, the surest first, with their confidence.
EXTRACTORS = (("layout_nearest_label", 0.92), ("structured_multiline", 0.84), ("markdown_sequence_fallback", 0.68))
#: Lines that say what a chunk is about.
ENTITY, PERIOD, CONTEXT, METRIC, VALUE, DETAIL = "Thực thể: ", "Kỳ báo cáo: ", "Ngữ cảnh tài liệu: ", "Chỉ tiêu: ", "Giá trị: ", "Chi tiết: "
FOUND = ("raw_id", "method", "at", "metric", "value", "details")


def clean(text: Column) -> Column:
    """White space runs become one space; none at the ends, and no bars."""
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ |]+|[ |]+$", "")


def is_value(text: Column) -> Column:
    return (F.length(text) <= 100) & text.rlike(VALUE_START)


def is_label(text: Column) -> Column:
    """Words without a figure: short, not a unit or a detail, no sentence."""
    short = (text != "") & (F.length(text) <= 90) & (F.size(F.split(text, " ")) <= 14)
    return short & ~is_value(text) & ~text.rlike(NUMBER) & ~text.rlike(NO_LABEL) & ~text.rlike("[.;:]$") & text.rlike("[A-Za-zÀ-ỹ]")


def is_detail(text: Column) -> Column:
    return text.rlike(M.UNIT) | text.rlike(M.DETAIL)


def from_boxes(blocks: DataFrame) -> DataFrame:
    """Each box with a figure and the label box above it in its column, with details below it."""
    text = clean(T.markdown_to_text(F.coalesce("text", F.lit(""))))
    boxes = blocks.where(~F.coalesce("label", F.lit("")).isin(*NO_FIGURES) & F.col("bbox").isNotNull()).select("raw_id", F.col("seq").alias("id"), text.alias("text"), *(F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))
    boxes = materialize(boxes.where("text <> ''"), "boxes")
    values, labels = boxes.where(is_value(F.col("text"))), boxes.where(is_label(F.col("text")))
    pairs = C.nearest_labels(values, labels, "raw_id")
    details = M.details_below(values, boxes, "raw_id")
    said = lambda df, id_, out: df.select("raw_id", F.col("id").alias(id_), F.col("text").alias(out))
    rows = pairs.join(said(labels, "label_id", "metric"), ["raw_id", "label_id"]).join(said(values, "value_id", "value"), ["raw_id", "value_id"]).join(details, ["raw_id", "value_id"], "left")
    return rows.select("raw_id", F.lit(0).alias("method"), F.col("value_id").alias("at"), "metric", "value", F.coalesce("details", F.array().cast("array<string>")).alias("details"))


def from_lines(blocks: DataFrame) -> DataFrame:
    """Blocks whose first line is a label and a later one a figure, with the two lines after it."""
    lines = F.filter(F.transform(F.split(T.markdown_to_text(F.coalesce("text", F.lit(""))), "\n"), clean), lambda x: x != "")
    rows = blocks.select("raw_id", "seq", lines.alias("_l")).where(F.size("_l") >= 2)
    first = F.array_min(F.filter(F.transform("_l", lambda x, i: F.when((i > 0) & is_value(x), i)), lambda i: i.isNotNull()))
    rows = rows.withColumn("_at", first).where(is_label(F.get("_l", F.lit(0))) & F.col("_at").isNotNull())
    return rows.select("raw_id", F.lit(1).alias("method"), F.col("seq").alias("at"), F.get("_l", F.lit(0)).alias("metric"), F.get("_l", F.col("_at")).alias("value"), F.slice("_l", F.col("_at") + 2, F.lit(2)).alias("details"))


def from_markdown(records: DataFrame) -> DataFrame:
    """Lines of a page that are a label followed by a figure; details among the next three, up to the next label."""
    plain = T.markdown_to_text(F.regexp_replace(F.coalesce("markdown", F.lit("")), "<[^>]+>", ""))
    lines = F.filter(F.transform(F.split(plain, "\n"), clean), lambda x: ~x.isin("", "___", "---"))
    rows = records.select("raw_id", lines.alias("_l")).select("raw_id", "_l", F.posexplode("_l").alias("at", "metric"))
    rows = rows.withColumn("value", F.get("_l", F.col("at") + 1)).where(is_label(F.col("metric")) & is_value(F.col("value")))
    after = F.slice("_l", F.col("at") + 3, F.lit(3))
    stops = F.array_min(F.filter(F.transform(after, lambda x, i: F.when(is_label(x) & ~is_detail(x), i)), lambda i: i.isNotNull()))
    kept = F.filter(F.slice(after, F.lit(1), F.coalesce(stops, F.size(after))), lambda x: is_detail(x) | is_value(x))
    return rows.select("raw_id", F.lit(2).alias("method"), "at", "metric", "value", kept.alias("details"))


def metric_values(records: DataFrame) -> DataFrame:
    """(raw_id, sequence, metric, value, details, numbers, years, unit, method, confidence): figures of pages, each metric once.

    Of several extractors that find a metric the surest one counts, and of its findings the first.
    """
    blocks = materialize(R.blocks(records), "blocks")
    found = from_boxes(blocks).select(*FOUND).union(from_lines(blocks).select(*FOUND)).union(from_markdown(records).select(*FOUND))
    key = F.trim(F.regexp_replace(F.lower("metric"), r"[^\p{L}\p{N}_]+", " "))
    found = found.withColumn("_key", key).where("_key <> ''")
    order = [F.col("method"), F.col("at"), F.col("metric"), F.col("value")]
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("raw_id", "_key").orderBy(*order))).where("_n = 1")
    first = first.withColumn("sequence", F.row_number().over(Window.partitionBy("raw_id").orderBy(*order)))
    details = F.filter(F.transform("details", clean), lambda x: x != "")
    first = first.withColumn("details", details).withColumn("_joined", F.concat_ws(" ", "value", F.array_join("details", " ")))
    unit = F.regexp_extract("_joined", M.UNIT, 0)
    named = F.array(*(F.struct(F.lit(n).alias("method"), F.lit(c).alias("confidence")) for n, c in EXTRACTORS))
    return first.withColumn("_m", F.get(named, F.col("method"))).select(
        "raw_id", "sequence", "metric", "value", "details", T.all_matches(F.col("_joined"), NUMBER).alias("numbers"), T.years(F.col("_joined")).alias("years"), F.when(unit != "", unit).alias("unit"), F.col("_m.method").alias("method"), F.col("_m.confidence").alias("confidence")
    )


def section_paths(records: DataFrame) -> DataFrame:
    """(raw_id, local_heading, section_path): the last heading of the document that says something, then the page's own if it is another."""
    local = clean(T.markdown_to_text(T.markdown_heading(F.coalesce("markdown", F.lit("")))))
    rows = records.select("raw_id", "source", "logical_index", local.alias("local_heading"))
    specific = F.when((F.col("local_heading") != "") & ~F.col("local_heading").rlike(GENERIC_HEADING), F.col("local_heading"))
    w = Window.partitionBy("source").orderBy("logical_index", "raw_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_section", F.coalesce(F.last(specific, ignorenulls=True).over(w), F.lit("")))
    path = F.array(F.col("_section"), F.when(F.col("local_heading") != F.col("_section"), F.col("local_heading")).otherwise(F.lit("")))
    return rows.select("raw_id", "local_heading", F.filter(path, lambda x: x != "").alias("section_path"))


def parent_texts(chunks: DataFrame, most: int) -> DataFrame:
    """(raw_id, parent_text): the blocks of a page, or its page chunks if it has none, joined up to `most` characters.

    Only what reaches into the first `most` characters is gathered.
    """
    rows = chunks.where(F.col("granularity").isin("block", "page")).withColumn("_block", F.max((F.col("granularity") == "block").cast("int")).over(Window.partitionBy("raw_id")))
    rows = rows.where((F.col("_block") == 1) == (F.col("granularity") == "block"))
    before = Window.partitionBy("raw_id").orderBy("seq", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0))).where(F.col("_before") < most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", F.left("text", F.lit(most)).alias("text")))), lambda x: x["text"])
    return rows.groupBy("raw_id").agg(F.regexp_replace(F.left(F.array_join(listed, "\n\n"), F.lit(most)), r"\s+$", "").alias("parent_text"))


def assembled_chunks(chunks: DataFrame, records: DataFrame, most: int = 2400, entity: str = "", year: int | None = None) -> DataFrame:
    """Chunks under lines of entity, period and context, and one more for each metric of their pages; stored, with ids that differ.

    chunks: chunk_id, raw_id, seq, text, granularity; records: raw_id, source, logical_index, printed_page,
    markdown, structured_result. A chunk's id begins with a31_ in place of a3_; rows get the text of
    their page as parent_text, metric chunks do too and semantic_fields besides. Ids that repeat are an error.
    """
    records = materialize(records.select("raw_id", "source", "logical_index", "printed_page", "markdown", "structured_result"), "records")
    paths = section_paths(records).withColumn("section_heading", F.coalesce(F.get("section_path", F.lit(0)), F.lit("")))
    paths = paths.withColumn("resolved_entity", M.resolved_entity(F.col("section_heading"), F.lit(entity), "công ty", "khối")).withColumn("context", F.array_join("section_path", " > "))
    paths = materialize(paths, "paths")
    line = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    scope = [line(ENTITY, F.col("resolved_entity")), line(PERIOD, F.lit(year).cast("string")), line(CONTEXT, F.col("context"))]
    parents = parent_texts(chunks, most)
    fields = "struct<entity: string, metric: string, value: string, details: array<string>, numbers: array<string>, years: array<string>, unit: string>"
    page = records.select("raw_id", "printed_page", "logical_index")
    common = ["raw_id", "printed_page", "section_path", "section_heading", "resolved_entity", F.lit(year).cast("int").alias("reporting_year"), "local_heading", (F.size("section_path") > 1).alias("heading_inherited"), F.concat(F.lit("a31_parent_"), "raw_id").alias("parent_id")]
    no_path = F.coalesce("section_path", F.array().cast("array<string>"))
    own = chunks.select("chunk_id", "raw_id", "text", "granularity").join(paths, "raw_id", "left").join(page, "raw_id", "left").join(parents, "raw_id", "left").withColumn("section_path", no_path)
    own = own.select(
        F.regexp_replace("chunk_id", "^a3_", "a31_").alias("chunk_id"), F.concat_ws("\n", *scope, "text").alias("text"), "granularity", *common,
        F.when(F.col("granularity") == "row", F.coalesce("parent_text", F.lit(""))).alias("parent_text"), F.lit(None).cast(fields).alias("semantic_fields"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("confidence"),
    )
    found = metric_values(records).join(paths, "raw_id").join(page, "raw_id").join(parents, "raw_id", "left")
    body = [line(METRIC, F.col("metric")), line(VALUE, F.col("value")), line(DETAIL, F.array_join("details", " | "))]
    semantic = F.struct(F.when(F.col("resolved_entity") != "", F.col("resolved_entity")).alias("entity"), "metric", "value", "details", "numbers", "years", "unit")
    metrics = found.select(
        F.format_string("a31_%s_metric_%04d", "raw_id", "sequence").alias("chunk_id"), F.concat_ws("\n", *scope, *body).alias("text"), F.lit("metric").alias("granularity"), *common,
        F.coalesce("parent_text", F.lit("")).alias("parent_text"), semantic.cast(fields).alias("semantic_fields"), "method", "confidence",
    )
    out = materialize(own.unionByName(metrics), "assembled")
    if twice := out.groupBy("chunk_id").count().where("count > 1").limit(3).collect():
        raise ValueError(f"chunk ids repeat: {', '.join(str(r.chunk_id) for r in twice)}")
    return out
