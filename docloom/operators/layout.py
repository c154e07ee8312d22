"""Chunks of recognised pages that follow their layout: text under its headings, tables by whole rows.

raw_id names a record and is expected once. A record without blocks, or whose blocks say nothing, falls
back to its Markdown; one without that gives no chunk. Null labels and texts count as empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.sources import records as S

# fixed values: labels of layout recognition, and the words that chunks carry
HEADINGS = ("doc_title", "paragraph_title")
IGNORED = ("header", "footer", "number", "image")
SELECTIVE = ("table", "chart", "figure_title", "vision_footnote", "display_formula")
BESIDE_FIGURES = ("figure_title", "vision_footnote")
FIGURES = ("table", "chart")
HEADING_LINE = "Tiêu đề: "
UNNAMED = "Cột"
PREVIEW = 240

META = ("logical_index", "pdf_page_index", "pdf_page", "page_part", "printed_page", "mapping_method", "source")
LAST = 2**31 - 1
#: Markup that can hold letters without saying anything.
SILENT = r"<[^>]*>|```[^\n]*|\]\([^)]*\)|&[#\w]+;"


def rows_in(content: str) -> list[str]:
    """The rows of all tables in a block as one, under the first row as their header."""
    grid = [r for one in C.tables_of(content, pipes=1) for r in one]
    return [x for x in C.row_texts(grid, UNNAMED) if x]


def _table_rows(content: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else rows_in(x))

    return F.pandas_udf(run, "array<string>")(content)


def _windows(text: Column, size: int) -> Column:
    """Texts beyond size go to Python to be cut; others are their own window."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else C.cut(x, size, 0))

    long = F.length(text) > size
    return F.when(long, F.pandas_udf(run, "array<string>")(F.when(long, text))).otherwise(F.array(_strip(text)))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def with_heading(text: Column, heading: Column) -> Column:
    return F.when(heading != "", F.concat(F.lit(HEADING_LINE), heading, F.lit("\n"), text)).otherwise(text)


def headed_blocks(records: DataFrame) -> DataFrame:
    """(raw_id, seq, label, content, plain, heading, run, meta): blocks in order with the headings that hold for them; content is the markup of tables alone.

    A document title clears the paragraph title before it. run counts the headings and tables so far:
    text between two of them belongs together.
    """
    listed = F.coalesce("structured_result.res.parsing_res_list", F.array().cast(S.BLOCKS))
    rows = records.select("raw_id", F.struct(*META).alias("meta"), F.posexplode(listed).alias("seq", "b"))
    content = _strip(F.coalesce("b.block_content", F.lit("")))
    rows = rows.select("raw_id", "seq", "meta", F.coalesce("b.block_label", F.lit("unknown")).alias("label"), content.alias("content"))
    rows = rows.where("content <> ''").withColumn("plain", T.markdown_to_text(F.col("content")))
    rows = rows.withColumn("content", F.when(F.col("label") == "table", F.col("content")))  # markup of others need not travel
    breaks = F.col("label").isin(*HEADINGS, "table")
    so_far = Window.partitionBy("raw_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.when(F.col("label") == HEADINGS[0], "title").when(F.col("label") == HEADINGS[1], "subtitle").otherwise("text")
    rows = rows.withColumn("run", F.count_if(breaks).over(so_far).cast("int")).withColumn("_kind", kind).withColumn("_said", T.squeeze(F.col("plain")))
    rows = C.headings_with_reset(rows, ["raw_id"], ["seq"], "_kind", "_said")
    parts = F.filter(F.array("title", "subtitle"), lambda x: x.isNotNull() & (x != ""))
    return rows.withColumn("heading", F.array_join(parts, " > ")).drop("_kind", "_said", "title", "subtitle")


def pieces(blocks: DataFrame) -> DataFrame:
    """What is packed: a row for each table row, and for each other block that says something. Headings are not packed, margins not read."""
    body = blocks.where(~F.col("label").isin(*HEADINGS, *IGNORED))
    plain = F.when(F.col("plain") != "", F.array("plain")).otherwise(F.array().cast("array<string>"))
    rows = _table_rows(F.col("content"))
    texts = F.when(F.size(F.coalesce(rows, F.array().cast("array<string>"))) > 0, rows).otherwise(plain)
    return body.select("raw_id", "seq", "label", "run", "heading", "meta", F.posexplode(texts).alias("row", "text"))


def _unsure(records: DataFrame) -> DataFrame:
    """The Markdown of records whose blocks may say nothing: where one certainly does, it does not travel."""
    listed = F.coalesce("structured_result.res.parsing_res_list", F.array().cast(S.BLOCKS))
    label = lambda b: F.coalesce(b["block_label"], F.lit("unknown"))
    speaks = F.exists(listed, lambda b: ~label(b).isin(*HEADINGS, *IGNORED) & F.regexp_replace(F.coalesce(b["block_content"], F.lit("")), SILENT, " ").rlike(r"[\p{L}\p{N}]"))
    return records.where(~speaks & F.col("markdown").isNotNull())


class Packing:
    """A table function over the pieces of one record in order: joins them while they fit, and cuts what alone is too long."""

    def __init__(self):
        self.open, self.key, self.heading, self.length, self.seq, self.meta, self.set = [], None, "", 0, 0, None, None

    def eval(self, piece, size: int, overlap: int):
        kind = {"table": "table", "_page": "fallback_page"}.get(piece["label"], "narrative")
        self.set = (size, overlap)
        if kind == "fallback_page" and (self.open or self.seq):
            return
        key = (kind, piece["run"])
        joined = self.length + (1 if kind == "table" else 2) + len(piece["text"])
        if self.open and (key != self.key or joined > size):
            yield from self.flush()
        if not self.open:
            self.key, self.heading, self.meta, self.raw_id = key, piece["heading"], piece["meta"], piece["raw_id"]
            head = len(HEADING_LINE) + len(self.heading) + 1 if self.heading else 0
            joined = head + len(piece["text"])
        self.open.append(piece["text"])
        self.length = joined

    def flush(self):
        kind = self.key[0]
        text = ("\n" if kind == "table" else "\n\n").join(self.open)
        self.open = []
        for window in C.cut(f"{HEADING_LINE}{self.heading}\n{text}" if self.heading else text, *self.set):
            self.seq += 1
            yield self.raw_id, self.seq, window, kind, self.heading, self.meta

    def terminate(self):
        if self.open:
            yield from self.flush()


def _chunks(rows: DataFrame, experiment: str, granularity: str) -> DataFrame:
    chunk_id = F.format_string(f"{experiment}_%s_{granularity}_%04d", "raw_id", "seq")
    return rows.select(chunk_id.alias("chunk_id"), "raw_id", F.col("seq").cast("int").alias("seq"), "text", "block_type", F.lit(granularity).alias("granularity"), "heading", "meta.*")


def _packed(records: DataFrame, lines: DataFrame, experiment: str, size: int, overlap: int) -> DataFrame:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    whole = _unsure(records).select("raw_id", F.lit(LAST).alias("seq"), F.lit("_page").alias("label"), F.lit(0).alias("run"), F.lit("").alias("heading"), F.struct(*META).alias("meta"), F.lit(0).alias("row"), T.markdown_to_text(F.col("markdown")).alias("text"))
    rows = lines.unionByName(whole.where("text <> ''"))
    meta = rows.schema["meta"].dataType.simpleString()
    pack = F.udtf(Packing, returnType=f"raw_id: string, seq: int, text: string, block_type: string, heading: string, meta: {meta}")
    out = pack(rows.asTable().partitionBy("raw_id").orderBy("seq", "row"), F.lit(size), F.lit(overlap))
    return _chunks(out, experiment, "block")


def layout_chunks(records: DataFrame, experiment: str = "a2", size: int = 3200, overlap: int = 200) -> DataFrame:
    """(chunk_id, raw_id, seq, text, block_type, granularity, heading, and the record's place): blocks packed up to size characters.

    Text is joined until a heading or a table comes; a table is cut between rows, each of which names its
    columns. Every chunk begins with its heading. Blocks of a page reach one task in order and pass through
    it; only the chunk being filled is held.
    """
    return _packed(records, pieces(headed_blocks(records)), experiment, size, overlap)


def table_row_chunks(lines: DataFrame, experiment: str) -> DataFrame:
    """A chunk for each row of a table."""
    n = F.row_number().over(Window.partitionBy("raw_id").orderBy("seq", "row"))
    rows = lines.where("label = 'table'").withColumn("n", n)
    return _chunks(rows.select("raw_id", F.col("n").alias("seq"), _strip(with_heading(F.col("text"), F.col("heading"))).alias("text"), F.lit("table_row").alias("block_type"), "heading", "meta"), experiment, "row")


def page_chunks(blocks: DataFrame, experiment: str, size: int) -> DataFrame:
    """A chunk for each page: label and beginning of its blocks, up to size characters. What lies beyond is dropped before it is gathered."""
    preview = F.when(F.col("label").isin(*HEADINGS), F.left("plain", F.lit(size))).otherwise(F.left("plain", F.lit(PREVIEW)))
    lines = blocks.where(~F.col("label").isin(*IGNORED) & (F.col("plain") != "")).select("raw_id", "seq", "meta", F.concat("label", F.lit(": "), preview).alias("line"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy("raw_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pages = lines.withColumn("_at", before).where(F.col("_at") < size).groupBy("raw_id").agg(F.first("meta").alias("meta"), F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    text = F.left(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(size))
    return _chunks(pages.select("raw_id", F.lit(1).alias("seq"), _strip(text).alias("text"), F.lit("page_signature").alias("block_type"), F.lit("").alias("heading"), "meta"), experiment, "page")


def multi_granularity(records: DataFrame, size: int = 3200, overlap: int = 200) -> DataFrame:
    """Packed blocks, single table rows and page signatures of the same records, side by side."""
    blocks = headed_blocks(records)
    lines = pieces(blocks)
    return _packed(records, lines, "a3", size, overlap).unionByName(table_row_chunks(lines, "a3")).unionByName(page_chunks(blocks, "a3", size))


def region_chunks(records: DataFrame, size: int = 3200) -> DataFrame:
    """Chunks of what plain extraction loses: tables by row, charts and formulas; titles and notes of figures only on pages with a table or chart."""
    listed = F.coalesce("structured_result.res.parsing_res_list", F.array().cast(S.BLOCKS))
    figured = records.where(F.exists(listed, lambda b: F.coalesce(b["block_label"].isin(*FIGURES), F.lit(False)))).select("raw_id")
    lines = pieces(headed_blocks(records)).where(F.col("label").isin(*SELECTIVE))
    beside = F.col("label").isin(*BESIDE_FIGURES)
    lines = lines.where(~beside).unionByName(lines.where(beside).join(figured, "raw_id", "left_semi"))
    parts = lines.select("raw_id", F.col("seq").alias("_seq"), "row", "label", "heading", "meta", F.posexplode(_windows(with_heading(F.col("text"), F.col("heading")), size)).alias("_part", "text"))
    n = F.row_number().over(Window.partitionBy("raw_id").orderBy("_seq", "row", "_part"))
    return _chunks(parts.withColumn("seq", n).withColumnRenamed("label", "block_type"), "a4", "structured_region")


def cascade_chunks(pages: DataFrame, records: DataFrame, size: int = 3200, overlap: int = 480) -> DataFrame:
    """Windows of the extracted text of pages (page_id, text), and the regions that recognition adds to them."""
    windows = C.overlap_windows(pages, "page_id", "text", size, overlap)
    told = windows.select(F.format_string("a4_narrative_%s_chunk%02d", F.col("page_id").cast("string"), F.col("seq") + 1).alias("chunk_id"), "text", F.lit("narrative").alias("block_type"), F.lit("narrative").alias("granularity"))
    return told.unionByName(region_chunks(records, size).select("chunk_id", "text", "block_type", "granularity"))


def cascade_summary(chunks: DataFrame) -> DataFrame:
    """(granularity, block_type, chunks)."""
    return chunks.groupBy("granularity", "block_type").agg(F.count(F.lit(1)).alias("chunks"))
