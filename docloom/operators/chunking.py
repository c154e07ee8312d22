"""Pages and chunks: margins, windows, tables, layout."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

BREAK = re.compile(r"[ \n]")
TAG = re.compile(r"<[^>]*>")
TABLE = re.compile(r"(?is)<table\b[^>]*>(.*?)(?=<table\b|</table|\Z)")
ROW = re.compile(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr|\Z)")
CELL = re.compile(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]\b|\Z)")
#: The line between the header and the rows of a pipe table.
PIPE_RULE = re.compile(r"[\s|:-]*")


def repeated_margins(pages: DataFrame, key: str, text: str, least: int = 8, share: float = 0.01) -> DataFrame:
    """(line, pages): lines at the edges of at least max(least, share of all) pages."""
    total = pages.agg(F.count(F.lit(1)).alias("_total"))
    lines = pages.select(F.explode(T.edge_lines(F.col(text))).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("pages"))
    enough = F.greatest(F.lit(float(least)), F.floor(F.lit(share) * F.col("_total")).cast("double"))
    return lines.crossJoin(F.broadcast(total)).where(F.col("pages") >= enough).select("line", "pages")


def cleaned_pages(pages: DataFrame, key: str, text: str, least: int = 8, share: float = 0.01) -> DataFrame:
    """Pages without repeated margins. There are at most 8 / share of those, so they go to every task."""
    margins = repeated_margins(pages, key, text, least, share).agg(F.collect_list("line").alias("_drop"))
    return pages.crossJoin(F.broadcast(margins)).withColumn(text, T.clean_page(F.col(text), F.col("_drop"))).drop("_drop")


def fixed_windows(pages: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, seq, text): windows at fixed steps."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.length(text)) - 1, F.lit(step))
    return pages.select(key, text, F.posexplode(starts).alias("seq", "_start")).select(key, "seq", F.substring(F.col(text), F.col("_start") + 1, F.lit(size)).alias("text"))


def window_spans(length: int, breaks: Sequence[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of windows over a text of that length. breaks: sorted places of its spaces and newlines.

    A window stops at its last break if that lies beyond 70 % of it; the next one takes `overlap` back.
    """
    start = stop = 0
    while stop < length:
        stop = min(start + size, length)
        if stop < length:
            nearest = bisect_left(breaks, stop) - 1
            if nearest >= 0 and breaks[nearest] >= max(start + 1, start + int(size * 0.7)):
                stop = breaks[nearest]
        yield start, stop
        start = max(start + 1, stop - overlap)


def cut(text: str, size: int, overlap: int) -> list[str]:
    """The windows of a text, without white space at their ends and without empty ones."""
    breaks = [m.start() for m in BREAK.finditer(text)]
    windows = (text[a:b].strip() for a, b in window_spans(len(text), breaks, size, overlap))
    return [w for w in windows if w]


def overlap_windows(pages: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, seq, text): windows that depend on where the one before ended; Arrow batches go to Python."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(k, i, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, w in enumerate(cut(t or "", size, overlap))]
            keys, seq, out = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(seq, pa.int32()), pa.array(out, pa.string())], names=[key, "seq", "text"])

    return pages.select(key, text).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, seq int, text string")


def _plain(markup: str) -> str:
    return " ".join(html.unescape(TAG.sub(" ", markup)).split())


def _pipe_rows(markup: str, pipes: int) -> list[list[str]]:
    lines = (x.strip() for x in markup.splitlines() if not PIPE_RULE.fullmatch(x))
    return [[" ".join(c.split()) for c in x.strip("|").split("|")] for x in lines if x.count("|") >= pipes]


def tables_of(markup: str, pipes: int = 2) -> list[list[list[str]]]:
    """Cells of HTML tables, or of a pipe table (lines with so many pipes) if there is no HTML one; rows without text are left out.

    A table, row or cell lasts until its end tag, the next one of its kind, or what it lies in ends.
    """
    grids = [[[_plain(c) for c in CELL.findall(r)] for r in ROW.findall(t)] for t in TABLE.findall(markup)]
    return [[r for r in g if any(r)] for g in grids or [x for x in [_pipe_rows(markup, pipes)] if x]]


def row_texts(rows: list[list[str]], unnamed: str = "column") -> list[str]:
    """`header: value | ...` of each row below the first; the header alone if there is no other row. Columns without a header are `unnamed` and their number."""
    if not rows:
        return []
    head, *body = rows
    if not body:
        return [" | ".join(filter(None, head))]
    width = max(map(len, rows))
    labels = [h or f"{unnamed} {i}" for i, h in enumerate(head + [""] * (width - len(head)), 1)]
    return [" | ".join(f"{label}: {cell}" for label, cell in zip(labels, r) if cell) for r in body]


def table_rows(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, table, row, text) of each row of the tables in markup; a parser's state goes to Python."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(k, i, j, x) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, one in enumerate(tables_of(t or "")) for j, x in enumerate(row_texts(one))]
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[key, "table", "row", "text"])

    return pages.select(key, markup).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, table int, row int, text string")


def inherit_headings(pages: DataFrame, group: list[str], order: list[str], heading: str, out: str = "section") -> DataFrame:
    """The last specific heading at or before each page of a group; empty and null ones are not specific."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn(out, F.last(F.when(F.col(heading) != "", F.col(heading)), ignorenulls=True).over(w))


def headings_with_reset(blocks: DataFrame, group: list[str], order: list[str], kind: str, text: str) -> DataFrame:
    """title and subtitle that hold at each block: a title clears the subtitle of what came before."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    titled = blocks.withColumn("_part", F.count_if(F.col(kind) == "title").over(w)).withColumn("title", F.last(F.when(F.col(kind) == "title", F.col(text)), ignorenulls=True).over(w))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return titled.withColumn("subtitle", F.last(F.when(F.col(kind) == "subtitle", F.col(text)), ignorenulls=True).over(inside)).drop("_part")


def nearest_labels(values: DataFrame, labels: DataFrame, group: str, far: float = 220.0) -> DataFrame:
    """For each value box the label box above it in its column: least gap, then least shift of centres, then label id.

    Boxes: (group, id, x0, y0, x1, y1). In a column: a quarter of the narrower box overlaps, or centres within 100.
    """
    v, lab = values.alias("v"), labels.alias("l")
    gap = F.col("v.y0") - F.col("l.y1")
    shared = F.least("v.x1", "l.x1") - F.greatest("v.x0", "l.x0")
    narrow = F.least(F.col("v.x1") - F.col("v.x0"), F.col("l.x1") - F.col("l.x0"))
    shift = F.abs((F.col("v.x0") + F.col("v.x1")) / 2 - (F.col("l.x0") + F.col("l.x1")) / 2)
    column = (shared / F.greatest(narrow, F.lit(1e-9)) >= 0.25) | (shift <= 100)
    pairs = v.join(lab, (F.col(f"v.{group}") == F.col(f"l.{group}")) & gap.between(0, far) & column)
    best = F.min_by(F.col("l.id"), F.struct(gap, shift, F.col("l.id")))
    return pairs.groupBy(F.col(f"v.{group}").alias(group), F.col("v.id").alias("value_id")).agg(best.alias("label_id"))
