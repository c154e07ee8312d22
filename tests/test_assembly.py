"""Figures from pages by three extractors, and the chunks made of them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import assembly as AS
from docloom.sources.records import RECORD

CHUNK = "chunk_id string, raw_id string, seq int, text string, granularity string"


def record(raw_id, index, markdown, boxes=(), source="r"):
    res = {"res": {"parsing_res_list": [{"block_label": k, "block_content": t, "block_bbox": b and [float(x) for x in b], "block_order": i} for i, (k, t, b) in enumerate(boxes)]}}
    return (raw_id, index, index, index + 1, "right", index + 10, "test", source, markdown, res)


def values(spark, *records):
    return [(r.raw_id, r.sequence, r.metric, r.value, r.details, r.numbers, r.years, r.unit, r.method, r.confidence) for r in AS.metric_values(spark.createDataFrame(list(records), RECORD)).orderBy("raw_id", "sequence").collect()]


def test_boxes_lines_and_markdown(spark):
    boxes = [
        ("text", "Tổng  tài sản", [0, 0, 100, 20]), ("text", "1.192", [0, 30, 90, 50]), ("text", "nghìn tỷ đồng", [0, 60, 90, 70]), ("text", "Tăng 22% so với 2024", [0, 80, 90, 99]), ("header", "Không", [0, 10, 90, 15]),
        ("text", "Khách hàng", [500, 0, 600, 20]), ("text", "~17%", [500, 40, 590, 60]), ("text", "không hộp", None), ("text", "Nợ xấu\nmột dòng\n1,1%\nchi tiết\nthêm\nbỏ", [900, 900, 999, 950]), ("text", "Xa", [0, 400, 10, 410]), ("text", "9", [0, 700, 10, 710]),
    ]
    markdown = "# Đầu\nTổng tài sản\n5\nLợi nhuận\n<b>32.538</b>\n| tỷ đồng |\nTăng 18%\nVốn\n12\nkhông gì\nxin"
    got = values(spark, record("a", 1, markdown, boxes), record("b", 2, None), record("c", 3, ""))
    assert got == [
        ("a", 1, "Tổng tài sản", "1.192", ["nghìn tỷ đồng", "Tăng 22% so với 2024"], ["1.192", "22%", "2024"], ["2024"], "nghìn tỷ đồng", "layout_nearest_label", 0.92),
        ("a", 2, "Khách hàng", "~17%", [], ["~17%"], [], "%", "layout_nearest_label", 0.92),
        ("a", 3, "Nợ xấu", "1,1%", ["chi tiết", "thêm"], ["1,1%"], [], "%", "structured_multiline", 0.84),
        ("a", 4, "Lợi nhuận", "32.538", ["tỷ đồng", "Tăng 18%"], ["32.538", "18%"], [], "tỷ đồng", "markdown_sequence_fallback", 0.68),
        ("a", 5, "Vốn", "12", [], ["12"], [], None, "markdown_sequence_fallback", 0.68),
    ]


WORDS = ["Vốn", "Nợ xấu", "Tổng", "tăng mạnh", "2024", "17%", "~5x", "1.234", "tỷ đồng", "so với 2023", "Câu hết.", "Dài " * 15, "", "▲ 3", "Top 10"]


def plain_markdown(lines):
    label = lambda x: x and len(x) <= 90 and len(x.split()) <= 14 and not value(x) and not re.search(r"(?<!\w)\d", x) and not re.match(AS.NO_LABEL.replace(r"(?iu)", "").replace(r"(?![\p{L}\p{N}_])", r"\b"), x, re.I) and x[-1] not in ".;:" and re.search("[A-Za-zÀ-ỹ]", x)
    value = lambda x: len(x) <= 100 and re.match(r"(?:[▲▼+-]\s*)?(?:top\s*)?(?:~\s*)?\(?\d", x, re.I)
    detail = lambda x: re.search(r"\btỷ đồng\b|%", x) or re.match(r"(?:tăng|so với|~)", x, re.I)
    lines = [" ".join(x.split()) for x in lines]
    lines = [x for x in lines if x]
    out, seen = [], set()
    for i in range(len(lines) - 1):
        if label(lines[i]) and value(lines[i + 1]):
            details = []
            for x in lines[i + 2 : i + 5]:
                if label(x) and not detail(x):
                    break
                if detail(x) or value(x):
                    details.append(x)
            key = " ".join(re.findall(r"\w+", lines[i].lower()))
            if key not in seen:
                seen.add(key)
                out.append((lines[i], lines[i + 1], details))
    return out


def test_lines_of_pages_equal_plain_python(spark):
    rng = random.Random(4)
    pages = [[rng.choice(WORDS) for _ in range(rng.randint(0, 14))] for _ in range(60)]
    got = {}
    for r in values(spark, *(record(f"{i:03d}", i, "\n".join(p)) for i, p in enumerate(pages))):
        got.setdefault(int(r[0]), []).append((r[2], r[3], r[4]))
    assert got == {i: want for i, p in enumerate(pages) if (want := plain_markdown(p))}


def test_sections_and_parents(spark):
    records = spark.createDataFrame([record("p1", 1, "# Khối bán lẻ\nx"), record("p2", 2, "# Điểm nhấn 2025\nx"), record("p3", 3, "x"), record("p4", 4, "## Công ty ABC"), record("q", 2, "# Tổng quan", source="other")], RECORD)
    got = {r.raw_id: (r.local_heading, r.section_path) for r in AS.section_paths(records).collect()}
    assert got == {"p1": ("Khối bán lẻ", ["Khối bán lẻ"]), "p2": ("Điểm nhấn 2025", ["Khối bán lẻ", "Điểm nhấn 2025"]), "p3": ("", ["Khối bán lẻ"]), "p4": ("Công ty ABC", ["Công ty ABC"]), "q": ("Tổng quan", ["Tổng quan"])}
    chunks = spark.createDataFrame([("a3_1", "p1", 1, "b" * 20, "block"), ("a3_0", "p1", 0, "a" * 20, "block"), ("a3_2", "p1", 2, "c" * 20, "block"), ("a3_3", "p1", 3, "page", "page"), ("a3_4", "p2", 0, "only ", "page"), ("a3_5", "p3", 0, "row", "row")], CHUNK)
    assert {r.raw_id: r.parent_text for r in AS.parent_texts(chunks, 30).collect()} == {"p1": "a" * 20 + "\n\n" + "b" * 8, "p2": "only"}


def test_assembled_chunks(spark):
    records = spark.createDataFrame([record("p1", 1, "# Khối bán lẻ\nVốn\n12"), record("p2", 2, "# Tổng quan")], RECORD)
    chunks = spark.createDataFrame([("a3_p1_block_1", "p1", 0, "nội dung", "block"), ("a3_p1_row_1", "p1", 1, "dòng", "row"), ("a3_lost", "none", 0, "t", "block")], CHUNK)
    got = {r.chunk_id: r for r in AS.assembled_chunks(chunks, records, entity="Bank", year=2025).collect()}
    assert set(got) == {"a31_p1_block_1", "a31_p1_row_1", "a31_lost", "a31_p1_metric_0001"}
    assert got["a31_p1_row_1"].text == "Thực thể: Bank — Khối bán lẻ\nKỳ báo cáo: 2025\nNgữ cảnh tài liệu: Khối bán lẻ\ndòng" and got["a31_p1_row_1"].parent_text == "nội dung"
    assert got["a31_p1_block_1"].parent_text is None and got["a31_p1_block_1"].parent_id == "a31_parent_p1" and got["a31_p1_block_1"].printed_page == 11
    metric = got["a31_p1_metric_0001"]
    assert metric.text.endswith("\nChỉ tiêu: Vốn\nGiá trị: 12") and metric.semantic_fields.entity == "Bank — Khối bán lẻ" and (metric.method, metric.confidence) == ("markdown_sequence_fallback", 0.68)
    with pytest.raises(ValueError, match="a31_x"):
        AS.assembled_chunks(spark.createDataFrame([("a3_x", "p1", 0, "t", "block"), ("a31_x", "p1", 1, "u", "block")], CHUNK), records)


def test_markdown_to_text(spark):
    text = "# T &amp; Co\r\n\r\n\n* item\n1. one\n```py\ncode\n```\n![pic](x.png) [link](u)\n| a | b |\n|---|:-:|\n| 1 |  |\n<table><tr><td>x</td><td>y</td></tr></table>z<br/>**w** ~~v~~ `c` a_b &lt;i&gt;"
    df = spark.createDataFrame([(text,), (None,), ("",), ("no marks",)], "t string")
    assert [r[0] for r in df.select(T.markdown_to_text(F.col("t"))).collect()] == ["T & Co\n\nitem\none\ncode\npic link\na ; b\n1\nx ; y ;\n\nz\nw v c ab <i>", None, "", "no marks"]
