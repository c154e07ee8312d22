"""Chunks by layout, against plain loops over the same blocks."""

import random

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.operators import layout as L
from docloom.sources.records import RECORD

TABLE = "<table><tr><th>Chỉ tiêu</th><th>2025</th></tr><tr><td>CASA</td><td>40,4%</td></tr><tr><td>Nợ<br>xấu</td><td>1,13%</td></tr></table>"


def record(raw_id, blocks, markdown=None):
    res = {"res": {"parsing_res_list": [{"block_label": k, "block_content": t, "block_bbox": None, "block_order": i} for i, (k, t) in enumerate(blocks)]}}
    return (raw_id, 4, 2, 3, "right", 5, "detected", "report.pdf", markdown, res)


def records(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


PAGE = record("r1", [("doc_title", "# Điểm nhấn 2025"), ("text", "Tổng tài sản tăng."), ("table", TABLE), ("header", "Báo cáo thường niên"), ("paragraph_title", "Phần"), ("chart", "| a | b |\n|---|---|\n| 1 | 2 |"), ("figure_title", "Hình 1")])


def test_headings_stay_with_text_and_tables(spark):
    got = L.layout_chunks(records(spark, PAGE)).orderBy("seq").collect()
    assert [(r.chunk_id, r.block_type, r.heading, r.printed_page) for r in got] == [
        ("a2_r1_block_0001", "narrative", "Điểm nhấn 2025", 5), ("a2_r1_block_0002", "table", "Điểm nhấn 2025", 5), ("a2_r1_block_0003", "narrative", "Điểm nhấn 2025 > Phần", 5),
    ]
    assert got[0].text == "Tiêu đề: Điểm nhấn 2025\nTổng tài sản tăng."
    assert got[1].text == "Tiêu đề: Điểm nhấn 2025\nChỉ tiêu: CASA | 2025: 40,4%\nChỉ tiêu: Nợ xấu | 2025: 1,13%"
    assert got[2].text.endswith("\na ; b\n1 ; 2\n\nHình 1")


def test_rows_blocks_and_pages(spark):
    got = L.multi_granularity(records(spark, PAGE, record("r2", []))).collect()
    by = {g: [r for r in got if r.granularity == g] for g in ("block", "row", "page")}
    assert {g: len(v) for g, v in by.items()} == {"block": 3, "row": 2, "page": 1} and len({r.chunk_id for r in got}) == 6
    assert sorted(r.text for r in by["row"])[0] == "Tiêu đề: Điểm nhấn 2025\nChỉ tiêu: CASA | 2025: 40,4%"
    page = by["page"][0].text.split("\n")
    assert page[:2] == ["doc_title: Điểm nhấn 2025", "text: Tổng tài sản tăng."] and "Báo cáo" not in by["page"][0].text


def test_regions_only(spark):
    lone = record("r3", [("figure_title", "Hình"), ("text", "x"), ("display_formula", "E = m"), ("table", None), (None, "y")])
    none = record("r4", [("figure_title", "Hình"), ("vision_footnote", "Chú")])
    pages = spark.createDataFrame([(1, "Embedded narrative text."), (2, None)], "page_id int, text string")
    chunks = L.cascade_chunks(pages, records(spark, PAGE, lone, none), 40, 0)
    got = {(r.chunk_id, r.block_type, r.text) for r in chunks.collect()}
    assert ("a4_narrative_1_chunk01", "narrative", "Embedded narrative text.") in got
    assert {(i, k) for i, k, _ in got if i.startswith("a4_r3")} == {("a4_r3_structured_region_0001", "figure_title"), ("a4_r3_structured_region_0002", "display_formula")}
    assert not [i for i, *_ in got if i.startswith("a4_r4")] and not [t for i, k, t in got if "Tổng tài sản" in t]
    assert {(r.block_type, r.chunks) for r in L.cascade_summary(chunks).collect()} >= {("narrative", 1), ("display_formula", 1)}
    assert all(len(t) <= 40 for *_, t in got)


def test_markdown_where_blocks_are_silent(spark):
    silent = [("text", "![](a.png)"), ("header", "Kept out"), ("table", "<table></table>"), ("doc_title", "Only a title")]
    rows = [record("a", silent, "# Whole\npage"), record("b", [], "w " * 30), record("c", silent, None), record("d", [("text", "said")], "not used"), record("e", [("text", "![](q)"), ("text", "&amp;")], "not used")]
    got = L.layout_chunks(records(spark, *rows), size=40, overlap=5).orderBy("raw_id", "seq").collect()
    assert [(r.raw_id, r.block_type) for r in got] == [("a", "fallback_page"), ("b", "fallback_page"), ("b", "fallback_page"), ("d", "narrative"), ("e", "narrative")]
    assert got[0].text == "Whole\npage" and got[4].text == "&"
    assert L.multi_granularity(records(spark)).count() == 0 and L.region_chunks(records(spark)).count() == 0


def packed_by_loop(blocks, plain, size, overlap):
    """Groups first, then each group is filled and cut."""
    groups, title, sub, fresh = [], "", "", True
    for label, content in blocks:
        content = (content or "").strip()
        if not content or label in L.IGNORED:
            continue
        if label in L.HEADINGS:
            said = " ".join(plain[content].split())
            title, sub = (said, "") if label == L.HEADINGS[0] else (title, said)
            fresh = True
            continue
        rows = L.rows_in(content) or [x for x in [plain[content]] if x] if label == "table" else [x for x in [plain[content]] if x]
        if label == "table" or fresh or groups[-1][0] == "table":
            groups.append(("table" if label == "table" else "narrative", " > ".join(filter(None, (title, sub))), []))
        groups[-1][2].extend(rows)
        fresh = False
    out = []
    for kind, heading, texts in groups:
        glue, head = ("\n" if kind == "table" else "\n\n"), f"Tiêu đề: {heading}\n" if heading else ""
        filled = []
        for x in texts:
            if filled and len(head + filled[-1] + glue + x) <= size:
                filled[-1] += glue + x
            else:
                filled.append(x)
        out += [(kind, w) for x in filled for w in C.cut(head + x, size, overlap)]
    return out


def test_packing_against_loop(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["tài", "sản", "**nợ**", "vốn", "9%", "x_y"]) for _ in range(n))
    made = {}
    for i in range(60):
        blocks = []
        for _ in range(rng.randrange(0, 14)):
            label = rng.choice(["doc_title", "paragraph_title", "text", "text", "text", "table", "table", "header", "chart"])
            rows = "".join(f"<tr><td>{words(rng.randrange(0, 3))}</td><td>{rng.randrange(99)}</td></tr>" for _ in range(rng.randrange(0, 9)))
            blocks.append((label, rng.choice(["", "  ", None]) if rng.random() < 0.1 else f"<table>{rows}</table>" if label == "table" and rng.random() < 0.8 else words(rng.choice([1, 4, 12, 60]))))
        made[f"r{i:02d}"] = blocks
    made["long"] = [("text", words(5000)), ("table", "<table><tr><td>a</td></tr>" + "".join(f"<tr><td>{words(9)}</td></tr>" for _ in range(2000)) + "</table>")]
    contents = sorted({t.strip() for b in made.values() for _, t in b if t and t.strip()})
    said = spark.createDataFrame([(t,) for t in contents], "t string").select("t", T.markdown_to_text(F.col("t")).alias("p"))
    plain = {r.t: r.p for r in said.collect()}
    got = {}
    df = L.layout_chunks(records(spark, *(record(k, b) for k, b in made.items())), size=120, overlap=20)
    for r in df.orderBy("raw_id", "seq").collect():
        got.setdefault(r.raw_id, []).append((r.block_type, r.text))
    want = {k: packed_by_loop(b, plain, 120, 20) for k, b in made.items()}
    assert got == {k: v for k, v in want.items() if v}
