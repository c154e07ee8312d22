"""Notices that consist of names, or are written in German."""

from docloom.llm.license_scan import scan_paragraphs

LINES = {
    "GPLv3 or later": "GPL-3.0", "BSD-3-Clause": "BSD", "Dual MIT/Apache-2.0": "Apache-2.0", "Lizenziert unter CC BY 4.0": "CC-BY", "CC0": "CC0", "MPL 2.0": "MPL-2.0",
    "Licenza Apache 2.0": "Apache-2.0", "Die Lizenz wurde mit Zustimmung erteilt": "unknown", "Er kommt mit uns": None, "The patched roof": None,
}


def test_names_and_german(spark):
    df = spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string")
    got = {r.doc_id: r.family for r in scan_paragraphs(df).collect()}
    assert [got.get(i) for i in range(len(LINES))] == list(LINES.values())
