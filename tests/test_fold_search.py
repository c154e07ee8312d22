"""fold_search against plain unicodedata."""

import hashlib
import re
import unicodedata

from docloom.functions.text import NUMBER
from docloom.plans.control import fold_search

LONG = "Số 37 của năm 2020 và ﬁne Ấm  é " * 30
TEXTS = [(1, LONG, "en"), (2, LONG + " 41 cuối", None), (3, "Größe 12,5 und 2020", "de"), (4, "", "fr"), (5, None, "en")]


def plain(t):
    if t is None:
        return None, None, None, None
    md5 = lambda form: hashlib.md5(unicodedata.normalize(form, t).encode()).hexdigest()
    bare = unicodedata.normalize("NFKD", t.lower().replace("đ", "d"))
    folded = " ".join("".join(c for c in bare if not unicodedata.combining(c)).split())
    return md5("NFKC"), md5("NFC"), folded, re.sub(NUMBER, lambda m: m[0] if m[0] == "2020" else "[number]", "2020 and 37: " + t)


def test_every_whole_text(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.nfkc, r.nfc, r.folded, r.redacted) for r in fold_search(spark, str(tmp_path)).collect()}
    assert got == {i: plain(t) for i, t, _ in TEXTS}
