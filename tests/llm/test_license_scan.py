import random
import re

import numpy as np
import pytest
from docloom.llm.license_scan import CAPITALS, OTHER_TEXTS, OTHERS, PARAGRAPH, TEMPERATURES, TEXTS, TOKEN, UNKNOWN, damaged, examples, grams, notices, op7_license_scan, scan_paragraphs, templates, train, windows

SF = "/root/testdata/sf0.01"
SEEN = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}
NEW = [
    ("The library is available under the MIT licence", "MIT"), ("Code in this folder: Apache License 2.0", "Apache-2.0"), ("These photos are licensed under CC BY-SA 4.0", "CC-BY-SA"),
    ("licensed under gplv3", "GPL-3.0"), ("The dataset is published under CC BY 4.0", "CC-BY"), ("This library is licensed under the GNU Lesser General Public License", "LGPL-3.0"),
    ("Anyone with a fishing licence may apply", UNKNOWN), ("The licence of the pub was lost", UNKNOWN), ("He was released under bail", UNKNOWN),
]
#: Licences that training has no name of.
FOREIGN = ("licensed under the Eclipse Public License 2.0", "Boost Software License, Version 1.0", "Artistic License 2.0", "the zlib License", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "Released under the NASA Open Source Agreement 1.3")


def plain(text):
    m = train()
    p = m.probabilities(text)
    family = m.classes[int(p.argmax())] if p.max() >= 0.5 else UNKNOWN
    held = set(grams(text))
    close = [sum(x for g, x in zip(gs, weights) if g in held) for f, _, gs, weights in templates() if f == family]
    return family, p.max(), max(close, default=None)


def speaks(text):
    lower, capitals = train().anchors()
    return not set(lower).isdisjoint(re.split("[^a-z]+", text.lower())) or re.search(rf"(?<![A-Za-z])({'|'.join(capitals)})(?![A-Za-z])", text) is not None


def paragraphs(text):
    return re.split(PARAGRAPH, text)


def wrapped(text, width=72):
    lines, now = [], ""
    for w in text.split():
        if now and len(now) + len(w) >= width:
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    return "\n".join([*lines, now])


def test_model():
    assert np.mean([plain(t)[0] == c for c, t in notices()] + [plain(t)[0] == UNKNOWN for t in OTHERS]) > 0.97
    assert [plain(t)[0] for t in SEEN] == list(SEEN.values())
    assert [(t, plain(t)[0]) for t, _ in NEW] == NEW


def test_foreign_licences_are_unknown():
    assert [plain(t)[0] for t in FOREIGN] == [UNKNOWN] * len(FOREIGN)


def test_calibration():
    m, (_, rows) = train(), examples()
    assert TEMPERATURES[1] < m.temperature < TEMPERATURES[-2]
    p = np.array([m.probabilities(t) for _, t in rows])
    right, sure = np.array([m.classes[k] == c for k, (c, _) in zip(p.argmax(1), rows)]), p.max(1)
    error = sum((at := (sure > k / 10) & (sure <= (k + 1) / 10)).mean() * abs(right[at].mean() - sure[at].mean()) for k in range(10) if ((sure > k / 10) & (sure <= (k + 1) / 10)).any())
    assert error < 0.05
    unknown = np.array([c == UNKNOWN for c, _ in rows])
    assert right[unknown].mean() > 0.97 and right[~unknown].mean() > 0.7  # a tenth to a quarter of their words is gone


def test_anchors_lose_nothing():
    """What holds no anchor is unknown, whatever its words."""
    m, rng = train(), random.Random(1)
    rows, calibration = examples()
    words = sorted({w for _, t in rows for w in t.split()})
    texts = [t for _, t in [*rows, *calibration, *damaged(rows, rng, 0.5)]] + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(2000)]
    silent = [t for t in texts if not speaks(t)]
    assert len(silent) > 100 and all(m.classes[int(m.logits(t).argmax())] == UNKNOWN for t in silent)


@pytest.mark.parametrize("family", ["MIT", "Apache-2.0", "BSD", "ISC", "Unlicense"])
def test_wrapped_texts(spark, family):
    rng = random.Random(3)
    body = "Some prose before it, of no importance.\n\n" + "\n\n".join(wrapped(t) for t in TEXTS[family]) + "\n\nAnd some after it."
    cut = [wrapped(t) for _, t in windows([(family, t) for t in TEXTS[family] if len(t) > 150], rng, 1)]
    df = spark.createDataFrame(list(enumerate([body, *cut])), "doc_id long, text string")
    got = [r for r in scan_paragraphs(df).collect() if r.doc_id == 0]
    # a full stop at the end of a line may part a paragraph; its parts are of the same family
    assert sum(r.family == family for r in got) >= len(TEXTS[family]) and {r.family for r in got} <= {family, UNKNOWN}
    assert sum(r.confirmed for r in got) >= 1


def test_equals_plain_python(spark):
    texts = [*SEEN, *(t for t, _ in NEW), *OTHERS, *OTHER_TEXTS, *FOREIGN, None, "", "nothing", "one\nLicensed under CC BY-NC 4.0.\n\nReleased under the MIT License.", "x " * 50_000 + "\n\nLicensed under CC0", "THE SOFTWARE IS PROVIDED", "a. b.\nc\n \n\nthe MIT\nLicense\n\n"]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)] + [(3, texts[3], "g")], "doc_id long, text string, family string")
    got = scan_paragraphs(df).collect()
    want = [(i, p, *plain(unit)) for i, t in [*enumerate(texts), (3, texts[3])] for p, unit in enumerate(paragraphs(t or "")) if speaks(unit)]
    key = lambda r: (r[0], r[1])
    for r, w in zip(sorted(((r.doc_id, r.paragraph, r.family, r.probability, r.template_similarity, r.confirmed) for r in got), key=key), sorted(want, key=key), strict=True):
        assert r[:3] == w[:3] and abs(r[3] - w[3]) < 1e-9 and (r[4] is None) == (w[4] is None)
        assert r[4] is None and not r[5] or abs(r[4] - w[4]) < 1e-8 and r[5] == (r[4] >= 0.6)
    assert scan_paragraphs(df.where("false")).count() == 0


def test_query(spark):
    got = {}
    for r in op7_license_scan(spark, SF).collect():
        if r.family != UNKNOWN:
            got.setdefault(r.doc_id, []).append((r.family, r.confirmed))
    planted = 0
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want = [(SEEN[line], True) for unit in paragraphs(d.text) for line in SEEN if line in unit]
        planted += len(want)
        assert got.get(d.doc_id, []) == want
    assert planted > 10


def test_capitals_keep_their_case():
    assert grams("MIT mit The GPL") == ["MIT", "mit", "the", "GPL", "MIT mit", "mit the", "the GPL"]
    assert re.match(CAPITALS, "MIT") and not re.match(CAPITALS, "mit") and re.findall(TOKEN, "GPLv3 2.1") == ["GPLv", "3", "2.1"]
