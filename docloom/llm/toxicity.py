"""Toxicity by a counterfactually regularised classifier.

A sparse logistic regression over the distinct words of a text and their beginnings. Wherever a labelled text names a
group, the term is swapped for the other terms of its list, and the squared change of the score is
penalised; so a term that happens to stand in toxic texts gets no weight of its own, and neutral
mentions are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import doc_fold, returning, table
from docloom.llm.labelled import labelled_sample
from docloom.llm.media import in_portions
from docloom.llm.order_minhash import word_hashes
from docloom.llm.quality import logistic

#: Labelled documents that the model is fitted on at most, and hash bits of words.
MOST_LABELLED, BITS = 8000, 22
#: Beginnings of words that are features, in bytes.
PREFIXES = (4, 6, 7)
#: Features that can get a weight: those whose share of positive texts is furthest from the mean's.
MOST_FEATURES = 5000

#: Neutral names of groups; terms of one list may take each other's place.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "femmes", "hommes", "filles", "frauen", "männer", "mädchen", "mujeres", "hombres", "niñas"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "musulman", "chrétien", "juif", "muslime", "christen", "juden", "musulmán", "cristiano", "judío"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "indigenous", "noir", "blanc", "asiatique", "schwarze", "weiße", "asiatische", "negro", "blanco", "asiático"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender", "homosexuel", "lesbienne", "schwul", "lesbisch", "homosexual", "lesbiana"),
    ("immigrants", "refugees", "foreigners", "citizens", "immigrés", "réfugiés", "étrangers", "einwanderer", "flüchtlinge", "ausländer", "inmigrantes", "refugiados", "extranjeros"),
    ("old", "young", "disabled", "deaf", "blind", "vieux", "jeunes", "handicapés", "alte", "junge", "behinderte", "viejos", "jóvenes", "discapacitados"),
)


def word_ids(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and beginnings of words of all texts, and the text of each."""
    hashes, counts, starts = word_hashes(texts, PREFIXES)
    row = np.repeat(np.arange(len(texts)), counts)
    ids, rows = [hashes], [row]
    for s in starts:
        keep = s != 0
        ids.append(s[keep])
        rows.append(row[keep])
    return (np.concatenate(ids) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


def distinct_ids(texts: list[str], only: np.ndarray | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of the distinct hashed words of each text; only: keep those that this table marks."""
    ids, row = word_ids(texts, bits)
    if only is not None:
        keep = only[ids]
        ids, row = ids[keep], row[keep]
    both = np.unique(row << bits | ids)
    return both >> bits, both & ((1 << bits) - 1)


@dataclass
class Toxicity:
    """Weights of words that have one, and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    intercept: float
    bits: int = BITS

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.words] = self.weights
        return out

    def score(self, texts: list[str], table: np.ndarray | None = None) -> np.ndarray:
        table = self.table() if table is None else table
        row, word = distinct_ids(texts, table != 0, self.bits)
        return logistic(self.intercept + np.bincount(row, table[word], len(texts)))


def swap_pairs(documents: np.ndarray, bits: int = BITS, lists=IDENTITY_TERMS) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(features of a term, features of another of its list, labelled texts that name the term) for every swap."""
    out = []
    for terms in lists:
        own = [distinct_ids([t], None, bits)[1] for t in terms]
        whole = [int(word_hashes([t])[0][0] >> np.uint64(64 - bits)) for t in terms]
        out += [(x, y, float(documents[w])) for x, w in zip(own, whole) for y in own if x is not y and documents[w]]
    return out


def fit_toxicity(row: np.ndarray, word: np.ndarray, y: np.ndarray, counterfactual: float = 1.0, sparse: float = 2e-4, least: int = 2, rounds: int = 250, bits: int = BITS, lists=IDENTITY_TERMS) -> Toxicity:
    """Accelerated proximal gradient for the logistic loss, an L1 penalty and the counterfactual penalty.

    row, word: distinct words of each text. Words of fewer than `least` texts get no weight. With one
    class only, the weights are 0 and the intercept says which.
    """
    n, positive = len(y), float(y.sum())
    intercept = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    if not n or positive in (0.0, float(n)):
        return Toxicity(np.zeros(0, np.int64), np.zeros(0), intercept, bits)
    seen = np.bincount(word, minlength=1 << bits)
    swaps = swap_pairs(seen, bits, lists)
    share = positive / n
    far = np.abs(np.bincount(word, y[row], 1 << bits) - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    far[seen < least] = 0
    for x, y_, _ in swaps:  # what is swapped has to be seen by the penalty
        far[x[seen[x] > 0]] = np.inf
        far[y_[seen[y_] > 0]] = np.inf
    words = np.flatnonzero(far > 0)
    words = np.sort(words[np.argsort(-far[words], kind="stable")[: max(MOST_FEATURES, int(np.isinf(far).sum()))]])
    place = np.full(1 << bits, -1)
    place[words] = np.arange(len(words))
    keep = place[word] >= 0
    row, column = row[keep], place[word[keep]]
    # each swap is a row of a matrix: +1 for features that go, -1 for those that come
    at, feature, sign, c = [], [], [], []
    for k, (x, y_, count) in enumerate(swaps):
        for ids, s in ((x, 1.0), (y_, -1.0)):
            ids = place[ids]
            ids = ids[ids >= 0]
            at.append(np.full(len(ids), k))
            feature.append(ids)
            sign.append(np.full(len(ids), s))
        c.append(count)
    at, feature, sign = (np.concatenate([np.zeros(0, d), *v]).astype(d) for d, v in ((int, at), (int, feature), (float, sign)))
    c = counterfactual * np.array(c, float) / n
    w, last, bias, last_bias, t = np.zeros(len(words)), np.zeros(len(words)), intercept, intercept, 1.0
    norm = np.bincount(row, minlength=n)
    # a bound of the curvature: the largest row sum of the Hessian's absolute values
    bent = 0.25 * np.bincount(column, norm[row] + 1.0, len(words)).max(initial=0) / n
    if len(c):
        bent += 2 * np.bincount(feature, c[at] * np.bincount(at, minlength=len(c))[at], len(words)).max(initial=0)
    step = 1.0 / (bent + 0.25)
    for _ in range(rounds):
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_bias = w + (t - 1) / grown * (w - last), bias + (t - 1) / grown * (bias - last_bias)
        off = (logistic(look_bias + np.bincount(row, look[column], n)) - y) / n
        gradient = np.bincount(column, off[row], len(words))
        if len(c):
            change = 2 * c * np.bincount(at, sign * look[feature], len(c))
            gradient += np.bincount(feature, sign * change[at], len(words))
        last, last_bias, t = w, bias, grown
        w = look - step * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        bias = look_bias - step * off.sum()
    kept = w != 0
    return Toxicity(words[kept], w[kept], float(bias), bits)


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, counterfactual: float = 1.0) -> Toxicity:
    """The model of at most `most` labelled documents; those of doc_fold(doc_id, 5) = 0 are held out."""

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in in_portions([len(t) for t in texts], 600_000):
                row, word = distinct_ids(texts[a:b])
                parts = np.split(word.astype("<i4"), np.searchsorted(row, np.arange(1, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array([p.tobytes() for p in parts], pa.binary())], names=["doc_id", "label", "words"])

    sample = labelled_sample(docs, labels, label, most, doc_fold(F.col("doc_id"), 5) != 0)
    rows = sorted(sample.mapInArrow(returning(words), "doc_id long, label int, words binary").collect())
    found = [np.frombuffer(r.words, "<i4") for r in rows]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in found])
    word = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int64)
    return fit_toxicity(row, word, np.array([float(r.label > 0) for r in rows]), counterfactual)


def score_toxicity(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """docs with toxicity, from 0 to 1. Null text counts as empty; a column of that name is replaced, all others stay."""
    docs = docs.drop("toxicity")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def score(batches):
        import pyarrow as pa

        weights = model.table()
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            scores = np.concatenate([np.zeros(0), *(model.score(texts[a:b], weights) for a, b in in_portions([len(t) for t in texts], 600_000))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "toxicity"])

    return docs.mapInArrow(returning(score), f"{kept}, toxicity double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents scored as labels.toxic marks it. Null and empty texts get the score of no words."""
    docs = table(spark, sf_dir, "documents")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    out = score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (doc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
