"""Quality grades by ordinal cumulative-link regression.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut the line
it projects to: P(grade > k) = logistic(w . x - threshold_k). That gives an expected grade and the
probability of reaching a wanted grade, by which documents are selected. Features are frequencies of
hashed byte trigrams and of hashed marks of structure: repeated lines, repeated words, capitals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import doc_fold, returning, table
from docloom.llm.labelled import labelled_sample
from docloom.llm.media import in_portions

#: Hash buckets of trigrams, and of marks of structure.
TRIGRAMS, MARKS = 2048, 16
#: Marks are frequencies up to 1; at this scale the ridge penalty does not hold them back.
MARK_SCALE = 5.0
#: Labelled documents that the model is fitted on at most.
MOST_LABELLED = 3000
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def trigram_buckets(raw: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two."""
    x = raw.astype(np.uint32)
    h = x[:-2] * _A + x[1:-1] * _B + x[2:] * _C
    h ^= h >> np.uint32(15)
    return (h * _A) >> np.uint32(32 - 11)


def marks(text: str) -> np.ndarray:
    """Scaled frequencies of marks of structure."""
    out = np.zeros(MARKS)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    if not words:
        out[0] = MARK_SCALE
        return out
    n = len(words)
    distinct = len(set(words))
    out[1] = 1 - len(set(lines)) / len(lines)
    out[2] = sum(map(str.__eq__, words, words[1:])) / n
    out[3] = 1 - distinct / n
    out[4] = n > 40 and distinct / n < 0.2
    letters = len(text) - text.count(" ") - text.count("\n")
    lower = text.lower()
    out[5] = sum(map(str.__ne__, words, lower.split())) / n
    out[6] = text == text.upper() and lower != text
    out[7] = sum(map(text.count, "|#*$%&!~^_=+<>{}[]\\")) / max(1, letters)
    out[8] = sum(map(text.count, "0123456789")) / max(1, letters)
    out[9] = min(1.0, letters / n / 40)
    out[10] = n < 5
    out[11] = n < 20
    out[12] = len(lines) / n
    out[13] = max(map(len, words)) > 60
    return MARK_SCALE * out


def features(texts: list[str]) -> np.ndarray:
    """Dense rows of scaled frequencies; for the bounded sample only."""
    out = np.zeros((len(texts), TRIGRAMS + MARKS), np.float32)
    for i, t in enumerate(texts):
        raw = np.frombuffer(f"  {t}  ".encode("utf-8", "surrogatepass"), np.uint8)
        h = trigram_buckets(raw)
        out[i, :TRIGRAMS] = np.sqrt(TRIGRAMS) * np.bincount(h, minlength=TRIGRAMS) / len(h)
        out[i, TRIGRAMS:] = marks(t)
    return out


def project(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """w . x of each text, without making x."""
    if not texts:
        return np.zeros(0)
    bodies = [f"  {t}  ".encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    size = np.array([len(b) for b in bodies])
    value = weights[:TRIGRAMS][trigram_buckets(raw)]
    starts = np.cumsum(size) - size
    inside = np.ones(len(value), bool)
    inside[(starts[1:] - 1)] = inside[(starts[1:] - 2)] = False  # trigrams across two texts
    sums = np.add.reduceat(np.where(inside, value, 0.0), starts)
    return np.sqrt(TRIGRAMS) * sums / (size - 2) + np.array([marks(t) for t in texts]).reshape(-1, MARKS) @ weights[TRIGRAMS:]


def logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class CumulativeLink:
    """grades in order; thresholds between neighbours."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def above(self, line: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each row and threshold."""
        return logistic(line[:, None] - self.thresholds[None, :])

    def expected(self, line: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.above(line) @ np.diff(self.grades)

    def tail(self, line: np.ndarray, grade: int) -> np.ndarray:
        """P(grade or better)."""
        below = sum(g < grade for g in self.grades)
        if below == 0:
            return np.ones(len(line))
        return self.above(line)[:, below - 1] if below < len(self.grades) else np.zeros(len(line))

    def likeliest(self, line: np.ndarray) -> np.ndarray:
        p = -np.diff(np.pad(self.above(line), ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0))), axis=1)
        return np.array(self.grades)[p.argmax(1)]


def fit_cumulative_link(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 400, rate: float = 0.05) -> CumulativeLink:
    """Maximum likelihood with a ridge penalty, by Adam; gaps between thresholds are exponentials, so they stay ordered.

    Without rows, or with one grade only, all weights are 0.
    """
    grades = sorted(set(y.tolist()))
    n, d = x.shape
    if len(grades) < 2:
        return CumulativeLink(np.zeros(d), np.zeros(0), grades or [0])
    at = np.searchsorted(grades, y)
    share = np.cumsum(np.bincount(at))[:-1] / n
    cuts = np.log(share / (1 - share))
    free = np.concatenate([np.zeros(d), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    first, second = np.zeros_like(free), np.zeros_like(free)
    k = len(cuts)
    for step in range(1, rounds + 1):
        w, gaps = free[:d], np.exp(free[d + 1 :])
        thresholds = free[d] + np.concatenate([[0], np.cumsum(gaps)])
        line = x @ w
        s = logistic(thresholds[None, :] - line[:, None])  # P(grade <= k)
        low = np.concatenate([np.zeros((n, 1)), s], 1)[np.arange(n), at]
        high = np.concatenate([s, np.ones((n, 1))], 1)[np.arange(n), at]
        p = np.maximum(high - low, 1e-12)
        slope_low, slope_high = low * (1 - low), high * (1 - high)
        by_line = (slope_high - slope_low) / p / n  # of the negative log likelihood
        by_cut = np.zeros(k)
        np.add.at(by_cut, at[at < k], -(slope_high / p)[at < k] / n)
        np.add.at(by_cut, at[at > 0] - 1, (slope_low / p)[at > 0] / n)
        later = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([x.T @ by_line + penalty * w, later[:1], later[1:] * gaps])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        free = free - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    thresholds = free[d] + np.concatenate([[0], np.cumsum(np.exp(free[d + 1 :]))])
    return CumulativeLink(free[:d], thresholds, grades)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> CumulativeLink:
    """The model of at most `most` labelled documents; those of doc_fold(doc_id, 5) = 0 are held out."""

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            x = features([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    sample = labelled_sample(docs, labels, label, most, doc_fold(F.col("doc_id"), 5) != 0)
    rows = sorted(sample.mapInArrow(returning(vectors), "doc_id long, label int, x binary").collect())
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(len(rows), TRIGRAMS + MARKS)
    return fit_cumulative_link(x.astype(np.float64), np.array([r.label for r in rows], np.int64))


def grade_documents(docs: DataFrame, model: CumulativeLink, wanted: int, least: float = 0.5, text: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability (of `wanted` or better), predicted_grade and selected.

    Null text counts as empty. Columns of those names are replaced, all others stay.
    """
    docs = docs.drop("expected_grade", "tail_probability", "predicted_grade", "selected")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            line = np.concatenate([np.zeros(0), *(project(texts[a:b], model.weights) for a, b in in_portions([len(t) for t in texts], 600_000))])
            tail = model.tail(line, wanted)
            more = [pa.array(model.expected(line)), pa.array(tail), pa.array(model.likeliest(line).astype(np.int32)), pa.array(tail >= least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "expected_grade", "tail_probability", "predicted_grade", "selected"])

    return docs.mapInArrow(returning(score), f"{kept}, expected_grade double, tail_probability double, predicted_grade int, selected boolean")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents graded as labels.quality grades them; selected if grade 1 or better is likelier than not.

    held_out: the document's label is not learned from.
    """
    docs = table(spark, sf_dir, "documents")
    model = train_quality(docs, table(spark, sf_dir, "labels"))
    out = grade_documents(docs.select("doc_id", "text"), model, wanted=1)
    return out.select("doc_id", (doc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "expected_grade", "tail_probability", "predicted_grade", "selected")


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
