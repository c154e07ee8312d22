"""Language of texts and of spans within them.

The script of a word, by ranges of code points, narrows which languages it may be in. Among these a
word scores by hashed character n-grams, and a Viterbi pass over the words of a text, in which
changing language costs a penalty, labels spans. All texts of a batch take each step together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import doc_fold, table
from docloom.llm.media import in_portions

#: Hash bits of n-grams, and their orders.
BITS, ORDERS = 16, (1, 2, 3, 4)
#: Training documents of each language, in expectation.
PER_LANGUAGE = 1500
#: What a change of language costs, in nats; what a word of a script foreign to a language costs.
SWITCH, FOREIGN = 8.0, 30.0
UNKNOWN = "und"

#: Fixed values of Unicode: the first code point of ranges, and their scripts.
RANGES = (
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"), (0x00AB, "none"),
    (0x00B5, "latin"), (0x00B6, "none"), (0x00BA, "latin"), (0x00BB, "none"), (0x00C0, "latin"), (0x02B0, "none"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2E80, "han"), (0x3000, "none"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "none"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFB50, "arabic"), (0xFE00, "none"), (0xFE70, "arabic"), (0xFF00, "none"),
)
SCRIPTS = tuple(dict.fromkeys(s for _, s in RANGES))

_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@cache
def _lead_scripts() -> np.ndarray:
    """Script by the first two bytes of a letter's UTF-8; by the first alone for ASCII. Four-byte letters count as other."""
    starts = np.array([a for a, _ in RANGES])
    names = np.array([SCRIPTS.index(s) for _, s in RANGES])

    def of(point):
        return names[np.searchsorted(starts, point, "right") - 1]

    out = np.full((256, 256), SCRIPTS.index("none"))
    for a in range(256):
        for b in range(128, 192):
            if 0xC2 <= a <= 0xDF:
                out[a, b] = of((a & 31) << 6 | b & 63)
            elif 0xE0 <= a <= 0xEF:
                out[a, b] = of((a & 15) << 12 | (b & 63) << 6 | 63)
            elif a >= 0xF0:
                out[a, b] = SCRIPTS.index("other")
    for a in range(128):
        out[a, :] = of(a)
    return out


@cache
def _lowered() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


@dataclass
class Words:
    """Words of texts one after another: byte offsets, text of each, hash, script; and the padded bytes."""

    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    script: np.ndarray


def find_words(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Words of the texts, and where each text begins. Lower-cased in place, so offsets are those of the UTF-8 text."""
    bodies = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(b) + 1 for b in bodies])
    starts = np.cumsum(size) - size + 1
    raw = _lowered()[np.frombuffer(b"\n" + b"\n".join([*bodies, b"\n\n\n"]), np.uint8)]
    capital = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    raw[1:][capital] += 32
    inside = _INSIDE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(starts, begin, "right") - 1
    kind = _lead_scripts()[raw[:-1], raw[1:]]
    # the script of a word is that of its first letter beyond ASCII that has one, or else Latin if it has an ASCII letter
    place = np.arange(len(kind))
    beyond = np.where((kind != 0) & (raw[:-1] >= 0xC0), place, len(kind))
    ascii_letter = np.where((kind != 0) & (raw[:-1] < 0x80), place, len(kind))
    script = np.zeros(len(begin), np.int64)
    if len(begin):
        for first in (ascii_letter, beyond):
            at = np.minimum.reduceat(first, begin)
            ok = at < end
            script[ok] = kind[at[ok]]
    return Words(raw, begin, end, row, script), starts


def ngram_windows(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words with a mark at both ends, and how many each word has."""
    count = np.maximum(end - begin + 2 - order + 1, 0) if order > 1 else end - begin
    first = begin - (order > 1)
    word = np.repeat(np.arange(len(begin)), count)
    at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + first[word]
    h = np.full(len(at), order, np.uint32)
    for k in range(order):
        here = at + k
        code = np.where((here < begin[word]) | (here >= end[word]), 0, raw[here]).astype(np.uint32)
        h = (h ^ code) * _PRIMES[k]
        h ^= h >> np.uint32(13)
    return (h * _PRIMES[0]) >> np.uint32(32 - BITS), count


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets by languages, log-likelihood ratios to the mean of the languages
    allowed: np.ndarray  # scripts by languages
    usual: int  # the most frequent language

    def word_scores(self, words: Words) -> np.ndarray:
        """Words by languages. Words of no script say nothing; equal words are scored once."""
        k = len(self.languages)
        out = np.zeros((len(words.begin), k), np.float32)
        some = np.flatnonzero(words.script > 0)
        if not len(some) or not k:
            return out
        begin, end = words.begin[some], words.end[some]
        sums = np.zeros(len(words.raw) + 1, np.uint64)
        base = np.uint64(0x9E3779B97F4A7C15)
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words.raw) - 1, base)]))
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words.raw) - 1, inverse)]))
        np.cumsum((words.raw.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        key = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        begin, end, script = begin[first], end[first], words.script[some][first]
        total = np.zeros((len(first), k), np.float32)
        for order in ORDERS:
            bucket, count = ngram_windows(words.raw, begin, end, order)
            has = np.flatnonzero(count > 0)
            if len(has):
                total[has] += np.add.reduceat(self.scores[bucket], (np.cumsum(count) - count)[has], axis=0)
        allowed = self.allowed[script]
        total = np.where(allowed.any(1, keepdims=True), np.where(allowed, total / len(ORDERS), -FOREIGN), 0)
        out[some] = total[back]
        return out


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row. counts: rows of each sequence; sequences take each step together."""
    out = np.zeros(len(scores), np.int64)
    k = scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    first, length = (np.cumsum(counts) - counts)[order], counts[order]
    steps = int(length.max(initial=0))
    if not steps or not k:
        return out
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # sequences longer than each step
    best_before = np.zeros(len(scores), np.int16)
    switched = np.zeros(scores.shape, bool)
    now = np.zeros((alive[0], k), np.float32)
    ends = np.zeros(len(counts), np.int64)
    for t in range(steps):
        now = now[: alive[t]]
        rows = first[: alive[t]] + t
        if t:
            best = now.argmax(1)
            jump = now[np.arange(len(now)), best][:, None] - np.float32(penalty)
            change = jump > now
            best_before[rows], switched[rows] = best, change
            now = np.where(change, jump, now)
        now = now + scores[rows]
        done = alive[t + 1] if t + 1 < steps else 0
        if done < len(now):
            ends[done : len(now)] = now[done:].argmax(1)
    label = ends.copy()
    for t in range(steps - 1, -1, -1):
        rows, own = first[: alive[t]] + t, label[: alive[t]]
        out[rows] = own
        label[: alive[t]] = np.where(switched[rows, own], best_before[rows], own)
    return out


def train(docs: DataFrame, learn, per_language: int = PER_LANGUAGE) -> Model:
    """n-gram counts of about per_language documents of each language, chosen by a hash of doc_id; counted where they lie."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(learn)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool), 0)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    index = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        import pyarrow as pa

        grams, scripts = np.zeros((len(languages), 1 << BITS), np.int64), np.zeros((len(languages), len(SCRIPTS)), np.int64)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in in_portions([len(t) for t in texts], 1_500_000):
                words, _ = find_words(texts[a:b])
                some = words.script > 0
                begin, end, own = words.begin[some], words.end[some], at[a:b][words.row[some]]
                np.add.at(scripts, (own, words.script[some]), 1)
                for order in ORDERS:
                    bucket, n = ngram_windows(words.raw, begin, end, order)
                    grams += np.bincount(np.repeat(own, n) << BITS | bucket, minlength=grams.size).reshape(grams.shape)
        both = np.concatenate([grams, scripts], 1)
        lang, cell = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(both[lang, cell])], names=["lang", "cell", "n"])

    rows = chosen.select("lang", F.col("text").cast("string").alias("text")).mapInArrow(count, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros((len(languages), (1 << BITS) + len(SCRIPTS)))
    both[rows.column("lang").to_numpy(), rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    grams, scripts = both[:, : 1 << BITS], both[:, 1 << BITS :]
    p = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * (1 << BITS)))
    allowed = scripts >= np.maximum(1, 0.002 * scripts.sum(1, keepdims=True))
    return Model(languages, (p - p.mean(0)).T.astype(np.float32), allowed.T.copy(), languages.index(max(languages, key=lambda x: sizes[x])))


def label_words(model: Model, texts: list[str], penalty: float) -> tuple[list[Words], list[np.ndarray], np.ndarray]:
    """Words and text starts by portion, and the label of every word of all texts. Scores are held for a portion only."""
    found, starts, labels = [], [], [np.zeros(0, np.int64)]
    for a, b in in_portions([len(t) for t in texts], 1_500_000):
        words, at = find_words(texts[a:b])
        found.append(words)
        starts.append(at)
        labels.append(viterbi(model.word_scores(words), np.bincount(words.row, minlength=b - a), penalty))
    return found, starts, np.concatenate(labels)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


SPANS = "array<struct<lang: string, start: int, stop: int>>"


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH, spans: bool = True, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and spans: (language, first and last-plus-one character) of runs of words.

    lang_pred has most letters of words; score is its share of them. Texts that are null or have no
    letter get `und`, 0 and no spans; letters of no known script get the most frequent language of
    training and 0. Without training documents all is `und`. Columns of those names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "spans")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        import pyarrow as pa

        k = len(model.languages)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found, starts, labels = label_words(model, texts, penalty)
            lang, score, runs, at = [], [], [], 0
            for words, start in zip(found, starts):
                own = labels[at : at + len(words.begin)]
                at += len(own)
                n = len(start)
                says = words.script > 0
                letters = np.bincount(words.row * max(k, 1) + own, (words.end - words.begin) * says, n * max(k, 1)).reshape(n, max(k, 1))
                best, total = letters.argmax(1), letters.sum(1)
                for i in range(n):
                    body = texts[len(lang)]
                    if total[i] and k:
                        lang.append(model.languages[best[i]])
                        score.append(float(letters[i, best[i]] / total[i]))
                    else:
                        lang.append(model.languages[model.usual] if k and has_letter(body) else UNKNOWN)
                        score.append(0.0)
                if spans:
                    whole = (np.cumsum((words.raw & 0xC0) != 0x80)) - 1  # characters before each byte
                    keep = np.flatnonzero(says) if k else np.zeros(0, np.int64)
                    row, label = words.row[keep], own[keep]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (label[1:] != label[:-1])])) if len(keep) else keep
                    last = np.concatenate([new[1:], [len(keep)]])[: len(new)] - 1
                    mine = [[] for _ in range(n)]
                    for r, b, e, l in zip(row[new].tolist(), words.begin[keep[new]].tolist(), words.end[keep[last]].tolist(), label[new].tolist()):
                        base = whole[start[r]]
                        mine[r].append({"lang": model.languages[l], "start": int(whole[b] - base), "stop": int(whole[e - 1] + 1 - base)})
                    runs += mine
            more = [pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            names = ["lang_pred", "score"]
            if spans:
                more.append(pa.array(runs, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, f"{kept}, lang_pred string, score double" + (f", spans {SPANS}" if spans else ""))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of documents; those of doc_fold(doc_id, 4) = 2 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, doc_fold(F.col("doc_id"), 4) != 2)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (doc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
