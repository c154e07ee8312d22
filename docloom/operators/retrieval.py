"""Retrieval over the inverted index and over vectors; every operator takes all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators.dense import dense_top_k  # noqa: F401
from docloom.operators.lexical import LexicalIndex, append_documents, bm25, build_index, current_index, index_of, merge_segments, open_index, part_of, search_index, term_statistics, top_k  # noqa: F401
from docloom.operators.lexical_scan import Corpus, corpus_statistics, search_corpus, search_lexical  # noqa: F401

def fuse(rankings: dict[str, tuple[DataFrame, float]], query: str, key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: (query, rank, key, fusion_score, one score column for each source).

    rankings: by source its rows (query, key, rank, score) and weight.
    """
    rows = None
    for source, (df, weight) in rankings.items():
        one = df.select(query, key, (F.lit(float(weight)) / (constant + F.col("rank"))).alias("_gain"), F.lit(source).alias("_source"), F.col("score").alias("_score"))
        rows = one if rows is None else rows.unionByName(one)
    scores = [F.max(F.when(F.col("_source") == s, F.col("_score"))).alias(f"{s}_score") for s in rankings]
    fused = rows.groupBy(query, key).agg(F.round(F.sum("_gain"), 9).alias("fusion_score"), F.count(F.lit(1)).alias("n_sources"), *scores)
    return top_k(fused, k, [query], [F.desc("fusion_score"), F.asc(key)])


def share_of_best(score: str, by: list[str]) -> Column:
    return F.col(score) / F.max(score).over(Window.partitionBy(*by))


def min_max(score: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low))


def relevance(score: str, by: list[str]) -> Column:
    """Shares of the best score where all are at least 0, else min-max; 1 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(1.0)).when((low >= 0) & (high > 0), F.col(score) / high).otherwise((F.col(score) - low) / (high - low))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def recall_of(wanted: Column, found: Column, empty: float = 1.0) -> Column:
    """The share of wanted values that are found; `empty` if none is wanted."""
    return T.let(wanted, lambda w: F.when(F.size(w) == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(w, found)) / F.size(w)))


#: Weights of the rerankers, as the compared system publishes them.
CONSTRAINT_WEIGHTS = {"year": 0.28, "acronym": 0.18, "metric": 0.34, "number": 0.10, "granularity": 0.10}
BASE_WEIGHT, CONSTRAINT_WEIGHT = 0.65, 0.35
METRIC_WEIGHTS = {"base": 0.48, "label": 0.22, "exact": 0.10, "qualifiers": 0.14, "years": 0.03, "statement": 0.03, "mismatch": 0.35}


def acronyms(text: Column) -> Column:
    return F.array_distinct(T.all_matches(text, "[A-Z]{2,}"))


def constraint_score(query: Column, text: Column, base: Column, granular: Column, terms: list[str]) -> Column:
    """The base score blended with recalls of the query's years, acronyms, metric terms and numbers."""
    low_q, low_t = F.lower(query), F.lower(text)
    parts = {
        "year": recall_of(T.years(query), T.years(text)),
        "acronym": recall_of(acronyms(query), acronyms(text)),
        "metric": recall_of(T.terms_in(low_q, terms), T.terms_in(low_t, terms)),
        "number": recall_of(T.non_year_numbers(query), T.non_year_numbers(text)),
        "granularity": granular,
    }
    total = sum((F.lit(CONSTRAINT_WEIGHTS[n]) * c for n, c in parts.items()), F.lit(0.0))
    return F.lit(BASE_WEIGHT) * base + F.lit(CONSTRAINT_WEIGHT) * total


def metric_score(base: Column, query_label: Column, label: Column, qualifiers: Column, text_words: Column, years_ok: Column, statement_ok: Column) -> Column:
    """The base score blended with label overlap, exact label, qualifiers, years and statement; minus a penalty if qualifiers fail."""
    w = METRIC_WEIGHTS
    shared = F.size(F.array_intersect(query_label, label)).cast("double")
    union = F.size(F.array_union(query_label, label))
    overlap = F.when(union == 0, F.lit(0.0)).otherwise(shared / union)
    exact = ((F.size(label) > 0) & (F.size(F.array_except(label, query_label)) == 0)).cast("double")
    met = recall_of(qualifiers, text_words)
    fails = (F.size(qualifiers) > 0) & (met < 1.0)
    score = w["base"] * base + w["label"] * overlap + w["exact"] * exact + w["qualifiers"] * met + w["years"] * years_ok.cast("double") + w["statement"] * statement_ok.cast("double")
    return score - F.when(fails, F.lit(w["mismatch"])).otherwise(F.lit(0.0))


def expand_parents(children: DataFrame, parents: DataFrame, parent: str, text: str = "text", parent_text: str = "parent_text", most: int = 1800) -> DataFrame:
    """A child's text followed by the beginning of its parent's, unless it is in there or there is none; retrieval_text keeps the child's own."""
    own, above = F.col(text), F.left(F.col(parent_text), F.lit(most))
    joined = children.join(parents.select(parent, parent_text), parent, "left")
    wide = F.when(F.col(parent_text).isNull() | F.contains(own, above), own).otherwise(F.concat(own, F.lit("\n\n"), above))
    return joined.withColumn("retrieval_text", own).withColumn(text, wide)


def where_or_all(rows: DataFrame, by: list[str], passes: Column) -> DataFrame:
    """Rows that pass; all rows of a group in which none does."""
    any_pass = F.max(F.coalesce(passes, F.lit(False))).over(Window.partitionBy(*by))
    return rows.withColumn("_any", any_pass).where(passes | ~F.col("_any")).drop("_any")
