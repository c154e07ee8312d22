"""What evidence covers: facts, sufficiency, follow-up questions, citations."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators.metrics import search_text


def has_fact(text: Column, groups: list[list[str]], value: str | None = None, folded: Column | None = None) -> Column:
    """Each group has a term in the text, accents and case aside; and a value pattern matches its search form, if there is one.

    Without groups nothing is known of the fact. folded: the folded text, where it is at hand.
    """
    plain, ok = T.fold(text) if folded is None else folded, F.lit(bool(groups))
    for terms in groups:
        ok = ok & reduce(or_, (F.contains(plain, F.lit(T.folded(t))) for t in terms), F.lit(False))
    return ok & F.lower(search_text(text)).rlike(f"(?ius){value}") if value else ok


def facts_of(text: Column, folded: Column, facts: dict[str, dict]) -> Column:
    """Names of the facts that a text has, in their order. facts: by name its `groups` of terms and, if any, a `value` pattern."""
    named = [F.when(has_fact(text, fact.get("groups", []), fact.get("value"), folded), F.lit(name)) for name, fact in facts.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def fact_coverage(candidates: DataFrame, query: str, rank: str, page: str, text: str, facts: dict[str, list[list[str]]]) -> DataFrame:
    """(query, fact, pages in order of rank, covered) of every query and fact."""
    known = candidates.withColumn("_folded", T.fold(F.col(text)))
    held = known.withColumn("_facts", facts_of(F.col(text), F.col("_folded"), {name: {"groups": groups} for name, groups in facts.items()}))
    rows = held.select(query, rank, page, F.explode("_facts").alias("fact"))
    pages = rows.groupBy(query, "fact").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(rank, page))), lambda x: x[page])).alias("pages"))
    wanted = candidates.select(query).distinct().select(query, F.explode(F.array(*map(F.lit, facts))).alias("fact"))
    found = wanted.join(pages, [query, "fact"], "left")
    return found.select(query, "fact", F.coalesce("pages", F.array().cast(dict(pages.dtypes)["pages"])).alias("pages"), F.col("pages").isNotNull().alias("covered"))


def sufficiency(evidence: DataFrame, query: str, asked: str, text: str, score: str, terms: list[str], rank: str = "rank") -> DataFrame:
    """(query, sufficient, confidence, missing): years, terms, numbers and a score of 0.5 that the evidence must have.

    Numbers are asked for with `how many` or `how much`; two of them to compare, or with two years.
    """
    combined = evidence.groupBy(query).agg(F.max(asked).alias("_q"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(text)))), lambda x: x[text]), "\n").alias("_t"), F.max(score).alias("_s"))
    low_q, low_t = F.lower("_q"), F.lower("_t")
    years, wanted, found = T.years(F.col("_q")), T.terms_in(low_q, terms), T.non_year_numbers(F.col("_t"))
    numeric = low_q.rlike("how (many|much)")
    compared = low_q.contains("compare") | (F.size(years) >= 2)
    lost_years, lost_terms = F.filter(years, lambda y: ~F.contains(F.col("_t"), y)), F.filter(wanted, lambda x: ~F.contains(low_t, x))
    lost = F.concat(
        F.transform(lost_years, lambda y: F.concat(F.lit("year:"), y)), F.transform(lost_terms, lambda x: F.concat(F.lit("term:"), x)),
        F.when(numeric & (F.size(found) == 0), F.array(F.lit("numeric_value"))).otherwise(F.array().cast("array<string>")),
        F.when(compared & (F.size(found) < 2), F.array(F.lit("comparison_values"))).otherwise(F.array().cast("array<string>")),
    )
    checks = F.size(years) + F.size(wanted) + numeric.cast("int") + compared.cast("int") + 1
    weak = (F.col("_s") < 0.5).cast("int")
    rows = combined.withColumn("missing", lost).withColumn("_checks", checks)
    failed = F.size("missing") + weak
    return rows.select(query, (failed == 0).alias("sufficient"), F.round((F.col("_checks") - failed) / F.col("_checks"), 6).alias("confidence"), "missing")


def follow_up(missing: Column, metric: Column, years: Column) -> Column:
    """The first that applies: missing years, missing terms, values to compare, a number, or anything."""
    of = lambda prefix: F.transform(F.filter(missing, lambda m: F.startswith(m, F.lit(prefix))), lambda m: F.substring(m, F.lit(6), F.length(m)))
    year_text = F.array_join(years, " ")
    return F.trim(
        F.when(F.size(of("year:")) > 0, F.concat_ws(" ", metric, F.lit("in"), F.array_join(of("year:"), " "), F.lit("exact figures")))
        .when(F.size(of("term:")) > 0, F.concat_ws(" ", F.array_join(of("term:"), " "), year_text, F.lit("report")))
        .when(F.array_contains(missing, "comparison_values"), F.concat_ws(" ", metric, year_text, F.lit("figures of the year before")))
        .when(F.array_contains(missing, "numeric_value"), F.concat_ws(" ", metric, year_text, F.lit("table of figures")))
        .otherwise(F.concat_ws(" ", metric, year_text, F.lit("report")))
    )


def canonical_pages(pages: DataFrame, answers: DataFrame, query: str, page: str, text: str, answer: str, least: float = 0.62, slack: float = 0.05) -> DataFrame:
    """(query, page): of pages with all numbers of the answer and enough of its terms, the first within `slack` of the best."""
    terms = F.filter(T.word_set(F.col(answer)), lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+%?$"))
    rows = pages.join(answers.select(query, terms.alias("_terms"), T.non_year_numbers(F.col(answer)).alias("_numbers")), query)
    share = F.when(F.size("_terms") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("_terms", T.word_set(F.col(text)))) / F.size("_terms"))
    fits = rows.where(F.forall("_numbers", lambda n: F.contains(F.lower(F.col(text)), n))).withColumn("_share", share).where(F.col("_share") >= least)
    best = fits.withColumn("_best", F.max("_share").over(Window.partitionBy(query)))
    return best.where(F.col("_share") >= F.col("_best") - slack).groupBy(query).agg(F.min(page).alias(page))


def numbers_supported(answer: Column, evidence: Column) -> Column:
    """Every number of the answer but years occurs in the evidence, blanks aside."""
    text = F.regexp_replace(F.lower(evidence), r"\s", "")
    return F.forall(T.non_year_numbers(answer), lambda n: F.contains(text, n))
