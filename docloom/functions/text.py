"""Text functions as column expressions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token patterns. A number with separators and a percent sign, or letters joined by - and _.
LEXICAL = r"\d+(?:[.,]\d+)*%?|[\p{L}\p{Nl}\p{No}]+(?:[-_][\p{L}\p{Nl}\p{No}]+)*"
WORD = r"[\p{L}\p{N}_]+"
WORD_OR_PERCENT = r"[\p{L}\p{N}_%]+"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*%?"
CITATION = r"\[p\. ?[0-9]+(?:, ?[0-9]+)*\]"


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, use) -> Column:
    """use(value) with value computed once. Spark would compute it anew for each mention; a lambda's argument it does not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lexical_tokens(text: Column, bigrams: bool = False, lower: bool = True) -> Column:
    """Lower-cased tokens, with a::b pairs of neighbours after them if asked. lower: not if the text is in normal_form."""
    tokens = all_matches(F.lower(F.coalesce(text, F.lit(""))) if lower else text, LEXICAL)
    return let(tokens, lambda t: F.concat(t, neighbours(t))) if bigrams else tokens


def neighbours(tokens: Column, joiner: str = "::") -> Column:
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, rest), F.slice(tokens, 2, rest), lambda a, b: F.concat(a, F.lit(joiner), b))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words; a percent sign counts as a letter."""
    return F.array_distinct(all_matches(F.lower(F.coalesce(text, F.lit(""))), WORD_OR_PERCENT))


def set_similarity(a: Column, b: Column) -> Column:
    """The larger of Jaccard and containment of two arrays of distinct values; with an empty one, whether both are."""
    ratio = let(F.size(F.array_intersect(a, b)).cast("double"), lambda n: F.greatest(n / (F.size(a) + F.size(b) - n), n / F.least(F.size(a), F.size(b))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(ratio)


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_words(text: Column) -> Column:
    return F.array_join(all_matches(F.lower(text), WORD), " ")


def numbers(text: Column) -> Column:
    return F.array_distinct(all_matches(F.lower(text), NUMBER))


def is_year(number: Column) -> Column:
    return number.rlike("^[0-9]{4}$") & F.substring(number, 1, 4).between("1900", "2100")


def non_year_numbers(text: Column) -> Column:
    return F.filter(numbers(text), lambda x: ~is_year(x))


def years(text: Column) -> Column:
    """Distinct four-digit runs of digits that begin with 19 or 20."""
    return F.array_distinct(F.filter(all_matches(text, "[0-9]+"), lambda x: x.rlike("^(19|20)[0-9]{2}$")))


def citations(text: Column) -> Column:
    """Pages of citations such as [p. 3, 14], each once, in order."""
    found = F.transform(all_matches(text, CITATION), lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)))
    return F.transform(F.array_distinct(F.flatten(found)), lambda x: x.cast("long"))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(4.0))).cast("long")


def html_to_text(page: Column) -> Column:
    """Comments, scripts and styles go; breaks and block ends become lines; other tags go; blanks and blank lines collapse."""
    for pattern, put in (
        (r"(?s)<!--.*?-->", ""), (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""), (r"(?i)<br ?/?>", "\n"),
        (r"(?i)</(p|div|li|tr|h[1-6])>", "\n"), (r"(?i)</t[dh]>", " ; "), (r"<[^>]+>", ""), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{2,}", "\n"),
    ):
        page = F.regexp_replace(page, pattern, put)
    return F.trim(page)


def first_heading(page: Column) -> Column:
    return squeeze(F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def markdown_heading(text: Column) -> Column:
    """The first heading of level 1 to 4, or an empty string."""
    return F.trim(F.regexp_extract(text, r"(?m)^#{1,4}[ \t]+(.+)$", 1))


def unescaped(text: Column) -> Column:
    """Entities of HTML as the characters that they stand for. Spark has no such function, so texts with an ampersand go to Python."""
    return F.coalesce(_by_batch(F.when(F.contains(text, F.lit("&")), text), html.unescape), text)


def markdown_to_text(text: Column) -> Column:
    """Plain lines: fences, images and links keep their words alone, tags go, cells of HTML and pipe tables are set apart by semicolons.

    Heading marks, bullets, list numbers and emphasis go, as do rules of tables; blank lines never
    follow one another. Entities are resolved once tags are gone.
    """
    for pattern, put in (
        (r"\r\n?", "\n"), (r"```[^\n]*\n?", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?i)<br\s*/?>|</(?:p|div|tr|table|h[1-6])\s*>", "\n"), (r"(?i)</t[dh]\s*>", " ; "), (r"<[^>]+>", " "),
    ):
        text = F.regexp_replace(text, pattern, put)
    lines = F.filter(F.transform(F.split(unescaped(text), "\n"), lambda x: F.trim(x)), lambda x: ~x.rlike(r"^\|?[\s:|-]*-[\s:|-]*\|?$"))

    def plain(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x)), lambda c: c != "")
        line = F.when(F.contains(line, F.lit("|")), F.array_join(cells, " ; ")).otherwise(line)
        for pattern in (r"^#{1,6}\s+", r"^(?:[-+*]|[0-9]+[.)])\s+", r"\*\*|__|~~|`|(?<!\\)[*_]"):
            line = F.regexp_replace(line, pattern, "")
        return F.trim(F.regexp_replace(line, r"[ \t]+", " "))

    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(lines, plain), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def edge_lines(text: Column, n: int = 4, least: int = 4) -> Column:
    """Distinct first and last n lines that are long enough and no number."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    ends = let(lines, lambda x: F.concat(F.slice(x, 1, n), F.slice(x, F.greatest(F.lit(1), F.size(x) - n + 1), n)))
    return F.array_distinct(F.filter(ends, lambda x: (F.length(x) >= least) & ~x.rlike("^[0-9]+$")))


def clean_page(text: Column, drop: Column) -> Column:
    """Blanks collapsed; repeated margin lines and numbers alone near an edge dropped; at most one blank line in a row."""
    text = F.regexp_replace(F.regexp_replace(text, " ", " "), r"[ \t]+", " ")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = let(lines, lambda all_: F.filter(all_, lambda x, i: ~F.array_contains(drop, x) & ~(x.rlike("^[0-9]{1,3}$") & ((i < 5) | (i >= F.size(all_) - 5)))))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def first_case(text: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """The label of the first case whose phrase the lower-cased text holds."""
    low, out = F.lower(text), F.lit(default)
    for phrase, label in reversed(cases):
        out = F.when(F.contains(low, F.lit(phrase)), F.lit(label)).otherwise(out)
    return out


def contains_any(text: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def terms_in(text: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def json_span(text: Column) -> Column:
    """From the first opening brace to the last closing one."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def _by_batch(column: Column, one) -> Column:
    """A Python function of strings over Arrow batches, for what Spark has no function for. Made where used: workers import this module too."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else one(x))

    return F.pandas_udf(run, "string")(column)


def nfkc(text: Column) -> Column:
    return _by_batch(text, lambda x: unicodedata.normalize("NFKC", x))


def nfc(text: Column) -> Column:
    """NFC, with lone surrogates replaced."""
    return _by_batch(text, lambda x: unicodedata.normalize("NFC", x.encode("utf-8", "replace").decode("utf-8", "replace")))


def normal_form(text: Column) -> Column:
    """NFKC and case folding, as lexical search wants them; null counts as empty.

    Spark has no NFKC, so texts beyond ASCII go to Python; those of ASCII alone need none and travel as nulls.
    """
    beyond = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    return F.replace(F.replace(F.lower(F.coalesce(nfkc(beyond), text, F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def folded(x: str) -> str:
    """Lower case without accents or strokes, blanks collapsed."""
    x = unicodedata.normalize("NFKD", x.lower().replace("đ", "d"))
    return " ".join("".join(c for c in x if not unicodedata.combining(c)).split())


def fold(text: Column) -> Column:
    return _by_batch(text, folded)


def redact_new_numbers(query: Column, text: Column) -> Column:
    """Numbers of text that query does not hold become [number]."""
    pattern = re.compile(NUMBER)

    def one(q, t):
        known = set(pattern.findall(q or ""))
        return None if t is None else pattern.sub(lambda m: m[0] if m[0] in known else "[number]", t)

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(q, t)])

    return F.pandas_udf(run, "string")(query, text)
