"""Rule-based routing: features of a question, rules that add to the scores of routes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


@dataclass(frozen=True)
class Rule:
    """Adds to a route's score where all of `all` and one of `any` hold, none of `none`, and counts reach `min_counts`."""

    add: float
    all: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    none: tuple[str, ...] = ()
    min_counts: dict[str, int] = field(default_factory=dict)

    def matches(self) -> Column:
        ok = F.lit(True)
        for name in self.all:
            ok = ok & F.col(name)
        if self.any:
            some = F.lit(False)
            for name in self.any:
                some = some | F.col(name)
            ok = ok & some
        for name in self.none:
            ok = ok & ~F.col(name)
        for name, n in self.min_counts.items():
            ok = ok & (F.col(f"n_{name}") >= n)
        return ok


@dataclass(frozen=True)
class Route:
    base: float
    rules: tuple[Rule, ...]


#: Weights that the compared system publishes; routes in order of priority.
ROUTES = {
    "multi_hop": Route(0.05, (Rule(0.62, ("has_comparison", "has_ratio")), Rule(0.58, ("has_lookup", "is_explanatory")), Rule(0.28, ("has_comparison", "has_year")), Rule(0.95, min_counts={"entity": 2}), Rule(0.35, min_counts={"metric": 2}))),
    "structured": Route(0.08, (Rule(0.18, ("has_number",)), Rule(0.15, ("has_year",)), Rule(0.22, ("has_metric",)), Rule(0.34, ("has_lookup",)), Rule(0.22, min_counts={"entity": 1}), Rule(0.12, ("has_ratio",)), Rule(-0.28, ("is_explanatory",)), Rule(-0.25, ("has_comparison",)))),
    "narrative": Route(0.10, (Rule(0.62, ("is_explanatory",)), Rule(0.04, ("has_metric",)), Rule(-0.18, ("has_lookup",)), Rule(-0.08, ("has_comparison",)))),
    "multi_repr": Route(0.28, (Rule(0.30, ("is_followup",)), Rule(0.08, ("has_metric",)), Rule(0.28, ("has_lookup", "is_explanatory")))),
}
THRESHOLD, FALLBACK = 0.62, "multi_repr"


def features(queries: DataFrame, text: str, lexicon: dict[str, list[str]], followup_tokens: int = 6) -> DataFrame:
    """Flags and counts of terms. lexicon: metric, comparison, ratio, lookup, explanatory, followup and entity terms."""
    low = F.lower(text)
    out = queries.withColumn("has_number", F.col(text).rlike("[0-9]")).withColumn("has_year", F.size(T.years(F.col(text))) > 0)
    for name in ("metric", "entity"):
        out = out.withColumn(f"n_{name}", F.size(T.terms_in(low, lexicon[name])))
    for flag, name in (("has_metric", "metric"), ("has_comparison", "comparison"), ("has_ratio", "ratio"), ("has_lookup", "lookup"), ("is_explanatory", "explanatory")):
        out = out.withColumn(flag, T.contains_any(low, lexicon[name]))
    short = F.size(T.lexical_tokens(F.col(text))) <= followup_tokens
    return out.withColumn("is_followup", short & T.contains_any(low, lexicon["followup"]))


def route(featured: DataFrame, routes: dict[str, Route] = ROUTES, threshold: float = THRESHOLD, fallback: str = FALLBACK) -> DataFrame:
    """route and confidence: the best score, the first route of equal ones; the fallback below the threshold."""
    scored = featured
    for name, r in routes.items():
        total = F.lit(r.base)
        for rule in r.rules:
            total = total + F.when(rule.matches(), F.lit(rule.add)).otherwise(F.lit(0.0))
        scored = scored.withColumn(f"score_{name}", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 6))
    ranked = F.array(*(F.struct(F.col(f"score_{n}").alias("s"), F.lit(-i).alias("p"), F.lit(n).alias("route")) for i, n in enumerate(routes)))
    best = scored.withColumn("_best", F.array_max(ranked))
    sure = F.col("_best.s") >= threshold
    return best.withColumn("route", F.when(sure, F.col("_best.route")).otherwise(F.lit(fallback))).withColumn("confidence", F.col("_best.s")).drop("_best")


ROUTE_PLAN = "struct<route: string, confidence: double, reasons: array<string>>"


def validated_plan(raw: Column, allowed: tuple[str, ...], least: float = 0.5, fallback: str = FALLBACK) -> Column:
    """A router model's answer as struct<route, confidence, source>; anything malformed, unknown or unsure falls back."""
    plan = F.from_json(T.json_span(raw), ROUTE_PLAN)
    ok = plan["route"].isin(*allowed) & plan["confidence"].between(0, 1) & (plan["confidence"] >= least)
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, plan["route"]).otherwise(F.lit(fallback)).alias("route"), F.when(ok, plan["confidence"]).alias("confidence"), F.when(ok, F.lit("model")).otherwise(F.lit("fallback")).alias("source"))


def router_decision(raw: Column, allowed: tuple[str, ...], flags: tuple[str, ...] = (), least: float = 0.5, fallback: str = FALLBACK) -> Column:
    """A router model's reply under its whole contract: struct<route, confidence, reasons, source, raw_route, why>.

    The reply is one JSON object, alone or within other words: a known route, a number from 0 to 1, reasons
    as a list of texts that say something (a single text is taken as a list of one), and, if it names
    query_features, exactly `flags` as booleans. source: `model`, `model_normalized` (reasons were a single text),
    `low_confidence_fallback` (keeps its confidence and reasons, with what happened as the last one) or
    `error_fallback`; why says what was wrong. Objects with repeated keys are no JSON here.
    """
    part = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    kind = lambda v, name: F.coalesce(F.schema_of_variant(part(v, name)), F.lit("none"))
    clean = lambda xs: F.transform(xs, lambda x: F.trim(x))

    def judged(v: Column) -> Column:
        route, confidence = F.try_variant_get(v, "$.route", "string"), F.try_variant_get(v, "$.confidence", "double")
        single = kind(v, "reasons") == "STRING"
        reasons = F.when(single, F.array(F.try_variant_get(v, "$.reasons", "string"))).when(kind(v, "reasons") == "ARRAY<STRING>", F.try_variant_get(v, "$.reasons", "array<string>"))
        told = clean(reasons)
        names = f"OBJECT<{', '.join(f'{x}: BOOLEAN' for x in sorted(flags))}>"
        numeric = kind(v, "confidence").rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        error = (
            F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "no JSON object")
            .when((kind(v, "route") != "STRING") | ~F.coalesce(route.isin(*allowed), F.lit(False)), "unknown route")
            .when(~numeric, "confidence is no number").when(~confidence.between(0, 1), "confidence is not from 0 to 1")
            .when(told.isNull() | (F.size(told) == 0) | F.exists(told, lambda x: x == ""), "no reasons")
            .when(~kind(v, "query_features").isin("none", names), "other features")
        )
        unsure = confidence < least
        low = F.concat(F.lit("confidence "), F.format_number(confidence, 3), F.lit(f" below {least:.3f}; instead of "), route)
        why = F.coalesce(error, F.when(unsure, low))
        source = F.when(error.isNotNull(), "error_fallback").when(unsure, "low_confidence_fallback").when(single, "model_normalized").otherwise("model")
        kept = F.slice(told, 1, 4)
        said = F.when(error.isNotNull(), F.array(error)).when(unsure, F.concat(kept, F.array(low))).otherwise(kept)
        return F.struct(
            F.when(why.isNotNull(), F.lit(fallback)).otherwise(route).alias("route"), F.when(error.isNotNull(), F.lit(0.0)).otherwise(F.round(confidence, 6)).alias("confidence"),
            said.alias("reasons"), source.alias("source"), F.when(error.isNull(), route).alias("raw_route"), why.alias("why"),
        )

    return judged(F.try_parse_json(T.json_span(raw)))
