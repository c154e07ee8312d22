"""One tool call for each question: what a planner asks for is checked, dispatched to one of three sub-plans, and joined again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.storage import materialize

#: search(queries(query, text), k) -> (query, key, page, score, text), key a string and page an int.
Search = Callable[[DataFrame, int], DataFrame]
#: planner(query, text, preview) -> (query, reply): a model's reply as JSON, whole or within other words.
Planner = Callable[[DataFrame], DataFrame]

TOOLS = ("hybrid_retrieve", "calculator", "finish")
OPERATIONS = ("subtract", "percentage_change", "cagr")
_OPERAND = "struct<value: string, page: int>"
_ARGUMENTS = f"query: string, operation: string, left: {_OPERAND}, right: {_OPERAND}, unit: string, years: double"
_CALL = f"struct<tool: string, {_ARGUMENTS}, hybrid_retrieve: struct<{_ARGUMENTS}>, calculator: struct<{_ARGUMENTS}>, finish: map<string, string>>"


@dataclass(frozen=True)
class AgentSettings:
    """triggers: what a question holds that asks the planner at all; preview_rows and preview_characters of evidence are shown to it."""

    triggers: tuple[str, ...]
    first: int = 20
    follow: int = 8
    k: int = 10
    preview_rows: int = 6
    preview_characters: int = 900


def tool_calls(replies: DataFrame) -> DataFrame:
    """(query, tool, source, arguments) of replies (query, reply). Both {"tool": name, ...} and {name: {...}} are calls; anything else is `finish`."""
    span = T.json_span(F.col("reply"))
    rows = replies.withColumn("_keys", F.json_object_keys(span)).withColumn("_call", F.from_json(span, _CALL))
    valid = F.col("_keys").isNotNull() & (F.size("_keys") > 0) & F.col("_call").isNotNull()
    only = F.get("_keys", F.lit(0))
    nested = valid & (F.size("_keys") == 1) & only.isin(*TOOLS)
    named = valid & F.trim(F.coalesce("_call.tool", F.lit(""))).isin(*TOOLS)
    tool = F.when(nested, only).when(named, F.trim("_call.tool")).otherwise(F.lit("finish"))
    source = F.when(~valid, "planner_invalid_json").when(nested, "planner_nested_tool_json").when(named, "planner").otherwise("planner_invalid_tool")
    fields = ("query", "operation", "left", "right", "unit", "years")
    own = F.struct(*(F.col(f"_call.{f}").alias(f) for f in fields))
    arguments = F.when(nested & (only == "hybrid_retrieve"), F.col("_call.hybrid_retrieve")).when(nested & (only == "calculator"), F.col("_call.calculator")).otherwise(own)
    return rows.select("query", tool.alias("tool"), F.coalesce(source, F.lit("planner_invalid_json")).alias("source"), arguments.alias("arguments"))


def operand_number(value: Column) -> Column:
    """A figure as decimal(38,6): dots or commas group where three digits follow each; a comma is the decimal mark elsewhere."""
    raw = F.regexp_replace(F.regexp_replace(value, r"[\s₫]", ""), "[%x]+$", "")
    no_dots = F.replace(raw, F.lit("."), F.lit(""))
    plain = (
        F.when(raw.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$"), no_dots).when(raw.rlike(r"^[0-9]{1,3}(?:,[0-9]{3})+$"), F.replace(raw, F.lit(","), F.lit("")))
        .when(F.contains(raw, F.lit(",")), F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(raw)
    )
    return plain.try_cast("decimal(38,6)")


def calculations(calls: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, error, key, page, text, source_keys) of calculator calls: a derived row, or why there is none.

    Both operands must stand, as they are written, in a row of the page that the call names.
    """
    squeezed = lambda c: F.regexp_replace(c, r"[\s₫]", "")
    asked = calls.select("query", *(F.col(f"arguments.{f}").alias(f) for f in ("operation", "left", "right", "unit", "years")))
    held = rows.select("query", F.col("key").alias("_key"), F.col("page").alias("_page"), F.col("rank").alias("_rank"), squeezed(F.col("text")).alias("_text"))
    both = asked.join(held, "query", "left")
    found = lambda side: F.min_by(F.col("_key"), F.when((F.col("_page") == F.col(f"{side}.page")) & F.contains("_text", squeezed(F.col(f"{side}.value"))), F.col("_rank")))
    placed = both.groupBy("query").agg(*(F.first(c).alias(c) for c in ("operation", "left", "right", "unit", "years")), found("left").alias("lk"), found("right").alias("rk"))
    a, b, years = operand_number(F.col("left.value")), operand_number(F.col("right.value")), F.col("years")
    is_ = lambda name: F.col("operation") == name
    whole = reduce(lambda x, y: x & y, (F.col(f"{s}.{f}").isNotNull() for s in ("left", "right") for f in ("value", "page")))
    error = (
        F.when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), "operation_not_allowed").when(F.col("left").isNull() | F.col("right").isNull(), "invalid_operands").when(~whole, "invalid_operand_fields")
        .when(F.col("lk").isNull() | F.col("rk").isNull(), "operands_not_verbatim_in_evidence").when(a.isNull() | b.isNull(), "invalid_number").when(is_("percentage_change") & (b == 0), "division_by_zero")
        .when(is_("cagr") & ~F.coalesce((years > 0) & (b > 0), F.lit(False)), "invalid_cagr_inputs")
    )
    x, y = a.cast("double"), b.cast("double")
    result = F.when(is_("subtract"), (a - b).cast("double")).when(is_("percentage_change"), F.try_divide((x - y) * 100, y)).otherwise((F.pow(F.try_divide(x, y), F.try_divide(F.lit(1.0), years)) - 1) * 100)
    shown = F.regexp_replace(F.regexp_replace(N.format_decimal(result), "0+$", ""), ",$", "")
    forms = {"subtract": ("%s − %s", ("left.value", "right.value")), "percentage_change": ("(%s − %s) / %s × 100", ("left.value", "right.value", "right.value"))}
    formula = F.format_string("(%s / %s)^(1/%s) − 1", F.col("left.value"), F.col("right.value"), years.cast("string"))
    for name, (form, columns) in forms.items():
        formula = F.when(is_(name), F.format_string(form, *map(F.col, columns))).otherwise(formula)
    unit = F.when(is_("subtract"), F.when(F.trim(F.coalesce("unit", F.lit(""))) != "", F.concat(F.lit(" "), F.trim("unit"))).otherwise(F.lit(""))).otherwise(F.lit("%"))
    digest = F.left(F.sha2(F.concat_ws("|", "operation", "left.value", "right.value", F.least("left.page", "right.page").cast("string"), F.greatest("left.page", "right.page").cast("string")), 256), F.lit(12))
    out = placed.withColumn("error", error)
    ok = F.col("error").isNull()
    return out.select(
        "query", "error", F.when(ok, F.concat(F.lit("calculation_"), digest)).alias("key"), F.when(ok, F.col("left.page")).alias("page"), F.when(ok, F.concat(formula, F.lit(" = "), shown, unit)).alias("text"), F.when(ok, F.array("lk", "rk")).alias("source_keys"),
    )


def tool_search(questions: DataFrame, search: Search, planner: Planner, settings: AgentSettings) -> tuple[DataFrame, DataFrame]:
    """(evidence, trace) of questions (query, text).

    Questions without a trigger keep what they found. The others' planner sees the best rows and names one
    tool: another question, whose rows are merged by score; a calculation, whose result comes first with
    the keys of its operands; or nothing. Calls that fail their checks leave the evidence as it was, and
    outcome says so. evidence: (query, position, key, page, score, text, source_keys).
    """
    s = settings
    questions = materialize(questions.select("query", "text"), "questions")
    found = search(questions, s.first)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    first = materialize(found.select("query", "key", "page", "score", "text").withColumn("rank", F.row_number().over(order)), "first")
    asks = reduce(or_, (F.contains(F.lower("text"), F.lit(t)) for t in s.triggers), F.lit(False))
    triggered = questions.where(asks)
    shown = first.where(F.col("rank") <= s.preview_rows).withColumn("_line", F.format_string("E%d | page=%s | id=%s\n%s", "rank", F.col("page").cast("string"), "key", F.left("text", F.lit(s.preview_characters))))
    preview = shown.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_line"))), lambda x: x["_line"]), "\n\n").alias("preview"))
    replies = planner(triggered.join(preview, "query", "left").withColumn("preview", F.coalesce("preview", F.lit(""))))
    calls = materialize(triggered.join(tool_calls(replies), "query", "left").withColumn("tool", F.coalesce("tool", F.lit("finish"))).withColumn("source", F.coalesce("source", F.lit("planner_invalid_json"))), "calls")
    follow = F.trim(F.coalesce("arguments.query", F.lit("")))
    wanted = calls.where("tool = 'hybrid_retrieve'").withColumn("_follow", follow).withColumn("_new", (F.col("_follow") != "") & (F.lower("_follow") != F.lower("text")))
    again = materialize(wanted.where("_new").select("query", F.col("_follow").alias("text")), "again")
    second = materialize(search(again, s.follow).select("query", "key", "page", "score", "text"), "second")
    sums = materialize(calculations(calls.where("tool = 'calculator'"), first), "calculations")
    no_source = F.lit(None).cast("array<string>")
    old = first.select("query", "key", "page", "score", "text", no_source.alias("source_keys"), F.col("rank").alias("_o"))
    both = first.select(*second.columns).join(again.select("query"), "query", "left_semi").unionByName(second)
    merged = both.groupBy("query", "key").agg(F.max_by(F.struct("page", "score", "text"), "score").alias("_r")).select("query", "key", "_r.*")
    merged = merged.withColumn("source_keys", no_source).withColumn("_o", F.row_number().over(order))
    derived = sums.where("error is null").select("query", "key", "page", F.lit(1.0).alias("score"), "text", "source_keys", F.lit(0).alias("_o"))
    rows = old.join(again.select("query"), "query", "left_anti").unionByName(merged).unionByName(derived)
    evidence = rows.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("_o"))).where(F.col("position") <= s.k).drop("_o")
    outcome = F.when(F.col("tool").isNull(), F.lit(None).cast("string")).when(F.col("tool") == "hybrid_retrieve", F.when(F.col("_new"), "ok").otherwise("rejected_invalid_followup")).when(F.col("error").isNotNull(), F.concat(F.lit("rejected:"), "error")).otherwise("ok")
    trace = questions.join(calls.select("query", "tool", "source"), "query", "left").join(wanted.select("query", "_new"), "query", "left").join(sums.select("query", "error"), "query", "left")
    counts = evidence.groupBy("query").agg(F.count(F.lit(1)).alias("evidence"))
    trace = trace.join(counts, "query", "left").select("query", F.coalesce("source", F.lit("not_triggered")).alias("source"), "tool", outcome.alias("outcome"), F.coalesce("evidence", F.lit(0)).alias("evidence"))
    return evidence.select("query", "position", "key", "page", "score", "text", "source_keys"), trace
