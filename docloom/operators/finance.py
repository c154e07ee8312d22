"""Financial questions as tables: a plan of facts for each, one more round for facts that are missing, and figures derived from operands."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import coverage as COV
from docloom.operators import metrics as M
from docloom.operators import selection as S
from docloom.storage import materialize

#: search(queries(query, text), k) -> (query, rank, key, page, score, text, heading, entity); query is a string.
Search = Callable[[DataFrame, int], DataFrame]

#: Operations on operands in their order. All but the last give a number.
OPERATIONS = ("difference", "point_difference", "multiply", "reverse_growth", "synthesis")
EXPRESSION = {"difference": "{} − {}", "point_difference": "{} − {}", "multiply": "{} × {}", "reverse_growth": "{} / (1 + {} / 100)"}


@dataclass(frozen=True)
class Intent:
    """A kind of question, by patterns of which a folded question holds one: the facts that it needs, and what is computed from operands.

    operands: (role, pattern) each, whose group 1 is a figure of the search form of a text.
    """

    name: str
    kind: str
    patterns: tuple[str, ...]
    facts: tuple[str, ...] = ()
    operation: str | None = None
    operands: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class FinanceConfig:
    """facts: by name groups of terms, a value pattern, and the question (query) that looks for it. entities: aliases, in order."""

    intents: tuple[Intent, ...]
    facts: dict[str, dict]
    entities: tuple[tuple[str, str], ...] = ()
    default_entity: str = "group"
    explanatory: tuple[str, ...] = ("vi sao", "nhu the nao", "chien luoc", "mo ta", "y nghia")
    first: int = 20
    follow: int = 8
    most_follow: int = 4
    simple: int = 4
    complex: int = 8
    fact_weight: float = 0.32
    heading_weight: float = 0.18
    mismatch: float = 1.25

    def __post_init__(self):
        for i in self.intents:
            if unknown := set(i.facts) - set(self.facts):
                raise ValueError(f"{i.name}: unknown facts {sorted(unknown)}")
            if i.operation is not None and i.operation not in OPERATIONS or i.operation and i.operation != "synthesis" and len(i.operands) != 2:
                raise ValueError(f"{i.name}: operation {i.operation} with {len(i.operands)} operands")


def _any_of(text: Column, terms) -> Column:
    return reduce(or_, (F.contains(text, F.lit(T.folded(t))) for t in terms), F.lit(False))


def plan_table(questions: DataFrame, config: FinanceConfig) -> DataFrame:
    """(query, text, intent, kind, facts, operation, scope, years): the first intent that fits, else `generic`, which needs no facts."""
    rows = questions.withColumn("_folded", T.fold(F.col("text")))
    struct = lambda name, kind, facts, operation: F.struct(name.alias("intent"), kind.alias("kind"), F.array(*map(F.lit, facts)).cast("array<string>").alias("facts"), F.lit(operation).cast("string").alias("operation"))
    plan = struct(F.lit("generic"), F.when(_any_of(F.col("_folded"), config.explanatory), "narrative").otherwise("lookup"), (), None)
    for i in reversed(config.intents):
        plan = F.when(_any_of(F.col("_folded"), i.patterns), struct(F.lit(i.name), F.lit(i.kind), i.facts, i.operation)).otherwise(plan)
    scope = M.scope(F.col("_folded"), list(config.entities), config.default_entity)
    return rows.withColumn("_plan", plan).select("query", "text", "_plan.*", scope.alias("scope"), T.years(F.col("text")).alias("years"))


def ranked(plan: DataFrame, candidates: DataFrame, config: FinanceConfig) -> DataFrame:
    """candidates (query, position, key, ...) with matched facts and a new place: entity first, then matched facts, then score.

    The score gains shares of matched facts and of the question's words in the heading, and loses where
    the candidate is another entity's. Generic questions keep their order.
    """
    asked = plan.select("query", F.col("text").alias("_asked"), "intent", F.col("facts").alias("plan_facts"), "scope")
    rows = candidates.join(asked, "query").withColumn("_folded", T.fold(F.col("text")))
    rows = rows.withColumn("matched", F.array_intersect("plan_facts", COV.facts_of(F.col("text"), F.col("_folded"), config.facts)))
    # an entity that was resolved counts; the default one may be inherited, so the beginning of the text is looked at too
    resolved = T.fold(F.coalesce(F.col("entity"), F.lit("")))
    named = F.when(~resolved.isin("", T.folded(config.default_entity)), resolved).otherwise(F.concat_ws(" ", resolved, F.left("_folded", F.lit(700))))
    rows = rows.withColumn("_prominent", named)
    other = (F.col("scope") == config.default_entity) & (M.scope(F.col("_prominent"), list(config.entities), config.default_entity) != config.default_entity)
    words, heading = M.search_terms(F.col("_asked")), M.search_terms(F.coalesce(F.col("heading"), F.lit("")))
    share = lambda a, b: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(b) / F.size(a))
    rows = rows.withColumn("mismatch", other).withColumn("_score", F.col("score") + config.fact_weight * share(F.col("plan_facts"), F.col("matched")) + config.heading_weight * share(F.array_distinct(words), F.array_intersect(words, heading)) - F.when(other, config.mismatch).otherwise(0.0))
    generic = F.col("intent") == "generic"
    w = Window.partitionBy("query").orderBy(F.when(generic, F.lit(False)).otherwise(F.col("mismatch")), F.when(generic, 0).otherwise(-F.size("matched")), F.when(generic, F.lit(0.0)).otherwise(-F.col("_score")), "position", "key")
    return rows.withColumn("place", F.row_number().over(w)).select("query", "key", "page", "text", "score", "position", "matched", "plan_facts", "mismatch", "place")


def covered_facts(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """(query, fact, at, pages, covered) of every fact of every plan, in the plan's order; pages by place."""
    wanted = plan.select("query", F.posexplode("facts").alias("at", "fact"))
    found = rows.select("query", "place", "page", F.explode("matched").alias("fact"))
    pages = found.groupBy("query", "fact").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "page"))), lambda x: x["page"])).alias("pages"))
    return wanted.join(pages, ["query", "fact"], "left").withColumn("covered", F.col("pages").isNotNull())


def follow_ups(facts: DataFrame, config: FinanceConfig) -> DataFrame:
    """(query, n, text): the questions of facts that are missing, each once, the first few in the plan's order."""
    text = F.create_map(*(F.lit(x) for name, fact in config.facts.items() for x in (name, fact.get("query", "").strip())))
    asked = facts.where("not covered").withColumn("text", F.get(F.map_values(F.map_filter(text, lambda k, v: k == F.col("fact"))), F.lit(0))).where("text <> ''")
    first = asked.groupBy("query", "text").agg(F.min("at").alias("at"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("at"))).where(F.col("n") <= config.most_follow).select("query", "n", "text")


@dataclass(frozen=True)
class FinanceState:
    """plan, ranked candidates, coverage of the last round, and for each query its rounds, questions and numbers of candidates."""

    plan: DataFrame
    candidates: DataFrame
    coverage: DataFrame
    trace: DataFrame


def controlled_search(questions: DataFrame, search: Search, config: FinanceConfig) -> FinanceState:
    """Candidates of questions (query string, text), with one more round for all that lack facts.

    Missing facts ask all at once, at most most_follow a question; a candidate that is found again keeps
    its first position and its better score. Generic questions ask once.
    """
    plan = materialize(plan_table(questions, config), "plan")
    first = search(plan.select("query", "text"), config.first).withColumn("position", F.struct(F.lit(0).alias("n"), F.col("rank").alias("rank")))
    first = materialize(first.drop("rank"), "round")
    rows = materialize(ranked(plan, first, config), "ranked")
    facts = covered_facts(plan, rows)
    follow = materialize(follow_ups(facts, config).withColumn("ask", F.concat_ws("/", "query", "n")), "follow")
    more = search(follow.select(F.col("ask").alias("query"), "text"), config.follow).withColumnRenamed("query", "ask")
    more = more.join(follow.select("ask", "query", "n"), "ask").withColumn("position", F.struct(F.col("n").cast("int").alias("n"), F.col("rank").alias("rank"))).drop("rank", "ask", "n")
    again = plan.join(follow.select("query").distinct(), "query", "left_semi")
    pool = first.join(again.select("query"), "query", "left_semi").unionByName(more.select(*first.columns))
    best = pool.groupBy("query", "key").agg(F.min("position").alias("position"), F.max_by(F.struct("page", "score", "text", "heading", "entity"), "score").alias("_r"))
    second = ranked(again, best.select("query", "key", "position", "_r.*"), config)
    rows2 = materialize(rows.join(again.select("query"), "query", "left_anti").unionByName(second), "ranked")
    asked = follow.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("follow_ups"))
    n = lambda df, name: df.groupBy("query").agg(F.count(F.lit(1)).alias(name))
    trace = plan.select("query").join(asked, "query", "left").join(n(first, "initial_candidates"), "query", "left").join(n(rows2, "final_candidates"), "query", "left").fillna(0, ["initial_candidates", "final_candidates"])
    trace = trace.withColumn("rounds", F.when(F.col("follow_ups").isNull(), 1).otherwise(2)).withColumn("follow_ups", F.coalesce("follow_ups", F.array().cast("array<string>")))
    return FinanceState(plan, rows2, covered_facts(plan, rows2), trace)


def evidence_of(state: FinanceState, config: FinanceConfig) -> DataFrame:
    """(query, position, key): for each fact of the plan the best candidate that has it, then the best of the rest, up to what its kind of question takes."""
    limits = state.plan.select("query", F.when(F.col("kind").isin("calculation", "multi_hop"), config.complex).otherwise(config.simple).alias("most"))
    return S.cover(state.candidates.join(limits, "query"), "query", "key", "place", "matched", "most", plan="plan_facts")


def derived_facts(state: FinanceState, evidence: DataFrame, config: FinanceConfig) -> DataFrame:
    """(query, operation, expression, result, text, operands, pages) of plans whose operands are all found.

    Each operand comes from the first text that states it, evidence before other candidates. result is a
    decimal; a synthesis has none, its text lists what was found. operands: (role, value, page).
    """
    spark = state.plan.sparkSession
    rules = [(i.name, n, role, pattern) for i in config.intents if i.operation for n, (role, pattern) in enumerate(i.operands)]
    rules = spark.createDataFrame(rules, "intent string, n int, role string, pattern string")
    of = state.plan.where("operation is not null").select("query", "intent", "operation").join(F.broadcast(rules), "intent")
    texts = state.candidates.join(evidence.select("query", "key", F.col("position").alias("_e")), ["query", "key"], "left").withColumn("_text", M.search_text(F.col("text")))
    found = of.join(texts.select("query", "page", "place", "_e", "_text"), "query").withColumn("value", F.expr("regexp_extract(_text, concat('(?ius)', pattern), 1)")).where("value <> ''")
    first = found.groupBy("query", "operation", "n", "role").agg(F.min_by(F.struct("value", "page"), F.struct(F.col("_e").isNull(), F.coalesce("_e", "place"))).alias("_f"))
    all_ = first.groupBy("query", "operation").agg(F.array_sort(F.collect_list(F.struct("n", "role", F.col("_f.value").alias("value"), F.col("_f.page").alias("page")))).alias("_o"))
    needed = rules.groupBy("intent").agg(F.count(F.lit(1)).alias("needed"))
    whole = all_.join(state.plan.select("query", "intent"), "query").join(F.broadcast(needed), "intent").where(F.size("_o") == F.col("needed"))
    value = lambda i: F.get("_o", F.lit(i))["value"]
    a, b = M.financial_number(value(0)), M.financial_number(value(1))
    is_ = lambda name: F.col("operation") == name
    ratio = F.when(b != -100, a / (1 + b / 100))
    result = F.when(is_("difference"), a - b).when(is_("point_difference"), F.abs(a - b)).when(is_("multiply"), a * b).when(is_("reverse_growth"), ratio).cast("decimal(38,6)")
    written = F.lit(None).cast("string")
    for name, form in EXPRESSION.items():
        written = F.when(is_(name), F.format_string(form.replace("{}", "%s"), value(0), value(1))).otherwise(written)
    listed = F.array_join(F.transform("_o", lambda o: F.concat(o["role"], F.lit(" "), o["value"])), ", ")
    out = whole.withColumn("result", result).withColumn("expression", F.coalesce(written, F.array_join(F.transform("_o", lambda o: o["role"]), " + ")))
    out = out.where(is_("synthesis") | F.col("result").isNotNull())
    operands = F.transform("_o", lambda o: F.struct(o["role"].alias("role"), o["value"].alias("value"), o["page"].alias("page")))
    pages = F.array_sort(F.array_distinct(F.transform("_o", lambda o: o["page"])))
    return out.select("query", "operation", "expression", "result", F.when(is_("synthesis"), listed).alias("text"), operands.alias("operands"), pages.alias("pages"))
