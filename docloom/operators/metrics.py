"""Metric values in chunks: normal forms, labels, row parsing, answers from one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

#: Words that recognition confuses, and what they stand for.
CORRECTIONS = {"tử": "từ", "đông": "đồng", "hoặt": "hoạt", "tiên": "tiền", "chúng": "chứng", "dựng": "dụng"}
#: Phrases that tell metrics of one name apart.
QUALIFIERS = ("nhận được", "đã trả", "thuần", "hợp nhất", "riêng lẻ", "cuối kỳ", "đầu kỳ", "bình quân", "trước thuế", "sau thuế")
#: Statements by the phrases that name them; the first that occurs counts.
STATEMENTS = (
    ("lưu chuyển tiền tệ", "cash_flow"), ("kết quả hoạt động kinh doanh", "income_statement"), ("báo cáo kết quả", "income_statement"), ("cân đối kế toán", "balance_sheet"),
    ("tình hình tài chính", "balance_sheet"), ("thuyết minh", "financial_note"), ("kết quả hoạt động", "performance_review"),
)
#: Words of a label or question that name nothing. Callers add the name of the document's own entity.
LABEL_STOP = ("của", "năm", "là", "bao", "nhiêu", "tại", "ngày")
#: What begins a row, and a value of a year in it.
ROW_START = r"(?:Cột\s*1|Chỉ tiêu)\s*:"
VALUE = r"((?:19|20)[0-9]{2})(?:\\n|\s)*([^:|\n]{1,40}?)\s*:\s*(\(?-?[0-9.]+(?:,[0-9]+)?\)?|-)"
#: What makes a box a detail of the value above it.
UNIT = r"(?iu)(?<![\p{L}\p{N}_])(?:nghìn tỷ đồng|tỷ đồng|triệu đồng|triệu khách hàng|triệu người|nghìn người|phần trăm|điểm cơ bản|khách hàng|giao dịch)(?![\p{L}\p{N}_])|%"
DETAIL = r"(?iu)^(?:tăng|giảm|tăng trưởng|trung bình|tại(?![\p{L}\p{N}_])|so với|n/n|yoy|cagr|dẫn đầu|thuộc nhóm|được thực hiện|chất lượng|triển vọng|~)"
#: Bonus of a representation by what the question asks for; of several that match, the first counts.
NUMERIC_BONUS = (("row", 0.06), ("block", 0.03), ("table", 0.03), ("page", -0.03))
EXPLANATORY_BONUS = (("paragraph", 0.05), ("narrative", 0.05), ("block", 0.03), ("row", -0.03))
EDGE = r"[\p{L}\p{N}_]"


def search_text(text: Column) -> Column:
    """NFKC, confused words put right, blanks collapsed."""
    beyond = F.when(text.rlike(r"[^\x00-\x7f]"), text)
    out = F.coalesce(T.nfkc(beyond), text, F.lit(""))
    for wrong, right in CORRECTIONS.items():
        out = F.regexp_replace(out, rf"(?iu)(?<!{EDGE}){wrong}(?!{EDGE})", right)
    return T.squeeze(out)


def search_terms(text: Column) -> Column:
    """Runs of letters, and numbers, of a text in its search form."""
    return T.all_matches(F.lower(text), r"[\p{L}\p{M}]+|[0-9]+(?:[.,][0-9]+)*")


def holds_phrase(folded: Column, phrase: Column) -> Column:
    """Whole-word containment of a phrase in a text; both folded. An empty phrase is in nothing.

    The phrase is taken literally. Each place of it counts, overlapping and touching ones too; what touches another place of a phrase that ends in a letter is no whole word.
    """
    literal = F.concat(F.lit(r"\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return (phrase != "") & F.contains(folded, phrase) & F.rlike(folded, F.concat(F.lit(f"(?<!{EDGE})"), literal, F.lit(f"(?!{EDGE})")))


def expanded(terms: DataFrame, aliases: DataFrame, term: str, alias: str) -> DataFrame:
    """terms with an array of aliases each; a term without any stands for itself. aliases: (term, alias) rows."""
    grouped = aliases.groupBy(term).agg(F.array_sort(F.collect_set(alias)).alias("aliases"))
    return terms.join(grouped, term, "left").withColumn("aliases", F.coalesce("aliases", F.array(term)))


def is_generic(heading: Column, generic: list[str]) -> Column:
    """Whether a heading says nothing: empty, or a generic one as a whole."""
    clean = F.lower(T.squeeze(F.coalesce(heading, F.lit(""))))
    return (clean == "") | clean.isin([g.lower() for g in generic])


def statement_type(text: Column) -> Column:
    return T.first_case(text, list(STATEMENTS), "unspecified")


def metric_label(text: Column, metric: Column) -> Column:
    """The metric's name if it is known; else the first row label that is not all capitals, or the last one."""
    labels = F.transform(T.all_matches(text, rf"(?iu){ROW_START}\s*([^|\n]+)", 1), T.squeeze)
    named = F.filter(labels, lambda x: (x != "") & ((x != F.upper(x)) | (x == F.lower(x))))
    from_rows = T.let(labels, lambda x: F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(x, F.lit(-1)), F.lit("")))
    return F.when(F.coalesce(metric, F.lit("")) != "", metric).otherwise(from_rows)


def with_identity(chunks: DataFrame, text: str, heading: str, metric: str) -> DataFrame:
    """chunks with metric_label, metric_key, statement_type, metric_qualifiers, metric_years and search_text (prefix lines, then the text)."""
    rows = chunks.withColumn("_text", search_text(F.col(text))).withColumn("metric_label", search_text(metric_label(F.col(text), F.col(metric))))
    rows = rows.withColumn("statement_type", statement_type(F.concat_ws(" ", search_text(F.col(heading)), "_text")))
    rows = rows.withColumn("metric_qualifiers", T.terms_in(F.lower("metric_label"), list(QUALIFIERS))).withColumn("metric_years", T.years(F.col(text)))
    name = F.array_join(search_terms(F.col("metric_label")), " ")
    rows = rows.withColumn("metric_key", F.when(name != "", F.concat("statement_type", F.lit("::"), name)).otherwise(F.lit("")))
    lines = [
        F.concat(F.lit("Loại báo cáo: "), "statement_type"),
        F.when(F.col("metric_label") != "", F.concat(F.lit("Nhãn chỉ tiêu chuẩn hóa: "), "metric_label")),
        F.when(F.size("metric_qualifiers") > 0, F.concat(F.lit("Từ khóa phân biệt: "), F.array_join("metric_qualifiers", ", "))),
        F.when(F.col("_text") != "", F.col("_text")),
    ]
    return rows.withColumn("search_text", F.concat_ws("\n", *lines)).drop("_text")


def table_number(value: Column) -> Column:
    """A number of a table as decimal(38,6): dots group, a comma is the decimal mark, parentheses negate, a dash is null."""
    plain = F.replace(F.replace(F.regexp_replace(value, r"[()]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    number = plain.try_cast("decimal(38,6)")
    return F.when(value.rlike(r"^\(.*\)$"), -number).otherwise(number)


def either_number(value: Column) -> Column:
    """A number as decimal(38,6) that groups by dots or by commas: three digits after each mark group, otherwise the mark is the decimal one."""
    text = F.trim(value)
    grouped_commas = text.rlike(r"^-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$")
    grouped_dots = text.rlike(r"^-?[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?$")
    plain = F.when(grouped_commas, F.replace(text, F.lit(","), F.lit(""))).when(grouped_dots, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit(".")))
    return plain.try_cast("decimal(38,6)")


def financial_number(value: Column) -> Column:
    """A number of a report as decimal(38,6): a sign, % or x around it go; dots alone group where three digits follow each; a comma is always the decimal mark."""
    text = F.regexp_replace(F.trim(value), "^[+]|[%xX]+$", "")
    no_dots = F.replace(text, F.lit("."), F.lit(""))
    comma, dots = F.contains(text, F.lit(",")), text.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})+$")
    return F.when(dots, no_dots).when(comma, F.replace(no_dots, F.lit(","), F.lit("."))).otherwise(text).try_cast("decimal(38,6)")


def metric_rows(chunks: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, row, label, year, value, unit) of `label | year unit: value | ...` rows in texts; of one year twice in a row, the last counts."""
    rows = chunks.select(*key, F.posexplode(F.split(text, rf"(?iu)(?:^|\n)(?={ROW_START})")).alias("row", "_r")).where(F.col("_r").rlike(rf"(?iu)^\s*{ROW_START}"))
    parts = F.regexp_extract("_r", rf"(?ius)^\s*{ROW_START}\s*([^|\n]+)\|\s*(.*)$", 1), F.regexp_extract("_r", rf"(?ius)^\s*{ROW_START}\s*([^|\n]+)\|\s*(.*)$", 2)
    rows = rows.select(*key, "row", T.squeeze(parts[0]).alias("label"), parts[1].alias("_body"))
    found = rows.select(*key, "row", "label", F.posexplode(F.arrays_zip(*(T.all_matches(F.col("_body"), VALUE, g).alias(n) for g, n in ((1, "year"), (2, "unit"), (3, "value"))))).alias("_i", "_v"))
    last = found.groupBy(*key, "row", "label", F.col("_v.year").alias("year")).agg(F.max_by("_v", "_i").alias("_v"))
    return last.select(*key, "row", "label", "year", F.col("_v.value").alias("value"), F.lower(T.squeeze(F.col("_v.unit"))).alias("unit"))


def coverage(question: Column, label: Column, stop: tuple[str, ...] = LABEL_STOP) -> Column:
    """Share of the label's distinct terms that the question has; 0 without any."""
    wanted = F.array_distinct(F.filter(search_terms(label), lambda t: ~t.isin(*stop)))
    return T.let(wanted, lambda w: F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(w, search_terms(question))) / F.size(w)))


#: What asks for a comparison of two years.
COMPARISON = r"(?iu)(?<![\p{L}\p{N}_])(?:so\s+với|tăng|giảm|thay\s+đổi|chênh\s+lệch|bao\s+nhiêu\s+phần\s+trăm)(?![\p{L}\p{N}_])"


def answers_from_rows(
    questions: DataFrame, rows: DataFrame, query: str, question: str, place: list[str], least: float = 0.72, stop: tuple[str, ...] = LABEL_STOP, semantic: DataFrame | None = None
) -> DataFrame:
    """One row for each query: (query, kind, label, unit, values, delta, percent, details, reason). kind is null where there is no sure answer, and reason says why.

    questions: (query, question, the columns of place), with the chunks that were found for it; rows:
    metric_rows of these by place. Of the rows that have a value of every year asked for, the one whose
    label the question covers best decides, the first by place and row of equals: if its values are of
    several units, or one that a comparison needs is a dash, no other row answers in its stead. One year
    is a `lookup`, two with a word of comparison a `comparison`: the year named first less the other,
    in decimals, and in percent of the other's size. Anything else is refused, as is a question without years.

    semantic: (the columns of place, metric, value, unit, details, reporting_year, text), asked where no
    row fits: a metric whose name is covered and whose year or text has all years. Its kind is `semantic`.
    """
    years = T.years(F.col(question))
    asked = questions.withColumn("_years", years)
    each = asked.groupBy(query).agg(F.first("_years").alias("_years"), F.first(F.col(question).rlike(COMPARISON)).alias("_compares"))
    grouped = rows.groupBy(*place, "row", "label").agg(F.array_sort(F.collect_list(F.struct("year", "value", "unit"))).alias("_values"))
    joined = asked.where(F.size("_years") > 0).join(grouped, place).withColumn("_cover", coverage(F.col(question), F.col("label"), stop)).where(F.col("_cover") >= least)
    whole = F.size(F.array_except("_years", F.transform("_values", lambda v: v["year"]))) == 0
    w = Window.partitionBy(query).orderBy(F.desc("_cover"), *place, "row")
    best = joined.where(whole).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    # in the order of the question
    values = F.transform("_years", lambda y: F.get(F.filter("_values", lambda v: v["year"] == y), F.lit(0)))
    best = best.select(query, "label", values.alias("_found"))
    out = each.join(best, query, "left")
    numbers = F.transform("_found", lambda v: table_number(v["value"]))
    newer, older = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    units = F.array_distinct(F.transform("_found", lambda v: v["unit"]))
    n = F.size("_years")
    compared = (n == 2) & F.col("_compares")
    reason = (
        F.when(n == 0, "no_years").when(F.col("_found").isNull(), "no_row").when(F.size(units) != 1, "several_units").when((n == 1) & ~F.col("_compares"), F.lit(None).cast("string"))
        .when(~compared, "neither_lookup_nor_comparison").when(newer.isNull() | older.isNull() | (older == 0), "no_number").otherwise(F.lit(None).cast("string"))
    )
    out = out.withColumn("reason", reason)
    sure = F.col("reason").isNull()
    delta = (newer - older).cast("decimal(38,6)")
    out = out.select(
        query, "_years", F.when(sure, F.when(compared, "comparison").otherwise("lookup")).alias("kind"), F.when(sure, F.col("label")).alias("label"), F.when(sure, F.get(units, F.lit(0))).alias("unit"),
        F.when(sure, F.transform("_found", lambda v: F.concat(v["year"], F.lit(": "), v["value"]))).alias("values"), F.when(sure & compared, delta).alias("delta"),
        F.when(sure & compared, F.round(delta.cast("double") * 100 / F.abs(older).cast("double"), 6)).alias("percent"), F.lit(None).cast("array<string>").alias("details"), "reason",
    )
    if semantic is None:
        return out.drop("_years")
    open_ = out.where("reason = 'no_row'").select(query)
    held = asked.join(open_, query, "left_semi").join(semantic, place)
    name, value, unit = (search_text(F.col(c)) for c in ("metric", "value", "unit"))
    held = held.withColumn("_label", name).withColumn("_value", value).withColumn("_unit", F.lower(unit)).withColumn("_text", search_text(F.col("text")))
    fits = F.forall("_years", lambda y: (y == F.coalesce(F.col("reporting_year").cast("string"), F.lit(""))) | F.contains(F.col("_text"), y))
    held = held.where((F.col("_label") != "") & (F.col("_value") != "")).withColumn("_cover", coverage(F.col(question), F.col("_label"), stop)).where(fits & (F.col("_cover") >= least))
    held = held.withColumn("_n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("_cover"), *place, "_label", "_value"))).where("_n = 1")
    plain = F.transform(F.coalesce("details", F.array().cast("array<string>")), lambda d: F.regexp_replace(T.squeeze(d), "^[▲△ ]+", ""))
    year = F.coalesce(F.col("reporting_year").cast("string"), F.element_at("_years", -1))
    with_unit = F.when((F.col("_unit") != "") & ~F.contains(F.lower("_value"), F.col("_unit")), F.concat_ws(" ", "_value", "_unit")).otherwise(F.col("_value"))
    said = held.select(query, F.col("_label").alias("s_label"), F.col("_unit").alias("s_unit"), F.array(F.concat(year, F.lit(": "), with_unit)).alias("s_values"), F.array_distinct(F.filter(plain, lambda d: (d != "") & (F.lower(d) != F.col("_unit")))).alias("s_details"))
    both = out.join(said, query, "left")
    is_said = F.col("s_label").isNotNull()
    pick = lambda new, old: F.when(is_said, new).otherwise(F.col(old)).alias(old)
    return both.select(
        query, pick(F.lit("semantic"), "kind"), pick(F.col("s_label"), "label"), pick(F.col("s_unit"), "unit"), pick(F.col("s_values"), "values"), "delta", "percent",
        pick(F.col("s_details"), "details"), F.when(~is_said, F.col("reason")).alias("reason"),
    )


def same_column(a: str, b: str) -> Column:
    """Whether boxes a and b (x0, x1) stand in one column: a quarter of the narrower one is shared, or their centres are within 100."""
    col = lambda side, name: F.col(f"{side}.{name}")
    shared = F.greatest(F.lit(0.0), F.least(col(a, "x1"), col(b, "x1")) - F.greatest(col(a, "x0"), col(b, "x0")))
    narrow = F.greatest(F.lit(1.0), F.least(col(a, "x1") - col(a, "x0"), col(b, "x1") - col(b, "x0")))
    return (shared / narrow >= 0.25) | (F.abs((col(a, "x0") + col(a, "x1")) / 2 - (col(b, "x0") + col(b, "x1")) / 2) <= 100)


def details_below(values: DataFrame, boxes: DataFrame, group: str, far: float = 230.0, most: int = 3) -> DataFrame:
    """(group, value_id, details): texts of the first `most` boxes by id that are units or details, in the value's column and at most `far` below it.

    Boxes: (group, id, text, x0, y0, x1, y1). The text's test comes before the join.
    """
    kind = boxes.where(F.col("text").rlike(UNIT) | F.col("text").rlike(DETAIL)).alias("b")
    gap = F.col("b.y0") - F.col("v.y1")
    pairs = values.alias("v").join(kind, (F.col(f"v.{group}") == F.col(f"b.{group}")) & gap.between(0, far) & same_column("v", "b"))
    first = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(F.col(f"v.{group}"), F.col("v.id")).orderBy(F.col("b.id")))).where(F.col("_n") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("b.text").alias("text")))), lambda x: x["text"])
    return first.groupBy(F.col(f"v.{group}").alias(group), F.col("v.id").alias("value_id")).agg(listed.alias("details"))


def representation_bonus(numeric: Column, explanatory: Column, representation: Column) -> Column:
    """What a representation is worth to a question that asks for numbers, or for explanations (these go first)."""
    low = F.lower(representation)

    def by(table):
        out = F.lit(0.0)
        for word, bonus in reversed(table):
            out = F.when(F.contains(low, F.lit(word)), F.lit(bonus)).otherwise(out)
        return out

    return F.when(explanatory, by(EXPLANATORY_BONUS)).when(numeric, by(NUMERIC_BONUS)).otherwise(F.lit(0.0))


def resolved_entity(section: Column, document: Column, company: str, division: str) -> Column:
    """The entity that a section's title names: a company as it is, a division beside the document's entity, else the document's."""
    low = F.lower(F.coalesce(section, F.lit("")))
    is_company, is_division = low.rlike(rf"^{company}(?!{EDGE})"), low.rlike(rf"^{division}(?!{EDGE})")
    return F.when(is_division & (F.coalesce(document, F.lit("")) != ""), F.concat_ws(" — ", document, section)).when(is_company | is_division, section).otherwise(document)


def scope(prominent: Column, aliases: list[tuple[str, str]], default: str) -> Column:
    """The first entity of which an alias stands in the (folded) prominent text as whole words."""
    out = F.lit(default)
    for entity, alias in reversed(aliases):
        out = F.when(holds_phrase(prominent, F.lit(T.folded(alias))), F.lit(entity)).otherwise(out)
    return out


def automatic_correct(answerable: Column, refused: Column, answer: Column, gold: Column, f1: Column) -> Column:
    """Refused if it cannot be answered; else not refused, all numbers of the gold answer in it and f1 of 0.45 or more; null without gold."""
    numbers = lambda c: T.numbers(F.coalesce(c, F.lit("")))
    complete = F.size(F.array_except(numbers(gold), numbers(answer))) == 0
    return F.when(answerable.eqNullSafe(F.lit(False)), refused).when(answerable & (F.coalesce(gold, F.lit("")) != ""), ~refused & complete & (f1 >= 0.45))
