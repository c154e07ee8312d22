"""How filters interact, from one pass over the documents (Walsh-Hadamard).

Every document has a mask of the filters that it fails. For each part and label, the sum of
(-1)^|S & mask| over its documents is taken for each of the 32 sets S of five filters; these sums are
the transform of the counts of the 32 masks, so its inverse, which is the transform again divided by
32, gives the counts exactly in integers. Everything that an order of filters removes, keeps or finds
removed before follows from the 32 counts, and the Shapley value needs no order at all: a document that
fails k filters is removed by each of them in 120/k of the 120 orders.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]

#: Space and \\x09-\\x0D, which separate words.
BLANKS = " \t\n\x0b\f\r"


def text_failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails: under 100 words, under 80 % distinct words, over 10 % capitals, a symbol."""
    body = F.btrim(text, F.lit(BLANKS))
    words = F.split(body, "[ \\x09-\\x0D]+")
    empty = body == ""
    n = F.when(empty, 0).otherwise(F.size(words))
    distinct = F.when(empty, 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, 100 * distinct.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return reduce(lambda a, b: a + b, (F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))).cast("int")


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n): how many documents of a part fail just the filters of mask.

    docs has doc_id, text and lang; labels has doc_id, quality and toxic. A null text is empty, a null
    lang the part ''. Rows that share a doc_id count each; E takes those whose text some smaller doc_id
    has, so rows of the smallest one pass, as do rows without an id. Of several labels of an id any 1
    counts. Texts travel as digests, and many copies of one are counts before they meet.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_failures(text).alias("mask"))
    one = lambda c: F.max((F.col(c) == 1).cast("int")) == 1
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(one("quality"), F.lit(False)).alias("good"), F.coalesce(one("toxic"), F.lit(False)).alias("toxic"))
    # rows without an id have no label to find: dealt by a number of their own, they never meet in one task
    salt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0))
    rows = rows.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    rows = rows.fillna(False, ["good", "toxic"])
    kind = ["part", "good", "toxic", "mask"]
    ids = rows.groupBy("doc_id", "salt", "digest", *kind).agg(F.count(F.lit(1)).alias("n"))
    has_id = F.col("doc_id").isNotNull()
    groups = ids.groupBy("digest", *kind).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("without"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
    )
    groups = materialize(groups, "audit")
    smallest = groups.groupBy("digest").agg(F.min("first.doc_id").alias("smallest"))
    at_first = F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    passing = F.col("without") + F.coalesce(at_first, F.lit(0))
    both = groups.join(smallest, "digest").select(*kind, F.explode(F.array(F.struct(F.lit(0).alias("e"), passing.alias("m")), F.struct(F.lit(16).alias("e"), (F.col("n") - passing).alias("m")))).alias("x"))
    return both.groupBy("part", "good", "toxic", (F.col("mask") + F.col("x.e")).alias("mask")).agg(F.sum("x.m").alias("n"))


def sign(a: Column, b: Column) -> Column:
    """(-1) to the number of filters in both sets."""
    return F.lit(1) - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(masks: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): for each set S of filters, the documents with an even number of failures in S less those with an odd one."""
    sums = [F.sum(F.col("n") * sign(F.col("mask"), F.lit(s))) for s in range(MASKS)]
    return masks.groupBy("part", "good", "toxic").agg(F.array(*sums).alias("sums"))


def mask_cells(sums: DataFrame) -> DataFrame:
    """(part, cells, good_cells, toxic_cells): counts by mask, from the parity sums by the inverse transform."""
    sets = F.sequence(F.lit(0), F.lit(MASKS - 1))
    inverse = F.transform(sets, lambda m: F.aggregate(sets, F.lit(0).cast("long"), lambda acc, s: acc + sign(m, s) * F.get("sums", s)))
    by_label = sums.select("part", "good", "toxic", F.posexplode(inverse).alias("mask", "n")).withColumn("n", F.expr(f"n div {MASKS}"))
    by_mask = by_label.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"n_{c}") for c in ("good", "toxic")))
    cells = F.array_sort(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")))
    return by_mask.groupBy("part").agg(cells.alias("c")).select("part", F.col("c.n").alias("cells"), F.col("c.n_good").alias("good_cells"), F.col("c.n_toxic").alias("toxic_cells"))


def audit_orders(cells: DataFrame) -> DataFrame:
    """Each part, order and step: what the step's filter removes, keeps, and finds removed, and its Shapley value."""
    steps = cells.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = "shiftleft(1, instr('ABCDE', substring(filter_order, {}, 1)) - 1)"
    steps = steps.withColumn("own", F.expr(place.format("step"))).withColumn("before", F.expr(f"aggregate(filter(sequence(1, 5), i -> i < step), 0, (m, i) -> m | {place.format('i')})"))
    total = lambda of, where: F.expr(f"aggregate(sequence(0, {MASKS - 1}), 0L, (s, m) -> s + if({where}, {of}, 0L))")
    removed = "(m & own) <> 0 and (m & before) = 0"
    return steps.select(
        "part", "filter_order", "step",
        total("cells[m]", "(m & (own | before)) = 0").alias("kept"),
        total("cells[m]", removed).alias("removed"),
        total("cells[m]", "(m & own) <> 0 and (m & before) <> 0").alias("redundant"),
        total("cells[m]", "m = own").alias("unique_fails"),
        total("good_cells[m]", removed).alias("good_lost"),
        total("toxic_cells[m]", removed).alias("toxic_lost"),
        total(f"cells[m] * ({len(ORDERS)} div bit_count(m))", "(m & own) <> 0").alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs, 600 rows for each part; an empty table gives none. More columns of docs and labels are not read."""
    return audit_orders(mask_cells(parity_sums(failure_masks(docs, labels))))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and labels under all 120 orders of the five filters."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLES = {
    "op13_filter_audit": r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS smallest FROM d),
    l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
            {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
             'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t),
             'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > smallest, false)} AS x
          FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
    fails AS (SELECT part, good, toxic, count(*) AS n, concat(if(x.A, 'A', ''), if(x.B, 'B', ''), if(x.C, 'C', ''), if(x.D, 'D', ''), if(x.E, 'E', '')) AS failed FROM f GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
    orders AS (SELECT concat(a.c, b.c, c.c, d.c, e.c) AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
    steps AS (SELECT o, s, o[s] AS own, o[1:s - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
    runs AS (SELECT part, o, s, n, good, toxic, failed, own, contains(failed, own) AS fails, regexp_matches(failed, '[' || before || '-]') AS gone FROM fails, steps)
    SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step,
      CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
      CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = own), 0) AS BIGINT) AS unique_fails,
      CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost,
      CAST(coalesce(sum(n * (120 // greatest(length(failed), 1))) FILTER (fails), 0) AS BIGINT) AS shapley
    FROM runs GROUP BY ALL
    """,
}
