"""Selection of evidence: duplicates, diversity, budgets, coverage. Groups are candidate pools of bounded size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import metrics as M

#: Terms of the diversity score, as the compared system publishes them.
SAME_PAGE, SAME_KIND, TIE = 0.08, 0.025, 1e-6
#: A row that has this share of a question's words, and of the best score, is a direct match.
DIRECT_SHARE, NEAR_BEST = 0.5, 0.85
#: What asks for numbers and for explanations, and words of a question that name nothing.
NUMERIC_QUESTION = r"(?iu)(?<![\p{L}\p{N}_])(?:bao nhiêu|tỷ lệ|tỷ suất|năm\s+20[0-9]{2}|tăng trưởng|cagr|roe|roa|nim|casa|npl)(?![\p{L}\p{N}_])|%"
EXPLANATORY_QUESTION = r"(?iu)(?<![\p{L}\p{N}_])(?:tại sao|vì sao|giải thích|nguyên nhân|chiến lược|chính sách|vai trò|mô tả)(?![\p{L}\p{N}_])"
QUESTION_STOP = ("bao", "của", "cho", "là", "nào", "năm", "nhiêu", "tại", "theo", "thế", "thì", "và", "với", "được")


def ordered_array(rows: Column, *keys: Column) -> Column:
    """The group's rows as an array in the order of keys: structs of the keys first, then the row."""
    return F.array_sort(F.collect_list(F.struct(*keys, rows)))


def dedup_by_page(rows: DataFrame, by: list[str], page: str, key: str, score: str, text: str, most: int = 2, threshold: float = 0.88) -> DataFrame:
    """(by, key) of kept rows: by falling score, at most `most` a page, none too similar to a kept row of its page.

    A fold over the sorted rows of a page; pages are groups of a candidate pool.
    """
    item = F.struct((-F.col(score)).alias("order"), F.col(key).alias("key"), T.word_set(F.col(text)).alias("words"))
    grouped = rows.groupBy(*by, page).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    kind = grouped.schema["_rows"].dataType.simpleString()
    start = F.array().cast(kind)

    def step(kept, row):
        similar = F.exists(kept, lambda k: T.set_similarity(k["words"], row["words"]) >= threshold)
        known = F.exists(kept, lambda k: k["key"] == row["key"])
        return F.when((F.size(kept) < most) & ~similar & ~known, F.concat(kept, F.array(row))).otherwise(kept)

    return grouped.select(*by, page, F.explode(F.aggregate("_rows", start, step)).alias("_r")).select(*by, page, F.col("_r.key").alias(key))


def token_budget(rows: DataFrame, by: list[str], order: list[str], key: str, tokens: str, most_rows: int = 6, most_tokens: int = 5000) -> DataFrame:
    """(by, key, position) of rows taken in order while they fit; one that does not fit is passed over."""
    item = F.struct(*order, F.col(key).alias("_key"), F.col(tokens).cast("long").alias("_n"))
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    key_type = dict(rows.dtypes)[key]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{key_type}>").alias("kept"))

    def step(at, row):
        fits = (F.size(at["kept"]) < most_rows) & (at["used"] + row["_n"] <= most_tokens)
        taken = F.struct((at["used"] + row["_n"]).alias("used"), F.concat(at["kept"], F.array(row["_key"])).alias("kept"))
        return F.when(fits, taken).otherwise(at)

    kept = grouped.select(*by, F.aggregate("_rows", start, step, lambda at: at["kept"]).alias("_kept"))
    return kept.select(*by, F.posexplode("_kept").alias("position", key))


def best_per_key(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def joined_prefix(rows: DataFrame, by: list[str], order: list[Column], text: str, joiner: str, most: int) -> DataFrame:
    """(by, text): texts of a group joined in order, as far as its first `most` characters go; what begins beyond them is dropped before rows are gathered. Null texts are left out."""
    w = Window.partitionBy(*by).orderBy(*order)
    told = rows.where(F.col(text).isNotNull()).withColumn("_i", F.row_number().over(w)).withColumn("_at", F.coalesce(F.sum(F.length(text) + len(joiner)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the joiner before a text may still be within, though the text is not
    gathered = told.where(F.col("_at") < most + len(joiner)).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", F.left(text, F.lit(most)).alias("t")))).alias("_l"))
    return gathered.select(*by, F.left(F.array_join(F.transform("_l", lambda x: x["t"]), joiner), F.lit(most)).alias("text"))


def rank_hot_groups(rows: DataFrame, by: str, value: str, key: str, tiles: int) -> DataFrame:
    """rows with rn, rk, dr and quartile by falling value, then key, within `by`: what the window functions give, though a group may hold most rows.

    key is an integer. Rows are sorted within (group, value) and 2**16 keys only, so neither a group nor a value
    that most rows have is one task. What lies before comes from counts: of the key ranges of a value, and of
    distinct values, whose own running sums are taken within ranges of 2**10 values and over the ranges.
    """
    rows = rows.withColumn("_keys", F.shiftright(F.col(key).cast("long"), 16))
    cells = rows.groupBy(by, value, "_keys").agg(F.count(F.lit(1)).alias("_c"))
    sizes = cells.groupBy(by, value).agg(F.sum("_c").alias("_n")).withColumn("_range", F.floor(F.col(value) / 1024).cast("long"))
    fall = lambda *cols: Window.partitionBy(*cols[:-1]).orderBy(F.desc_nulls_last(cols[-1])).rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.groupBy(by, "_range").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_values"))
    above = fall(by, "_range")
    ranges = ranges.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_rows", "_values")))
    inside = fall(by, "_range", value)
    placed = sizes.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).withColumn("_d", F.count("_n").over(inside))
    placed = placed.join(ranges, F.col(by).eqNullSafe(F.col("_by")) & F.col("_range").eqNullSafe(F.col("_r")))
    total = sizes.groupBy(F.col(by).alias("_g")).agg(F.sum("_n").alias("_total"))
    placed = placed.join(total, F.col(by).eqNullSafe(F.col("_g"))).select(F.col(by).alias("_by"), F.col(value).alias("_value"), (F.col("_rows_above") + F.col("_in")).alias("_before"), (F.col("_values_above") + F.col("_d") + 1).alias("dr"), "_total")
    earlier = F.coalesce(F.sum("_c").over(Window.partitionBy(by, value).orderBy("_keys").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_earlier", earlier).join(placed, F.col(by).eqNullSafe(F.col("_by")) & F.col(value).eqNullSafe(F.col("_value"))).select("_by", "_value", F.col("_keys").alias("_k"), "_earlier", "_before", "dr", "_total")
    out = rows.withColumn("_at", F.row_number().over(Window.partitionBy(by, value, "_keys").orderBy(key)))
    out = out.join(cells, F.col(by).eqNullSafe(F.col("_by")) & F.col(value).eqNullSafe(F.col("_value")) & F.col("_keys").eqNullSafe(F.col("_k")))
    out = out.withColumn("rn", (F.col("_before") + F.col("_earlier") + F.col("_at")).cast("int")).withColumn("rk", (F.col("_before") + 1).cast("int")).withColumn("dr", F.col("dr").cast("int"))
    wide, over = F.floor(F.col("_total") / tiles), F.col("_total") % tiles  # the first tiles have one more
    long_part = over * (wide + 1)
    tile = F.when(F.col("rn") <= long_part, F.ceil(F.col("rn") / (wide + 1))).otherwise(over + F.ceil((F.col("rn") - long_part) / F.greatest(wide, F.lit(1))))
    return out.withColumn("quartile", tile.cast("int")).drop("_at", "_by", "_value", "_before", "_total", "_keys", "_k", "_earlier")


def round_robin(rows: DataFrame, by: list[str], key: str, rank: str, turn: str) -> DataFrame:
    """Rows of several rankings interleaved by rank, then turn; the first of each key stays. position counts from 1."""
    first = best_per_key(rows, [*by, key], [F.asc(rank), F.asc(turn)])
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(rank, turn, key)))


def _similarity(a: set, b: set) -> float:
    if not a or not b:
        return float(a == b)
    shared = len(a & b)
    return max(shared / len(a | b), shared / min(len(a), len(b)))


def diverse(
    rows: DataFrame, by: str, key: str, page: str, kind: str, score: str, text: str, k: int, balance: float = 0.7, question: str | None = None, protected: int | None = None
) -> DataFrame:
    """(by, position, key): maximal marginal relevance with penalties for a page or kind that is taken.

    question: a column with the question. A row's kind is then worth more or less to one that asks for
    numbers or explanations, and the row that names most of the question's words, if that is half of
    them and its score is near the best, is moved into the first `protected` rows (5 unless given).

    Each choice depends on all before it, so pools (a bounded number of candidates of a query) are grouped to Python.
    """
    types = dict(rows.dtypes)

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values([score, key], ascending=[False, True]).reset_index(drop=True)
        words = [set(w) for w in pool["_words"]]
        s, bonus = pool[score].to_numpy(float), pool["_bonus"].to_numpy(float)
        low, high = s.min(), s.max()
        relevant = [1.0] * len(s) if high == low else (s / high if low >= 0 and high > 0 else (s - low) / (high - low))
        taken: list[int] = []
        while len(taken) < min(k, len(pool)):
            best, best_score = -1, float("-inf")
            for i in range(len(pool)):
                if i in taken:
                    continue
                value = balance * relevant[i] + TIE * s[i] + bonus[i]
                if taken:
                    value -= (1 - balance) * max(_similarity(words[i], words[j]) for j in taken)
                    value -= SAME_PAGE * any(pool[page][i] == pool[page][j] for j in taken)
                    value -= SAME_KIND * any(pool[kind][i] == pool[kind][j] for j in taken)
                if value > best_score:
                    best, best_score = i, value
            taken.append(best)
        asked = set(pool["_asked"][0])
        if asked:  # no novelty may crowd out the row that says what was asked
            shares = [len(asked & w) / len(asked) for w in words]
            direct = max(range(len(pool)), key=lambda i: (shares[i], s[i]))
            window = min(protected or min(5, k), k)
            near = s[direct] >= (NEAR_BEST * high if high > 0 else high)
            if shares[direct] >= DIRECT_SHARE and near and direct not in taken[:window]:
                taken = [i for i in taken if i != direct]
                taken.insert(window - 1, direct)
                del taken[k:]
        return pd.DataFrame({by: pool[by].iloc[0], "position": range(1, len(taken) + 1), key: [pool[key][i] for i in taken]})

    if question:
        low_q = F.lower(F.col(question))
        bonus = M.representation_bonus(low_q.rlike(NUMERIC_QUESTION), low_q.rlike(EXPLANATORY_QUESTION), F.col(kind).cast("string"))
        asked = F.filter(T.word_set(F.col(question)), lambda w: ~w.isin(*QUESTION_STOP) & (F.length(w) > 1))
    else:
        bonus, asked = F.lit(0.0), F.array().cast("array<string>")
    narrow = rows.select(by, key, page, kind, F.col(score).cast("double").alias(score), T.word_set(F.col(text)).alias("_words"), F.coalesce(bonus, F.lit(0.0)).alias("_bonus"), asked.alias("_asked"))
    return narrow.groupBy(by).applyInPandas(choose, f"{by} {types[by]}, position int, {key} {types[key]}")


def cover(rows: DataFrame, by: str, key: str, rank: str, facts: str, most: int | str, plan: str | None = None) -> DataFrame:
    """(by, position, key): for each fact the best row that has it, then the best of the rest up to `most`.

    plan: a column with the facts that the query asks for; they are taken in its order, others not. Without it all facts are, by name. most may be a column, too.
    """
    types = dict(rows.dtypes)

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values([rank, key]).reset_index(drop=True)
        taken, covered = [], set()
        limit = most if isinstance(most, int) else int(pool[most][0])
        there = {f for fs in pool[facts] for f in fs}
        wanted = sorted(there) if plan is None else [f for f in pool[plan][0] if f in there]
        for fact in wanted:
            if fact in covered or len(taken) >= limit:
                continue
            i = next(i for i in range(len(pool)) if fact in pool[facts][i])
            if i not in taken:
                taken.append(i)
            covered |= set(pool[facts][i])
        for i in range(len(pool)):
            if len(taken) < limit and i not in taken:
                taken.append(i)
        return pd.DataFrame({by: pool[by].iloc[0], "position": range(1, len(taken) + 1), key: [pool[key][i] for i in taken]})

    return rows.select(by, key, rank, facts, *([plan] if plan else []), *([most] if isinstance(most, str) else [])).groupBy(by).applyInPandas(choose, f"{by} {types[by]}, position int, {key} {types[key]}")
