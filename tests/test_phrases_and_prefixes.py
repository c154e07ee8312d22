"""Phrases that touch or overlap, and joined texts whose cut falls into a joiner."""

from pyspark.sql import functions as F

from docloom.operators import metrics as M
from docloom.operators import selection as S


def test_phrases_that_touch_or_overlap(spark):
    cases = [("thingthing", "thing", False), ("a thingthing thing", "thing", True), ("xa a a", "a a", True), ("xa ab", "a a", False), ("(thing)", "thing", True), (r"a\E.b", r"\E.", False), (r"a \E. b", r"\E.", True), ("", "a", False), ("a", "", False), ("++", "+", True)]
    rows = spark.createDataFrame(cases, "t string, p string, want boolean")
    assert [r for r in rows.withColumn("got", M.holds_phrase(F.col("t"), F.col("p"))).collect() if r.got != r.want] == []


def test_a_cut_within_a_joiner(spark):
    texts = ["abc", "de", "fghij", "k"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g long, i long, t string")
    for most in range(1, 18):
        assert S.joined_prefix(rows, ["g"], [F.asc("i")], "t", "--", most).first()["text"] == "--".join(texts)[:most], most
