"""Names for SQL: table functions and string functions of this package."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class _Windows:
    def eval(self, text: str, size: int, overlap: int):
        from docloom.operators.chunking import cut

        for i, piece in enumerate(cut(text or "", size, overlap)):
            yield i, piece


class _Rows:
    def eval(self, markup: str):
        from docloom.operators.chunking import row_texts, tables_of

        for i, one in enumerate(tables_of(markup or "")):
            for j, text in enumerate(row_texts(one)):
                yield i, j, text


def register(spark: SparkSession) -> None:
    """text_windows(text, size, overlap) and markup_rows(markup) for LATERAL joins; fold_text(text) for expressions."""
    from docloom.functions.text import folded
    from docloom.session import ship

    ship(spark)
    spark.udtf.register("text_windows", F.udtf(_Windows, returnType="seq: int, text: string"))
    spark.udtf.register("markup_rows", F.udtf(_Rows, returnType="table_index: int, row_index: int, text: string"))

    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else folded(x))

    spark.udf.register("fold_text", F.pandas_udf(fold, "string"))
