"""Plain texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import words


def text_to_counts(docs: DataFrame, split: Callable[[str], Column] = words) -> DataFrame:
    """(token, n) over all texts."""
    return docs.select(F.explode(split("text")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
