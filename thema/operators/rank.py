"""Global numbering without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str, bucket: Column, order: list[Column]) -> DataFrame:
    """df with numbers 0, 1, ... in the order (bucket, *order). Rows are sorted within buckets; offsets come from the buckets'
    counts, so only one row for each bucket gathers in a task."""
    own = df.withColumn("_bucket", bucket)
    counts = own.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    out = own.withColumn("_nth", nth).join(counts.select("_bucket", before.alias("_before")), "_bucket")
    return out.withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_bucket", "_before", "_nth")


def token_numbers(vocab: DataFrame, name: str = "token_idx") -> DataFrame:
    """Numbers of (class_id, token) in that order; buckets are classes with the tokens' first two characters."""
    return numbered(vocab, name, F.struct("class_id", F.substring("token", 1, 2).alias("p")), [F.col("token")])
