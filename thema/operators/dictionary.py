"""Gathering, filtering and summarizing dictionaries: plain DataFrame aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def gather(ndw: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """(class_id, token, value, tf, df): tf the sum of weights, df the number of items, value the share of tf
    within the class. With vocab(class_id, token): its tokens, zeros for those not in the data; value's
    denominator still holds all tokens of the class."""
    per_item = ndw.groupBy("class_id", "token", "item_id").agg(F.sum("weight").alias("w"))
    d = per_item.groupBy("class_id", "token").agg(F.sum("w").alias("tf"), F.count(F.lit(1)).cast("double").alias("df"))
    d = with_share(d)
    if vocab is not None:
        d = vocab.select("class_id", "token").join(d, ["class_id", "token"], "left").fillna(0.0, ["value", "tf", "df"])
    return d.select("class_id", "token", "value", "tf", "df")


def gather_lists(docs: DataFrame, class_id: str) -> DataFrame:
    """gather() of one class from (item_id, tokens) with a row for each item: what an item holds is counted in its row, so the
    partial sums alone are shuffled."""
    one, none = F.lit(1.0), F.lit(0.0)
    every = docs.select(F.explode("tokens").alias("token"), one.alias("tf"), none.alias("df"))
    once = docs.select(F.explode(F.array_distinct("tokens")).alias("token"), none.alias("tf"), one.alias("df"))
    d = every.unionAll(once).groupBy(F.lit(class_id).alias("class_id"), "token").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    return with_share(d).select("class_id", "token", "value", "tf", "df")


def with_share(d: DataFrame) -> DataFrame:
    """d with tf's share of its class in value; the classes' sums are partial aggregates, joined back. d is written, so that the corpus is
    read once for both."""
    d = written(d)
    sums = d.groupBy("class_id").agg(F.sum("tf").alias("s"))
    return d.join(sums, "class_id").withColumn("value", F.col("tf") / F.col("s")).drop("s")


def filtered(
    d: DataFrame, class_id: str | None = None, min_df: float | None = None, max_df: float | None = None, min_df_rate: float | None = None, max_df_rate: float | None = None,
    min_tf: float | None = None, max_tf: float | None = None, num_items: float | None = None, max_size: int | None = None, recalculate_value: bool = False,
) -> DataFrame:
    """Entries with every measure at or above its lower and below its upper bound; with class_id, bounds hold for that
    class only. max_size: if more remain, those above the df of the first one too many (ties at it all go).
    recalculate_value: tf over the sum of tf of what remains, all classes together."""
    keep = F.lit(True)
    for column, low, high in (("df", min_df, max_df), ("tf", min_tf, max_tf)):
        if low is not None:
            keep &= F.col(column) >= low
        if high is not None:
            keep &= F.col(column) < high
    if min_df_rate is not None:
        keep &= F.col("df") >= min_df_rate * num_items
    if max_df_rate is not None:
        keep &= F.col("df") < max_df_rate * num_items
    out = d.where(keep if class_id is None else (F.col("class_id") != class_id) | keep)
    if max_size is not None:
        if max_size <= 0:
            raise ValueError("max_size must be positive")
        # The df of the first entry too many, from counts by df: small whatever the vocabulary.
        by_df = out.groupBy("df").agg(F.count(F.lit(1)).alias("n"))
        above = F.sum("n").over(Window.orderBy(F.col("df").desc()))
        cut = by_df.withColumn("upto", above).where(F.col("upto") > max_size).agg(F.max("df").alias("cut"))
        out = out.crossJoin(F.broadcast(cut)).where(F.col("cut").isNull() | (F.col("df") > F.col("cut"))).drop("cut")
    if recalculate_value:
        s = out.agg(F.sum("tf").alias("s"))
        out = out.crossJoin(F.broadcast(s)).withColumn("value", F.col("tf") / F.col("s")).drop("s")
    return out.select("class_id", "token", "value", "tf", "df")


def filter_cooc(cooc: DataFrame, d: DataFrame) -> DataFrame:
    """Pairs whose both ends are in the dictionary."""
    ends = d.select("class_id", "token")
    for side in ("u", "v"):
        cooc = cooc.join(ends.withColumnsRenamed({"class_id": f"class_{side}", "token": side}), [f"class_{side}", side], "left_semi")
    return cooc


def class_summary(d: DataFrame) -> DataFrame:
    """Number of entries and their tf by class."""
    return d.groupBy("class_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("tf").alias("tf"))


def collection_stats(ndw: DataFrame, items: DataFrame) -> DataFrame:
    """One row: num_items, dictionary_size, num_tokens, total_token_weight."""
    vocabulary = ndw.groupBy("class_id", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    measures = vocabulary.agg(F.count(F.lit(1)).alias("dictionary_size"), F.sum("n").alias("num_tokens"), F.sum("w").alias("total_token_weight"))
    return items.agg(F.count(F.lit(1)).alias("num_items")).crossJoin(measures)
