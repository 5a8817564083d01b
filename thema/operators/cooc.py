"""Token co-occurrence in windows, marginals and positive pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_pairs(docs: DataFrame, window: int, tokens: str = "tokens") -> DataFrame:
    """(item_id, u, v): each token with every one of the `window` after it, from arrays of an item's tokens.

    The right neighbours of a position are a slice of its own row's array: no self join, no shuffle."""
    placed = docs.select("item_id", F.col(tokens).alias("tokens"), F.posexplode(tokens).alias("pos", "u"))
    return placed.select("item_id", "u", F.explode(F.slice("tokens", F.col("pos") + 2, window)).alias("v"))


def cooccurrence(pairs: DataFrame, symmetric: bool = False) -> DataFrame:
    """(u, v, tf, df). Both directions of each pair count one; with symmetric storage only (least, greatest), a pair of equal
    tokens two."""
    if symmetric:
        both = pairs.select("item_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.when(F.col("u") == F.col("v"), 2).otherwise(1).alias("c"))
    else:
        ends = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
        both = pairs.select("item_id", ends.alias("e")).select("item_id", F.col("e.a").alias("u"), F.col("e.b").alias("v"), F.lit(1).alias("c"))
    per_item = both.groupBy("u", "v", "item_id").agg(F.sum("c").alias("c"))
    return per_item.groupBy("u", "v").agg(F.sum("c").alias("tf"), F.count(F.lit(1)).alias("df"))


def marginals(pairs: DataFrame, docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(u, n_tf, n_df): pairs with u, both directions, and items with u."""
    tf = pairs.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n_tf"))
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n_df"))
    return df.join(tf, "u", "left").fillna(0, ["n_tf"]).select("u", "n_tf", "n_df")


def selected(cooc: DataFrame, min_tf: int = 0, min_df: int = 0) -> DataFrame:
    """Pairs of different tokens with enough occurrences."""
    return cooc.where((F.col("u") != F.col("v")) & (F.col("tf") >= min_tf) & (F.col("df") >= min_df))


def ppmi(cooc: DataFrame, margins: DataFrame, measure: str, total: DataFrame) -> DataFrame:
    """(u, v, value): ln(n * n_uv / (n_u * n_v)) where it is positive. measure: tf or df; total: one row with the column n."""
    u = margins.select("u", F.col(f"n_{measure}").alias("n_u"))
    v = margins.select(F.col("u").alias("v"), F.col(f"n_{measure}").alias("n_v"))
    ratio = (F.col("n") / F.col("n_u")) / (F.col("n_v") / F.col(measure))
    out = cooc.join(u, "u").join(v, "v").crossJoin(F.broadcast(total.select("n"))).withColumn("ratio", ratio)
    return out.where("ratio > 1").select("u", "v", F.log("ratio").alias("value"))


def bag_pairs(bow: DataFrame) -> DataFrame:
    """(u, v, value) over whole items: the sum of the smaller of both weights, u < v."""
    a, b = bow.select("item_id", F.col("token").alias("u"), F.col("weight").alias("a")), bow.select("item_id", F.col("token").alias("v"), F.col("weight").alias("b"))
    return a.join(b, "item_id").where("u < v").groupBy("u", "v").agg(F.sum(F.least("a", "b")).alias("value"))


def seen_pairs(docs: DataFrame, window: int = 0) -> DataFrame:
    """(u, v, value) from (item_id, tokens, weights): for each token and every one of the window - 1 after it (all of the item for 0), the sum of the
    smaller of both weights. A pair stands in the direction in which it was seen first, by item and position."""
    placed = docs.select("item_id", "tokens", "weights", F.posexplode("tokens").alias("i", "u")).withColumn("a", F.element_at("weights", F.col("i") + 1))
    count = F.size("tokens") if window <= 0 else F.lit(max(0, window - 1))
    ahead = F.arrays_zip(F.slice("tokens", F.col("i") + 2, count).alias("v"), F.slice("weights", F.col("i") + 2, count).alias("b"))
    pairs = placed.select("item_id", "i", "u", "a", F.posexplode(ahead).alias("j", "x")).select("item_id", "i", "j", "u", F.col("x.v").alias("v"), F.least("a", "x.b").alias("w"))
    key = [F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")]
    out = pairs.groupBy(*key).agg(F.sum("w").alias("value"), F.min_by("u", F.struct("item_id", "i", "j")).alias("u"))
    return out.select("u", F.when(F.col("u") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("v"), "value")
