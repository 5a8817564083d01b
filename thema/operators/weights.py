"""Weights of modalities and transaction types, and class prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by_name(column: str, weights: dict[str, float]):
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col(column)), F.lit(0.0))


def weighted(ndw: DataFrame, class_weights: dict[str, float] | None = None, type_weights: dict[str, float] | None = None) -> DataFrame:
    """Weights times those of their class and transaction type; a name that a non-empty map lacks weighs 0."""
    w = F.col("weight")
    if class_weights:
        w = w * _by_name("class_id", class_weights)
    if type_weights:
        w = w * _by_name("tt_name", type_weights)
    return ndw.withColumn("weight", w)


def predict_classes(phi: DataFrame, theta: DataFrame) -> DataFrame:
    """(item_id, class_token, p): p(c|d) for phi's tokens, the sum over topics of phi * theta."""
    own = phi.select("topic", F.col("token").alias("class_token"), F.col("value").alias("phi"))
    return theta.join(F.broadcast(own) if _few(phi) else own, "topic").groupBy("item_id", "class_token").agg(F.sum(F.col("phi") * F.col("value")).alias("p"))


def _few(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether df has at most so many rows."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows
