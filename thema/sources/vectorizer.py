"""Several sources as one corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_sources(sources: list[tuple[DataFrame, float]]) -> DataFrame:
    """The union of corpora with each one's weight in batch_weight."""
    return reduce(DataFrame.unionByName, [df.withColumn("batch_weight", F.lit(float(w))) for df, w in sources])


def only_classes(ndw: DataFrame, classes: list[str] | None) -> DataFrame:
    """Tokens of the named modalities; none named is all."""
    return ndw if not classes else ndw.where(F.col("class_id").isin(classes))


def topics_as_documents(nwt: DataFrame) -> DataFrame:
    """A parent model's topics as documents: (title, class_id, token, weight) with the positive counters as weights."""
    return nwt.where(F.col("value") > 0).select(F.col("topic").alias("title"), "class_id", "token", F.col("value").alias("weight"))
