"""Operators on long model matrices (class_id, token, topic, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flushed
from ..schema import EPS

KEY = ["class_id", "token", "topic"]


def normalize(nwt: DataFrame, rwt: DataFrame | None = None) -> DataFrame:
    """p = max(n + r, 0) over its sum within class and topic; zeros where the sum isn't positive; tiny values as zero."""
    m = nwt
    if rwt is not None:
        m = m.join(rwt.select(*KEY, F.col("value").alias("r")), KEY, "left").select(*KEY, (F.col("value") + F.coalesce("r", F.lit(0.0))).alias("value"))
    m = m.withColumn("value", F.greatest("value", F.lit(0.0)))
    # Sums are partial aggregates, and few: adaptive execution sends them to the rows, as it knows their size.
    sums = m.groupBy("class_id", "topic").agg(F.sum("value").alias("s"))
    return m.join(sums, ["class_id", "topic"]).select(*KEY, flushed(F.when(F.col("s") > 0, F.col("value") / F.col("s")).otherwise(0.0)).alias("value"))


def merge(sources: list[tuple[DataFrame, float]], topics: list[str] | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """The weighted sum of matrices; what one lacks counts zero there. With a dictionary exactly its tokens,
    else the union; topics: those named."""
    every = reduce(DataFrame.unionByName, [m.select(*KEY, (F.col("value") * w).alias("value")) for m, w in sources])
    if topics is not None:
        every = every.where(F.col("topic").isin(topics))
    out = every.groupBy(*KEY).agg(F.sum("value").alias("value"))
    if dictionary is not None:
        names = every.select("topic").distinct() if topics is None else every.sparkSession.createDataFrame([(t,) for t in topics], "topic string")
        grid = dictionary.select("class_id", "token").crossJoin(F.broadcast(names))
        out = grid.join(out, KEY, "left").fillna(0.0, ["value"])
    return out


def topic_mass(m: DataFrame, by_class: bool = True) -> DataFrame:
    """Sums of positive values by topic (and class)."""
    return m.groupBy(*(["class_id"] if by_class else []), "topic").agg(F.sum(F.greatest("value", F.lit(0.0))).alias("n_t"))


def sparse(m: DataFrame, eps: float = EPS) -> DataFrame:
    """Values of absolute size above eps."""
    return m.where(F.abs("value") > eps)


def project(m: DataFrame, topics: list[str] | None = None, classes: list[str] | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """Named topics, classes and tokens(class_id, token) of a matrix; unknown tokens are skipped."""
    if topics is not None:
        m = m.where(F.col("topic").isin(topics))
    if classes is not None:
        m = m.where(F.col("class_id").isin(classes))
    return m if tokens is None else m.join(tokens, ["class_id", "token"], "left_semi")


def top_tokens(m: DataFrame, k: int = 10, eps: float = EPS, class_id: str | None = None) -> DataFrame:
    """(topic, rank, token, value): per topic the k largest values of at least eps, of equals the greater token first."""
    own = m.where(F.col("value") >= eps)
    if class_id is not None:
        own = own.where(F.col("class_id") == class_id)
    w = Window.partitionBy("topic").orderBy(F.col("value").desc(), F.col("token").desc())
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("topic", "rank", "token", "value")


def argmax(theta: DataFrame) -> DataFrame:
    """(item_id, topic): the largest value's topic, the first of equals; the first topic if none is positive."""
    best = F.max(F.struct(F.greatest("value", F.lit(0.0)).alias("value"), (-F.col("topic").cast("long")).alias("order")))
    return theta.groupBy("item_id").agg(best.alias("b")).select("item_id", (-F.col("b.order")).alias("topic"))
