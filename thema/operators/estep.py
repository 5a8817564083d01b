"""The relational E-step over long tables: for models too large for any task, and for checking the kernel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import flushed
from ..schema import TINY


def _joined(ndw: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """ndw with an array q of (topic, phi * theta) for tokens of the model. Phi's rows and Theta travel as arrays, so a token of a document
    is one row through both joins, and its sum over topics needs no shuffle."""
    p = phi.groupBy("class_id", "token").agg(F.collect_list(F.struct("topic", "value")).alias("p"))
    t = theta.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "value"))).alias("t"))
    q = F.transform("p", lambda x: F.struct(x["topic"].alias("topic"), (x["value"] * F.element_at("t", x["topic"])).alias("q")))
    return ndw.join(p, ["class_id", "token"]).join(t, "item_id").withColumn("q", q).drop("p", "t")


def _sum(q: str) -> F.Column:
    return F.aggregate(q, F.lit(0.0), lambda s, x: s + F.coalesce(x["q"], F.lit(0.0)))


def _responsibilities(ndw: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """ndw x topics with part = n * phi * theta / Z; terms with a tiny Z are left out."""
    own = _joined(ndw, phi, theta).withColumn("z", _sum("q")).where(F.abs("z") >= TINY)
    return own.withColumn("x", F.explode("q")).where("x.q IS NOT NULL").select("item_id", "class_id", "token", F.col("x.topic").alias("topic"), (F.col("weight") * F.col("x.q") / F.col("z")).alias("part"))


def uniform_theta(items: DataFrame, topics: list) -> DataFrame:
    """Equal shares for every item."""
    share = 1.0 / len(topics)
    return items.select("item_id", F.explode(F.array(*[F.lit(t) for t in topics])).alias("topic"), F.lit(share).alias("value"))


def theta_pass(ndw: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """Theta after one inner pass; an item without a token in the model keeps its values."""
    n_td = _responsibilities(ndw, phi, theta).groupBy("item_id", "topic").agg(F.sum("part").alias("n"))
    n_td = n_td.withColumn("s", F.sum("n").over(Window.partitionBy("item_id")))
    new = n_td.select("item_id", "topic", flushed(F.when(F.col("s") > 0, F.col("n") / F.col("s")).otherwise(0.0)).alias("new"))
    return theta.join(new, ["item_id", "topic"], "left").select("item_id", "topic", F.coalesce("new", "value").alias("value"))


def counters(ndw: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """n_wt under the given Phi and Theta."""
    return _responsibilities(ndw, phi, theta).groupBy("class_id", "token", "topic").agg(F.sum("part").alias("value"))


def likelihoods(ndw: DataFrame, phi: DataFrame, theta: DataFrame) -> DataFrame:
    """(item_id, class_id, token, weight, p) for tokens of the model."""
    return _joined(ndw, phi, theta).select("item_id", "class_id", "token", "weight", _sum("q").alias("p"))
