"""Phi regularizers on long matrices: each gives (class_id, token, topic, value), the term before tau.

p and n are the matrices p_wt and n_wt. topics and classes restrict where a term applies; None is all.
A regularizer gives rows only where it has a term; everything else counts as zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import sign_or_minus, transformed
from .matrix import KEY


def _some(m: DataFrame, topics: list | None, classes: list[str] | None) -> DataFrame:
    if topics is not None:
        m = m.where(F.col("topic").isin(topics))
    return m if classes is None else m.where(F.col("class_id").isin(classes))


def smooth_sparse(p: DataFrame, dictionary: DataFrame | None = None, topics: list | None = None, classes: list[str] | None = None, kind: str = "constant", a: float = 1.0, n: float = 1.0) -> DataFrame:
    """The dictionary's value (1 without one) times f(p); tokens absent from the dictionary are left out."""
    own = _some(p, topics, classes)
    f = transformed(F.col("value"), kind, a, n)
    if dictionary is None:
        return own.select(*KEY, f.alias("value"))
    d = dictionary.select("class_id", "token", F.col("value").alias("d"))
    return own.join(d, ["class_id", "token"]).select(*KEY, (F.col("d") * f).alias("value"))


def decorrelator(p: DataFrame, topics: list | None = None, classes: list[str] | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """-p_wt times the sum of the token's other selected topics. With pairs(first, second, weight): only for first topics,
    weighted sums over their second ones, less p_wt itself."""
    if pairs is None:
        own = _some(p, topics, classes)
        s = F.sum("value").over(Window.partitionBy("class_id", "token"))
        return own.select(*KEY, (-F.col("value") * (s - F.col("value"))).alias("value"))
    own = _some(p, None, classes)
    second = own.withColumnsRenamed({"topic": "second", "value": "other"})
    sums = second.join(F.broadcast(pairs), "second").groupBy("class_id", "token", F.col("first").alias("topic")).agg(F.sum(F.col("weight") * F.col("other")).alias("s"))
    return own.join(sums, KEY).select(*KEY, (-F.col("value") * (F.col("s") - F.col("value"))).alias("value"))


def label(n: DataFrame, dictionary: DataFrame | None = None, topics: list | None = None, classes: list[str] | None = None) -> DataFrame:
    """The dictionary's value (0 if absent, 1 without a dictionary) times n_wt over the token's sum of selected topics; 0 for 0/0."""
    own = _some(n, topics, classes)
    s = F.sum("value").over(Window.partitionBy("class_id", "token"))
    share = own.withColumn("share", F.when(s > 0, F.col("value") / s).otherwise(0.0))
    if dictionary is None:
        return share.select(*KEY, F.col("share").alias("value"))
    d = dictionary.select("class_id", "token", F.col("value").alias("d"))
    return share.join(d, ["class_id", "token"], "left").select(*KEY, (F.coalesce("d", F.lit(0.0)) * F.col("share")).alias("value"))


def specified_sparse(n: DataFrame, per: str = "topic", k: int = 20, threshold: float = 0.99, topics: list | None = None, class_id: str | None = None) -> DataFrame:
    """-n_wt outside the kept entries. Per topic (or token): of the k largest, the shortest prefix with at least `threshold`
    of the whole mass, all k if none has; of equals the greater token (topic) first."""
    own = _some(n, topics, None if class_id is None else [class_id])
    group, tie = (["class_id", "topic"], "token") if per == "topic" else (["class_id", "token"], "topic")
    w = Window.partitionBy(*group).orderBy(F.col("value").desc(), F.col(tie).desc())
    before = F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = own.select(*KEY, "value", F.row_number().over(w).alias("rank"), before.alias("before"), F.sum("value").over(Window.partitionBy(*group)).alias("all"))
    keep = (F.col("rank") <= k) & ((F.col("rank") == 1) | (F.col("before") < threshold * F.col("all")))
    return ranked.where(~keep).select(*KEY, (-F.col("value")).alias("value"))


def improve_coherence(n: DataFrame, cooc: DataFrame, topics: list | None = None, classes: list[str] | None = None) -> DataFrame:
    """The sum over cooc(class_id, u, v, value) with u = w of value * n_vt."""
    own = _some(n, topics, classes)
    return own.withColumnRenamed("value", "n").join(cooc.withColumnRenamed("v", "token"), ["class_id", "token"]).groupBy("class_id", F.col("u").alias("token"), "topic").agg(F.sum(F.col("value") * F.col("n")).alias("value"))


def biterms(p: DataFrame, n: DataFrame, cooc: DataFrame, topics: list | None = None, classes: list[str] | None = None) -> DataFrame:
    """The sum over u of cooc[w][u] times p(t | w, u), proportional to n_t p_wt p_ut, n_t over all classes."""
    mass = n.groupBy("topic").agg(F.sum("value").alias("n_t"))
    own = _some(p, topics, classes)
    u = own.select("class_id", F.col("token").alias("v"), "topic", F.col("value").alias("p_u"))
    q = own.withColumnsRenamed({"token": "u", "value": "p_w"}).join(cooc, ["class_id", "u"]).join(u, ["class_id", "v", "topic"]).join(F.broadcast(mass), "topic")
    q = q.withColumn("q", F.col("n_t") * F.col("p_w") * F.col("p_u"))
    s = F.sum("q").over(Window.partitionBy("class_id", "u", "v"))
    share = q.withColumn("x", F.when(s > 0, F.col("value") * F.col("q") / s).otherwise(0.0))
    return share.groupBy("class_id", F.col("u").alias("token"), "topic").agg(F.sum("x").alias("value"))


def smooth_time(p: DataFrame, class_id: str, topics: list | None = None) -> DataFrame:
    """For the tokens of the time modality but the first and last, in their order: p * (sgn(previous - p) + sgn(next - p)), sgn(0) = -1."""
    own = _some(p, topics, [class_id])
    w = Window.partitionBy("topic").orderBy("token")
    near = own.select(*KEY, F.col("value").alias("p"), F.lag("value").over(w).alias("a"), F.lead("value").over(w).alias("b"))
    return near.where("a IS NOT NULL AND b IS NOT NULL").select(*KEY, (F.col("p") * (sign_or_minus(F.col("a") - F.col("p")) + sign_or_minus(F.col("b") - F.col("p")))).alias("value"))


def net_plsa(p: DataFrame, n: DataFrame, class_id: str, vertices: DataFrame, edges: DataFrame, topics: list | None = None, symmetric: bool = False) -> DataFrame:
    """For a vertex u: n_t ** 2 / D_u times the sum over edges (u, v) of w * (p_v / D_v - p_u / D_u). vertices(token, d), edges(src, dst, w)."""
    if symmetric:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    own = _some(p, topics, [class_id])
    mass = n.where(F.col("class_id") == class_id).groupBy("topic").agg(F.sum("value").alias("n_t"))
    end = own.join(vertices, "token").select("token", "topic", (F.col("value") / F.col("d")).alias("x"), "d")
    u = end.select(F.col("token").alias("src"), "topic", F.col("x").alias("xu"), "d")
    v = end.select(F.col("token").alias("dst"), "topic", F.col("x").alias("xv"))
    r = edges.join(u, "src").join(v, ["dst", "topic"]).groupBy(F.col("src").alias("token"), "topic", "d").agg(F.sum(F.col("w") * (F.col("xv") - F.col("xu"))).alias("s"))
    return r.join(F.broadcast(mass), "topic").select(F.lit(class_id).alias("class_id"), "token", "topic", (F.col("n_t") * F.col("n_t") * F.col("s") / F.col("d")).alias("value"))


def relative(r: DataFrame, n: DataFrame, gamma: float) -> DataFrame:
    """A term scaled by class and topic: gamma * n_t / |R|_t + (1 - gamma) * n / |R|, sums over the term's topics."""
    size = r.groupBy("class_id", "topic").agg(F.sum(F.abs("value")).alias("r_t"))
    mass = n.groupBy("class_id", "topic").agg(F.sum("value").alias("n_t"))
    both = mass.join(size, ["class_id", "topic"])
    w = Window.partitionBy("class_id")
    overall = F.sum("n_t").over(w) / F.sum("r_t").over(w)
    coef = both.select("class_id", "topic", F.when(F.col("r_t") > 0, gamma * F.col("n_t") / F.col("r_t") + (1 - gamma) * overall).otherwise(0.0).alias("c"))
    return r.join(F.broadcast(coef), ["class_id", "topic"]).select(*KEY, (F.col("value") * F.col("c")).alias("value"))


def summed(terms: list[tuple[DataFrame, float]]) -> DataFrame:
    """The sum of terms by tau."""
    every = reduce(DataFrame.unionByName, [r.select(*KEY, (F.col("value") * tau).alias("value")) for r, tau in terms])
    return every.groupBy(*KEY).agg(F.sum("value").alias("value"))
