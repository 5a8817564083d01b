"""Scores as aggregations over long tables; each gives a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EPS, TINY
from .estep import likelihoods
from .matrix import KEY, top_tokens


def perplexity(ndw: DataFrame, phi: DataFrame, theta: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(perplexity, raw, normalizer, zero_words): exp(-sum n ln p / sum n). A token outside the model has p = the sum of the item's
    Theta; a tiny p is replaced by the dictionary's value, or the token's share of its item."""
    p = likelihoods(ndw, phi, theta)
    known = phi.select("class_id", "token").distinct()
    mass = theta.groupBy("item_id").agg(F.sum("value").alias("p"))
    other = ndw.join(known, ["class_id", "token"], "left_anti").join(mass, "item_id")
    every = p.unionByName(other.select(p.columns)).withColumn("n_d", F.sum("weight").over(Window.partitionBy("item_id")))
    unigram = F.col("weight") / F.col("n_d")
    if dictionary is not None:
        every = every.join(dictionary.select("class_id", "token", F.col("value").alias("d")), ["class_id", "token"], "left")
        unigram = F.when(F.col("d") > 0, F.col("d")).otherwise(unigram)
    zero = F.abs("p") < TINY
    sums = every.agg(F.sum(F.col("weight") * F.log(F.when(zero, unigram).otherwise(F.col("p")))).alias("raw"), F.sum("weight").alias("normalizer"), F.sum(zero.cast("long")).alias("zero_words"))
    return sums.select(F.exp(-F.col("raw") / F.col("normalizer")).alias("perplexity"), "raw", "normalizer", "zero_words")


def sparsity_theta(theta: DataFrame, eps: float = EPS) -> DataFrame:
    s = theta.agg(F.sum((F.abs("value") < eps).cast("long")).alias("zero_topics"), F.count(F.lit(1)).alias("total_topics"))
    return s.withColumn("value", F.col("zero_topics") / F.col("total_topics"))


def sparsity_phi(phi: DataFrame, class_id: str, eps: float = EPS) -> DataFrame:
    s = phi.where(F.col("class_id") == class_id).agg(F.sum((F.abs("value") < eps).cast("long")).alias("zero_tokens"), F.count(F.lit(1)).alias("total_tokens"))
    return s.withColumn("value", F.col("zero_tokens") / F.col("total_tokens"))


def items_processed(ndw: DataFrame, items: DataFrame, phi: DataFrame) -> DataFrame:
    """(num_items, token_weight, token_weight_in_effect): all tokens, and those in the model."""
    known = phi.select("class_id", "token").distinct()
    inside = ndw.join(known, ["class_id", "token"], "left_semi").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("token_weight_in_effect"))
    return items.agg(F.count(F.lit(1)).alias("num_items")).crossJoin(ndw.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("token_weight"))).crossJoin(inside)


def coherence(ranked: DataFrame, cooc: DataFrame) -> DataFrame:
    """(topic, coherence) of (topic, rank, token): 2 / (k (k-1)) times the sum of cooc values of ordered pairs; 0 for k < 2."""
    a = ranked.select("topic", F.col("rank").alias("i"), F.col("token").alias("u"))
    b = ranked.select("topic", F.col("rank").alias("j"), F.col("token").alias("v"))
    found = a.join(b, "topic").where("i < j").join(cooc.select("u", "v", F.col("value").alias("c")), ["u", "v"]).groupBy("topic").agg(F.sum("c").alias("s"))
    k = ranked.groupBy("topic").agg(F.count(F.lit(1)).alias("k"))
    return k.join(found, "topic", "left").select("topic", F.when(F.col("k") > 1, 2.0 / (F.col("k") * (F.col("k") - 1)) * F.coalesce("s", F.lit(0.0))).otherwise(0.0).alias("coherence"))


def top_tokens_coherence(phi: DataFrame, cooc: DataFrame, k: int = 10, class_id: str | None = None) -> DataFrame:
    return coherence(top_tokens(phi, k, EPS, class_id).where("value > 0"), cooc)


def kernel_members(phi: DataFrame, nwt: DataFrame, class_id: str, threshold: float = 0.1) -> DataFrame:
    """(topic, token, p_wt, p_tw) of the tokens with p(t|w) of at least threshold."""
    mass = nwt.where(F.col("class_id") == class_id).groupBy("topic").agg(F.sum("value").alias("n_t"))
    q = phi.where(F.col("class_id") == class_id).join(F.broadcast(mass), "topic").withColumn("q", F.col("value") * F.col("n_t"))
    s = F.sum("q").over(Window.partitionBy("token"))
    return q.withColumn("p_tw", F.when(s > 0, F.col("q") / s).otherwise(0.0)).where(F.col("p_tw") >= threshold).select("topic", "token", F.col("value").alias("p_wt"), "p_tw")


def topic_kernel(phi: DataFrame, nwt: DataFrame, class_id: str, threshold: float = 0.1) -> DataFrame:
    """(topic, size, purity, contrast) of topics with a kernel."""
    members = kernel_members(phi, nwt, class_id, threshold)
    return members.groupBy("topic").agg(F.count(F.lit(1)).alias("size"), F.sum("p_wt").alias("purity"), F.avg("p_tw").alias("contrast"))


def topic_mass(m: DataFrame, class_id: str, topics: list | None = None) -> DataFrame:
    """(topic, mass, ratio) of selected topics; ratio over all topics."""
    s = m.where(F.col("class_id") == class_id).groupBy("topic").agg(F.sum("value").alias("mass"))
    s = s.crossJoin(F.broadcast(s.agg(F.sum("mass").alias("all")))).select("topic", "mass", (F.col("mass") / F.col("all")).alias("ratio"))
    return s if topics is None else s.where(F.col("topic").isin(topics))


def class_precision(ndw: DataFrame, phi: DataFrame, theta: DataFrame, class_id: str) -> DataFrame:
    """(errors, total, value): whether an item's most probable token of the class (of equals the last by name) is among its own."""
    own = phi.where(F.col("class_id") == class_id).withColumnRenamed("value", "phi")
    p = theta.join(own, "topic").groupBy("item_id", "token").agg(F.sum(F.col("phi") * F.col("value")).alias("p"))
    best = p.groupBy("item_id").agg(F.max(F.struct("p", "token")).alias("b")).select("item_id", F.col("b.token").alias("token"))
    has = ndw.where(F.col("class_id") == class_id).select("item_id", "token").distinct().withColumn("has", F.lit(1))
    s = best.join(has, ["item_id", "token"], "left").agg(F.sum(F.when(F.col("has").isNull(), 1).otherwise(0)).cast("long").alias("errors"), F.count(F.lit(1)).alias("total"))
    return s.withColumn("value", 1 - F.col("errors") / F.col("total"))


def background_tokens(phi: DataFrame, nwt: DataFrame, class_id: str, delta: float = 0.5, direct: bool = True) -> DataFrame:
    """(token, kl) with KL(p(t) || p(t|w)), or the reverse, above delta."""
    mass = nwt.groupBy("topic").agg(F.sum("value").alias("n_t"))
    mass = mass.crossJoin(F.broadcast(mass.agg(F.sum("n_t").alias("n")))).select("topic", (F.col("n_t") / F.col("n")).alias("p_t"))
    q = phi.where(F.col("class_id") == class_id).join(F.broadcast(mass), "topic").withColumn("q", F.col("value") * F.col("p_t"))
    s = F.sum("q").over(Window.partitionBy("token"))
    q = q.withColumn("p_tw", F.when(s > 0, F.col("q") / s).otherwise(0.0)).where("p_tw > 0")
    term = F.col("p_t") * F.log(F.col("p_t") / F.col("p_tw")) if direct else F.col("p_tw") * F.log(F.col("p_tw") / F.col("p_t"))
    return q.groupBy("token").agg(F.sum(term).alias("kl")).where(F.col("kl") > delta)


def theta_snippet(theta: DataFrame, num_items: int = 10) -> DataFrame:
    """(slot, item_id, topic, value): slot = item_id mod num_items, the largest item_id of each slot."""
    slot = F.pmod(F.col("item_id"), F.lit(num_items))
    last = theta.groupBy(slot.alias("slot")).agg(F.max("item_id").alias("item_id"))
    return theta.join(F.broadcast(last), "item_id").select("slot", "item_id", "topic", "value")
