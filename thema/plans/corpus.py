"""The driver's tables as corpora, and closed-form start matrices that SQL can state too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import words
from ..schema import DEFAULT_CLASS
from ..storage import spread

TOPICS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(docs: DataFrame, item_id: str = "doc_id", class_id=DEFAULT_CLASS, split: Callable[[str], Column] = words) -> DataFrame:
    """(item_id, class_id, token), a row for each occurrence; split gives a text's tokens."""
    c = F.lit(class_id) if isinstance(class_id, str) else class_id
    own = spread(docs.select(F.col(item_id).alias("item_id"), c.alias("class_id"), "text"))
    return own.select("item_id", "class_id", F.explode(split("text")).alias("token"))


def bow(docs: DataFrame, item_id: str = "doc_id", class_id=DEFAULT_CLASS, split: Callable[[str], Column] = words) -> DataFrame:
    """(item_id, class_id, token, weight)."""
    return tokens(docs, item_id, class_id, split).groupBy("item_id", "class_id", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def conversation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, tokens), an item for each turn."""
    own = spread(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("item_id"), "text"))
    return own.select("item_id", words("text").alias("tokens"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, tokens), an item for each document, with words of all scripts."""
    own = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"))
    return own.select("item_id", words("text").alias("tokens"))


def text_bags(docs: DataFrame, item_id: str = "doc_id", scale: float = 1.0, empty: bool = False) -> DataFrame:
    """partitioned.bags() of texts; those without words only if empty."""
    from .partitioned import bags

    own = spread(docs.select(F.col(item_id).alias("item_id"), "text"))
    own = own if empty else own.where(F.col("text").rlike(r"[\p{L}\p{N}_]"))
    return bags(own.select("item_id", F.array(F.lit(DEFAULT_CLASS)).alias("classes"), F.array(words("text")).alias("lists")), scale)


def start_rows(dictionary: DataFrame) -> DataFrame:
    """(class_id, token, x): start_weights(), normalized, by row."""
    from ..operators.matrix import normalize

    rows = normalize(start_weights(dictionary)).groupBy("class_id", "token").agg(F.array_sort(F.collect_list(F.struct("topic", "value"))).alias("x"))
    return rows.select("class_id", "token", F.col("x.value").alias("x"))


def code(token: F.Column, topic: F.Column) -> F.Column:
    return (F.ascii(token) * 31 + F.length(token) * 7 + F.ascii(F.reverse(token)) * 13 + topic * 17) % 97


def start_weights(vocab: DataFrame, topics: int = TOPICS) -> DataFrame:
    """(class_id, token, topic, value) from letters and lengths; about a fifth are zeros."""
    grid = vocab.withColumn("topic", F.explode(F.sequence(F.lit(0), F.lit(topics - 1))))
    c = code(F.col("token"), F.col("topic"))
    return grid.select("class_id", "token", "topic", F.when(c < 20, 0.0).otherwise(c.cast("double")).alias("value"))


def start_counters(dictionary: DataFrame, topics: int = TOPICS) -> DataFrame:
    """n_wt as tf times a small number by first letter and topic."""
    grid = dictionary.withColumn("topic", F.explode(F.sequence(F.lit(0), F.lit(topics - 1))))
    return grid.select("class_id", "token", "topic", (F.col("tf") * ((F.ascii("token") * 5 + F.col("topic") * 3) % 11)).alias("value"))
