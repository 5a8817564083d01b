"""Sinks: dictionaries, matrices, Theta, predictions, co-occurrences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import numbered


def batch_code(number: F.Column) -> F.Column:
    """A six-letter name: base 26 from aaaaaa; an error beyond zzzzzz."""
    digits = [F.chr((F.floor(number / 26**i) % 26 + 97).cast("int")) for i in range(5, -1, -1)]
    return F.when(number < 26**6, F.concat(*digits)).otherwise(F.raise_error(F.lit("too many batches")).cast("string"))


def batch_guid(number: F.Column, salt: str) -> F.Column:
    """A name in the form of a UUID, from the batch's number and a salt of the collection."""
    return F.regexp_replace(F.md5(F.concat(F.lit(salt), number.cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def write_batches(docs: DataFrame, path: str, size: int = 1000, number: str = "item_id", names: str = "code") -> None:
    """Documents in a folder for each batch of `size` consecutive ones in the order of `number`, whatever gaps the numbers have.
    names: "code", six letters in that order, or "guid"."""
    ids = numbered(docs.select(F.col(number).alias("_id")).distinct(), "_number", F.shiftright("_id", 20), [F.col("_id")])
    own = docs.join(ids, docs[number] == ids["_id"]).withColumn("_number", F.floor(F.col("_number") / size))
    name = batch_code(F.col("_number")) if names == "code" else batch_guid(F.col("_number"), uuid.uuid4().hex)
    own.withColumn("batch_id", name).drop("_id", "_number").repartition("batch_id").write.partitionBy("batch_id").parquet(path)


def read_batches(spark, path: str) -> DataFrame:
    """Batches again; files that can't be read are skipped."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path)


def write_dictionary(d: DataFrame, path: str) -> None:
    """As Parquet; refuses to overwrite."""
    d.write.mode("errorifexists").parquet(path)


def dictionary_text(d: DataFrame, name: str, num_items: int) -> list[str]:
    """The first two lines of the text form and its rows, by class and token."""
    rows = d.orderBy("class_id", "token").select(F.concat_ws(", ", "token", "class_id", "value", "tf", "df").alias("x")).toLocalIterator()
    return [f"name: {name} num_items: {num_items}", "token, class_id, token_value, token_tf, token_df", *(r["x"] for r in rows)]


def read_dictionary_text(spark, path: str) -> tuple[DataFrame, int]:
    """(dictionary, num_items) of the text form."""
    lines = spark.read.text(path)
    head = lines.first()["value"]
    f = lines.where(~F.col("value").startswith("name: ") & ~F.col("value").startswith("token, class_id")).select(F.split("value", ", ").alias("f"))
    columns = [F.element_at("f", i + 1).cast(t).alias(n) for i, (n, t) in enumerate((("token", "string"), ("class_id", "string"), ("value", "double"), ("tf", "double"), ("df", "double")))]
    return f.select(*columns), int(head.rpartition("num_items: ")[2])


def write_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.option("header", True).csv(path, sep=sep)


def wide(long: DataFrame, keys: list[str], topics: list[str]) -> DataFrame:
    """A column for each topic from (keys, topic, value)."""
    return long.groupBy(*keys).pivot("topic", topics).agg(F.first("value")).fillna(0.0)


def theta_table(theta: DataFrame, topics: list[str]) -> DataFrame:
    """(id, title, topics...) by id from (item_id, title, theta)."""
    return theta.select(F.col("item_id").alias("id"), "title", *[F.element_at("theta", i + 1).alias(t) for i, t in enumerate(topics)]).orderBy("id")


def class_table(predictions: DataFrame) -> DataFrame:
    """(id, class): the most probable class, the first by name of equals."""
    best = F.min_by("class_token", F.struct(-F.col("p"), F.col("class_token")))
    return predictions.groupBy(F.col("item_id").alias("id")).agg(best.alias("class")).orderBy("id")


def cooc_lines(cooc: DataFrame, value: str) -> DataFrame:
    """Lines: u, then v:value of all its partners, by name."""
    pairs = F.array_sort(F.collect_list(F.struct("v", F.col(value).alias("x"))))
    return cooc.groupBy("u").agg(F.transform(pairs, lambda p: F.concat_ws(":", p["v"], p["x"])).alias("f")).select(F.concat_ws(" ", "u", F.array_join("f", " ")).alias("value"))


def cooc_triples(cooc: DataFrame, vocab: DataFrame, value: str = "value") -> DataFrame:
    """Lines "i j value" of pairs (u, v) with their numbers in vocab(word_id, token)."""
    u, v = vocab.select(F.col("word_id").alias("i"), F.col("token").alias("u")), vocab.select(F.col("word_id").alias("j"), F.col("token").alias("v"))
    return cooc.join(u, "u").join(v, "v").select(F.concat_ws(" ", "i", "j", value).alias("value"))


def parse_cooc(lines: DataFrame, symmetric: bool = False) -> DataFrame:
    """(class_u, u, class_v, v, value) of lines "[|class] u [|class] v:value ..."; of a repeated pair the first counts; symmetric adds the reverse
    of pairs that lack it."""
    from ..schema import DEFAULT_CLASS

    f = lines.select(F.monotonically_increasing_id().alias("line"), F.filter(F.split("value", "[ \t]"), lambda x: x != "").alias("f"))
    placed = f.select("line", F.posexplode("f").alias("pos", "e"))
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("pos")
    switch = F.when(F.col("e").startswith("|"), F.when(F.length("e") == 1, DEFAULT_CLASS).otherwise(F.expr("substring(e, 2)")))
    marked = placed.withColumn("class", F.coalesce(F.last(switch, ignorenulls=True).over(w), F.lit(DEFAULT_CLASS))).where(~F.col("e").startswith("|"))
    first = marked.withColumn("nth", F.row_number().over(w))
    u = first.where("nth = 1").select("line", F.col("class").alias("class_u"), F.col("e").alias("u"))
    v = first.where("nth > 1").select("line", "pos", F.col("class").alias("class_v"), F.substring_index("e", ":", 1).alias("v"), F.substring_index("e", ":", -1).cast("double").alias("value"))
    pairs = u.join(v, "line")
    keys = ["class_u", "u", "class_v", "v"]
    if symmetric:
        back = pairs.select("line", "pos", F.col("class_v").alias("class_u"), F.col("v").alias("u"), F.col("class_u").alias("class_v"), F.col("u").alias("v"), "value", F.lit(1).alias("late"))
        pairs = pairs.withColumn("late", F.lit(0)).unionByName(back)
    else:
        pairs = pairs.withColumn("late", F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("late", "line", "pos"))
    return pairs.withColumn("nth", nth).where("nth = 1").select(*keys, "value")
