"""UCI bag of words and MatrixMarket: vocabulary lines and (document, word, count) triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import elements
from ..operators.rank import token_numbers
from ..schema import DEFAULT_CLASS


def parse_vocab(lines: DataFrame) -> DataFrame:
    """lines(word_id, value) as (word_id, class_id, token). Lines that are empty or have more than two
    fields, and repeated tokens of a class, are errors."""
    own = lines.select("word_id", elements("value").alias("f"))
    checked = F.when(F.size("f").between(1, 2), F.element_at("f", 1)).otherwise(F.raise_error(F.lit("bad vocabulary line")).cast("string"))
    out = own.select("word_id", F.coalesce(F.try_element_at("f", F.lit(2)), F.lit(DEFAULT_CLASS)).alias("class_id"), checked.alias("token"))
    again = out.groupBy("class_id", "token").count().where("count > 1").take(1)
    if again:
        raise ValueError(f"token {again[0]['token']!r} is repeated in the vocabulary")
    return out


def parse_docword(lines: DataFrame, vocab: DataFrame, unity_based: bool = True) -> DataFrame:
    """Triple lines(value) as (item_id, class_id, token, weight). Lines that begin with % or hold one
    number (a header's) are skipped, zero counts dropped; other numbers of fields and unknown word ids are errors."""
    own = lines.where(~F.col("value").startswith("%")).select(F.filter(F.split("value", r"[ \t\r]+"), lambda x: x != "").alias("f")).where("size(f) > 1")
    number = lambda i: F.when(F.size("f") == 3, F.element_at("f", i).try_cast("double")).otherwise(F.raise_error(F.lit("bad triple")).cast("double"))
    triples = own.select(number(1).cast("long").alias("item_id"), (number(2).cast("long") - int(unity_based)).alias("word_id"), number(3).alias("weight")).where("weight <> 0")
    token = F.when(F.col("token").isNull(), F.raise_error(F.lit("word id outside the vocabulary")).cast("string")).otherwise(F.col("token"))
    return triples.join(vocab, "word_id", "left").select("item_id", "class_id", token.alias("token"), "weight")


def _head(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """The header's three numbers and how many lines it takes, with comments."""
    read, got = 1000, 0
    while True:  # comments may be long: more lines, until there are three numbers or no more lines
        lines, numbers = spark.read.text(path).head(read), []
        for i, row in enumerate(lines):
            if not row["value"].startswith("%"):
                numbers += [int(x) for x in row["value"].split()]
            if len(numbers) >= 3:
                if min(numbers) <= 0:
                    raise ValueError("a header's numbers must be positive")
                return numbers[:3], i + 1
        if len(lines) == got:
            raise ValueError("no header")
        read, got = 10 * read, len(lines)


def read_docword(spark: SparkSession, path: str, vocab: DataFrame | None = None, unity_based: bool = True) -> DataFrame:
    """A UCI or MatrixMarket file. Without a vocabulary tokens are named "0", "1", ..."""
    (_, words, _), lines = _head(spark, path)
    if vocab is None:
        vocab = spark.range(words).select(F.col("id").alias("word_id"), F.lit(DEFAULT_CLASS).alias("class_id"), F.col("id").cast("string").alias("token"))
    body = spark.read.text(path).withColumn("i", F.monotonically_increasing_id()).where(F.col("i") >= lines)
    return parse_docword(body.select("value"), vocab, unity_based)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A UCI vocabulary: a token by line. It is read in one split, so that line numbers are word ids."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("word_id", "value"))
    return parse_vocab(lines.withColumn("word_id", F.col("word_id").cast("long")))


def read_mm_vocab(spark: SparkSession, path: str) -> DataFrame:
    """MatrixMarket's vocabulary: id, token and a weight that is ignored."""
    f = spark.read.text(path).select(elements("value").alias("f")).where("size(f) > 0")
    return f.select(F.element_at("f", 1).cast("long").alias("word_id"), F.lit(DEFAULT_CLASS).alias("class_id"), F.element_at("f", 2).alias("token"))


def vocab_lines(ndw: DataFrame) -> DataFrame:
    """(word_id, value) of a corpus's vocabulary, by class and token."""
    return token_numbers(ndw.select("class_id", "token").distinct(), "word_id").select("word_id", F.concat_ws(" ", "token", "class_id").alias("value"))


def docword_lines(ndw: DataFrame, vocab: DataFrame) -> DataFrame:
    """Triple lines(value) of a corpus with the word ids of vocab_lines()."""
    ids = parse_vocab(vocab)
    return ndw.join(ids, ["class_id", "token"]).select(F.concat_ws(" ", "item_id", F.col("word_id") + 1, "weight").alias("value"))
