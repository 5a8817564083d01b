"""Vowpal Wabbit lines: title, then fields token[:weight], |class, ||type and ||.

|class switches the modality, a bare | to the default. || closes a transaction of all tokens since the
last close; ||type first closes those as single-token transactions of the type so far, then switches the
type. Both reset the modality. The line's end closes single tokens. Lines of fewer than two fields are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import elements, token_of, underscored, weight_of
from ..schema import DEFAULT_CLASS, DEFAULT_TRANSACTION, NDW


def parse_line(line: str) -> tuple[str, list[tuple[int, str, str, str, float]]]:
    """Title and (transaction, type, class, token, weight) of all tokens, in order."""
    fields = [f for f in line.replace("\t", " ").replace("\r", " ").split(" ") if f]
    if len(fields) < 2:
        raise ValueError(f"too few fields in line {line!r}")
    out: list[tuple[int, str, str, str, float]] = []
    held: list[tuple[str, str, float]] = []
    kind, cls, tx = DEFAULT_TRANSACTION, DEFAULT_CLASS, 0

    def close(together: bool) -> None:
        nonlocal tx
        for c, t, w in held:
            out.append((tx, kind, c, t, w))
            tx += not together
        tx += together and bool(held)
        held.clear()

    for f in fields[1:]:
        if f.startswith("||"):
            close(f == "||")
            kind = f[2:] or kind
            cls = DEFAULT_CLASS
        elif f.startswith("|"):
            cls = f[1:] or DEFAULT_CLASS
        else:
            token, colon, weight = f.partition(":")
            if not token or colon and not weight:
                raise ValueError(f"bad token {f!r}")
            held.append((cls, token, float(weight) if colon else 1.0))
    close(False)
    return fields[0], out


def parse_transactions(lines: DataFrame) -> DataFrame:
    """lines(item_id, value) under the whole grammar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, line in zip(batch["item_id"], batch["value"]):
                title, parsed = parse_line(line)
                rows += [(item, title, i, *x) for i, x in enumerate(parsed)]
            yield pd.DataFrame(rows, columns=["item_id", "title", "pos", "tx_id", "tt_name", "class_id", "token", "weight"])

    return lines.select("item_id", "value").mapInPandas(run, NDW)


def parse_vw(lines: DataFrame) -> DataFrame:
    """lines(item_id, value) without transactions, JVM-side: (item_id, title, pos, class_id, token, weight)."""
    own = lines.select("item_id", elements("value").alias("f"))
    rest = F.when(F.size("f") < 2, F.raise_error(F.lit("too few fields in a line")).cast("array<string>")).otherwise(F.slice("f", 2, F.size("f")))
    placed = own.select("item_id", F.try_element_at("f", F.lit(1)).alias("title"), F.posexplode(rest).alias("pos", "e"))
    switch = F.when(F.col("e").startswith("|"), F.when(F.length("e") == 1, DEFAULT_CLASS).otherwise(F.expr("substring(e, 2)")))
    w = Window.partitionBy("item_id").orderBy("pos")
    marked = placed.withColumn("class_id", F.coalesce(F.last(switch, ignorenulls=True).over(w), F.lit(DEFAULT_CLASS)))
    return marked.where(~F.col("e").startswith("|")).select("item_id", "title", "pos", "class_id", token_of(F.col("e")).alias("token"), weight_of(F.col("e")).alias("weight"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, value): lines with growing numbers; consecutive from 0 for a file of one split."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("item_id"), "value")


def read_vw(spark: SparkSession, path: str, transactions: bool = False) -> DataFrame:
    lines = read_lines(spark, path)
    return parse_transactions(lines) if transactions else parse_vw(lines)


def vw_lines(ndw: DataFrame) -> DataFrame:
    """(title, value): a line for each item, tokens by class and name, a class named where it changes;
    weights other than 1 are written out in full. Blanks and tabs become underscores."""
    number = F.when(F.col("weight") == F.col("weight").cast("long"), F.col("weight").cast("long").cast("string")).otherwise(F.col("weight").cast("string"))
    field = F.when(F.col("weight") == 1, underscored("token")).otherwise(F.concat(underscored("token"), F.lit(":"), number))
    items = ndw.select("title", "item_id", F.struct("class_id", field.alias("field")).alias("x")).groupBy("item_id", "title").agg(F.array_sort(F.collect_list("x")).alias("a"))
    default = F.struct(F.lit(DEFAULT_CLASS).alias("class_id"), F.lit("").alias("field"))
    pairs = F.zip_with("a", F.concat(F.array(default), F.slice("a", 1, F.size("a") - 1)), lambda x, y: F.when(x["class_id"] == y["class_id"], x["field"]).otherwise(F.concat(F.lit("|"), x["class_id"], F.lit(" "), x["field"])))
    return items.select("title", F.concat_ws(" ", underscored("title"), F.array_join(pairs, " ")).alias("value"))
