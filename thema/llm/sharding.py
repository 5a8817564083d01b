"""Reproducible global shuffle: a Feistel permutation of row numbers, with cycle walking.

Rows get global numbers in a fixed order (a bucket computed from doc_id, then doc_id), whatever the
partitioning. A balanced Feistel network permutes the least even-bit domain that holds all rows; a
result outside the table is permuted again until it falls inside. Shard and slot follow from the
position by arithmetic, and locate() / row_at() compute either from the other without any data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .place import free, placed, repeated

#: Buckets in which rows are numbered in parallel.
BUCKETS = 4096
ROUNDS = 4
#: Rows of a shard.
SHARD_ROWS = 1024
#: Shards in a folder.
SHARDS_PER_FOLDER = 4096
_M31 = (1 << 31) - 1


def round_keys(seed: int) -> list[int]:
    """31-bit keys of the rounds."""
    out, x = [], seed & _M31
    for _ in range(ROUNDS):
        x = (x * 1103515245 + 12345) & _M31
        x ^= x >> 15
        out.append(x)
    return out


@dataclass(frozen=True)
class Permutation:
    """A permutation of range(rows)."""

    rows: int
    seed: int = 0

    @property
    def half(self) -> int:
        """Bits of a half block, 31 at most: up to 2**62 rows."""
        half = max(1, (max(1, self.rows - 1).bit_length() + 1) // 2)
        if half > 31:
            raise ValueError("more than 2**62 rows")
        return half

    def _mixed(self, r: np.ndarray, key: int) -> np.ndarray:
        x = (r * 1103515245 + key) & _M31
        x ^= x >> 15
        x = (x * 747796405) & _M31
        x ^= x >> 13
        return x & ((1 << self.half) - 1)

    def _once(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        low = (1 << self.half) - 1
        left, right = x >> self.half, x & low
        for key in reversed(round_keys(self.seed)) if inverse else round_keys(self.seed):
            if inverse:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return left << self.half | right

    def _walk(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.int64), inverse)
        out = np.flatnonzero(x >= self.rows)
        while len(out):
            x[out] = self._once(x[out], inverse)
            out = out[x[out] >= self.rows]
        return x

    def position(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, False)

    def row(self, position: np.ndarray) -> np.ndarray:
        return self._walk(position, True)

    def shards(self, shard_rows: int = SHARD_ROWS) -> int:
        return max(1, -(-self.rows // shard_rows))

    def locate(self, row: np.ndarray, shard_rows: int = SHARD_ROWS) -> tuple[np.ndarray, np.ndarray]:
        """Shard and slot of rows; shards' sizes differ by one at most."""
        p, n = self.position(row), self.shards(shard_rows)
        return p % n, p // n

    def row_at(self, shard: np.ndarray, slot: np.ndarray, shard_rows: int = SHARD_ROWS) -> np.ndarray:
        return self.row(np.asarray(slot, np.int64) * self.shards(shard_rows) + np.asarray(shard, np.int64))


def bucket_of(doc_id: Column) -> Column:
    """A bucket in 0 .. BUCKETS-1 by multiplicative hashing; 0 for null."""
    folded = F.pmod(doc_id, F.lit(1 << 31).cast("long"))
    return F.coalesce(F.shiftright((folded * 1103515245) % (1 << 31), 31 - (BUCKETS.bit_length() - 1)), F.lit(0)).cast("int")


def numbered(keys: DataFrame, name: str, bucket: Column, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """keys with a column of numbers 0, 1, ... in the order (bucket, *order), counted anew for each
    group of `within`. Rows are sorted within buckets only; a bucket's offset comes from the counts
    of the buckets before it, so nothing gathers in one task but one row per group and bucket."""
    within = within or []
    df = keys.withColumn("_bucket", bucket)
    counts = df.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*within, "_bucket").orderBy(*order)
    out = df.withColumn("_nth", F.row_number().over(inside)).join(offsets, [*within, "_bucket"])
    return out.withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_bucket", "_before", "_nth")


def _numbers(keys: DataFrame) -> DataFrame:
    """(doc_id, m, first) of all different doc_ids: their numbers of rows, and the number of the first of them. Rows that repeat a doc_id, or
    have none, are one row here."""
    same = keys.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).withColumn("bucket", bucket_of(_whole(keys)))
    counts = same.groupBy("bucket").agg(F.sum("m").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = same.withColumn("nth", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(offsets, "bucket")
    return out.select("doc_id", "m", (F.col("before") + F.col("nth")).alias("first"))


def _whole(keys: DataFrame) -> Column:
    """doc_id as a whole number: itself, or a hash of another type."""
    return F.col("doc_id").cast("long") if keys.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("doc_id")


def _at(permutation: Permutation, shard_rows: int, row: str) -> list[Column]:
    """Columns position, shard and slot of a row's number."""

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permutation.position(row.to_numpy()))

    n, p = permutation.shards(shard_rows), position(row)
    return [p.alias("position"), (p % n).alias("shard"), F.floor(p / n).cast("long").alias("slot")]


def shard_assignment(docs: DataFrame, seed: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, row, position, shard, slot) for every row of docs.

    Rows with a null doc_id come last in the first bucket; rows that repeat a doc_id get consecutive
    row numbers. doc_id may be of any type. Texts play no part, nor do other columns. An empty table gives an empty result.
    """
    keys = docs.select("doc_id")
    permutation = Permutation(keys.count(), seed)
    rows = repeated(_numbers(keys), "m", ["doc_id"]).select("doc_id", (F.col("first") + F.col("copy")).alias("row"))
    return rows.select("doc_id", "row", *_at(permutation, shard_rows, "row"))


def write_shards(docs: DataFrame, path: str, seed: int = 0, shard_rows: int = SHARD_ROWS, shards_per_folder: int = SHARDS_PER_FOLDER) -> None:
    """docs, all columns, written to path with their shards and slots, in columns _shard and _slot (with more underscores if docs has such), sorted by
    them. A folder, _shards=g, holds shards_per_folder shards, so that their number doesn't become one of files. Rows that repeat a doc_id share
    the shards and slots of that doc_id in the order of their places; those of null doc_ids likewise."""
    own, file, row = placed(docs)
    permutation = Permutation(docs.count(), seed)
    # Rows of one doc_id are numbered in buckets of their places, so that a frequent one isn't sorted in one task.
    keys = own.select(F.to_json(F.struct(F.col("doc_id"))).alias("id"), "doc_id", F.col(file).alias("file"), F.col(row).alias("row"))
    first = _numbers(keys).select(F.to_json(F.struct("doc_id")).alias("id"), "m", "first")
    both = keys.drop("doc_id").join(first, "id")
    many = numbered(both.where("m > 1"), "copy", F.pmod(F.xxhash64("file", "row"), F.lit(BUCKETS)).cast("int"), [F.col("file"), F.col("row")], ["id"])
    numbers = both.where("m = 1").select("file", "row", F.col("first").alias("n")).unionAll(many.select("file", "row", (F.col("first") + F.col("copy")).alias("n")))
    shard, slot, group = (free(docs, x) for x in ("_shard", "_slot", "_shards"))
    at = numbers.select(F.col("file").alias("f"), F.col("row").alias("r"), *_at(permutation, shard_rows, "n")[1:])
    out = own.join(at, (own[file] == at["f"]) & (own[row] == at["r"])).select(*[own[c] for c in docs.columns], at["shard"].alias(shard), at["slot"].alias(slot))
    out = out.withColumn(group, F.floor(F.col(shard) / shards_per_folder).cast("int"))
    out.repartition(group, shard).sortWithinPartitions(group, shard, slot).write.partitionBy(group).parquet(path)


def sharding_sql(seed: int = 0, shard_rows: int = SHARD_ROWS) -> str:
    """DuckDB SQL for shard_assignment(documents)."""
    k = round_keys(seed)
    keys = "CASE step % 4 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} ELSE {} END".format(*k)
    x0 = f"((r * 1103515245 + {keys}) & {_M31})"
    x1 = f"xor({x0}, {x0} >> 15)"
    x2 = f"(({x1} * 747796405) & {_M31})"
    x3 = f"xor({x2}, {x2} >> 13)"
    shift = 31 - (BUCKETS.bit_length() - 1)
    return f"""
WITH RECURSIVE b AS (
  SELECT doc_id, coalesce(((((doc_id % 2147483648 + 2147483648) % 2147483648) * 1103515245) % 2147483648) >> {shift}, 0) AS bucket FROM documents
), n AS (
  SELECT count(*) AS rows, greatest(1, CAST(ceil(count(*) / {shard_rows}.0) AS BIGINT)) AS shards,
         greatest(1, (length(ltrim(CAST(CAST(greatest(1, count(*) - 1) AS BIGINT) AS BIT)::VARCHAR, '0')) + 1) // 2) AS half FROM documents
), numbered AS (
  SELECT doc_id, row_number() OVER (ORDER BY bucket, doc_id NULLS LAST) - 1 AS row FROM b
), walk AS (
  SELECT row, 0 AS step, row >> n.half AS l, row & ((1::BIGINT << n.half) - 1) AS r FROM numbered, n
  UNION ALL
  SELECT row, step + 1, r, xor(l, {x3} & ((1::BIGINT << n.half) - 1))
  FROM walk, n WHERE NOT (step > 0 AND step % 4 = 0 AND (l << n.half | r) < n.rows)
), ended AS (
  SELECT row, (l << n.half | r) AS position FROM walk, n WHERE step > 0 AND step % 4 = 0 AND (l << n.half | r) < n.rows
)
SELECT doc_id, row, position, position % n.shards AS shard, position // n.shards AS slot FROM numbered JOIN ended USING (row), n
"""
