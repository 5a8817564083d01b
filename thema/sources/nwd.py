"""Token-by-document count matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schema import DEFAULT_CLASS


def from_dense(spark: SparkSession, n_wd: np.ndarray, vocabulary: dict[int, str]) -> DataFrame:
    """(item_id, class_id, token, weight) of a matrix with tokens as rows; values of at most 1e-37 are left out."""
    row, column = np.nonzero(np.asarray(n_wd) > 1e-37)
    return from_triples(spark, row, column, np.asarray(n_wd)[row, column], vocabulary)


def from_triples(spark: SparkSession, row, column, value, vocabulary: dict[int, str]) -> DataFrame:
    """The same from coordinates (row of the token, column of the document, value)."""
    value = np.asarray(value, float)
    keep = value > 1e-37
    tokens = [vocabulary[int(r)] for r in np.asarray(row)[keep]]
    own = {"item_id": pa.array(np.asarray(column)[keep].astype(np.int64)), "class_id": pa.array([DEFAULT_CLASS] * len(tokens)), "token": pa.array(tokens, pa.string()), "weight": pa.array(value[keep])}
    return spark.createDataFrame(pa.table(own))
