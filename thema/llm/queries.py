"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_dir

from .decontam import shared_spans
from .exact_dedup import exact_duplicates
from .langid import identify
from .langid import train as train_languages
from .near_dedup import near_duplicates
from .packing import pack_documents
from .ppm import score_language
from .quality import score_quality
from .sharding import shard_assignment, sharding_sql
from .text import WORD_PATTERN
from .url_filter import block_labels, score_urls
from .url_filter import train as train_urls
from .warc import pages_from_warc, read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id,
       row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS kept
FROM documents
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC files in the shared folder and read from there by byte ranges."""
    path = shared_dir(spark)
    write_warc(_table(spark, sf_dir, "pages"), path)
    return pages_from_warc(read_warc(spark, path))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_assignment(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return score_urls(pages, train_urls(pages.select("url", block_labels(pages["url"]).alias("label"))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train_languages(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(lower(text), '<word>') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(lower(text), '<word>') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(13, len(w)) AS n FROM b WHERE len(w) >= 8),
dg AS (SELECT doc_id, row, n, p, array_to_string(w[p + 1:p + n], ' ') AS g FROM (SELECT *, unnest(range(len(w) - n + 1)) AS p FROM d, sizes)),
bg AS (SELECT item_id, item, n, p AS q, array_to_string(w[p + 1:p + n], ' ') AS g FROM (SELECT *, unnest(range(len(w) - n + 1)) AS p FROM b JOIN sizes ON n = least(13, len(w)))),
h AS (SELECT doc_id, row, item_id, item, n, p, q, p - row_number() OVER (PARTITION BY row, item, p - q ORDER BY p) AS island FROM dg JOIN bg USING (n, g))
SELECT doc_id, item_id, min(p) AS doc_word, min(q) AS item_word, count(*) + n - 1 AS words FROM h GROUP BY doc_id, row, item_id, item, n, p - q, island
""".replace("<word>", WORD_PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


_QUERIES = [op1_exact_dedup, op2_near_dedup, op3_warc, op4_lm_score, op5_sharding, op6_url_filter, op7_language_id, op8_decontamination, op9_quality, op10_packing]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_warc": "SELECT page_id, url, html FROM pages", "op5_sharding": sharding_sql(), "op8_decontamination": OP8_SQL}
