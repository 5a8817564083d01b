"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Every source (a run of rows of a file) truncates the 64-bit hashes of its texts to fingerprints, sorts the
   distinct ones, cuts them by owner (a range of fingerprints) and sends each owner a
   Golomb-coded list of differences: a few bits for each document instead of its text.
2. An owner decodes the lists it got, finds fingerprints that occur in more than one place, and
   returns each source a bitmap over its list. A fingerprint that occurs twice within a list is
   marked there already.
3. A source looks up its bitmaps (each task reads its own from the shared folder; nothing is
   broadcast) and calls the marked documents suspects. Only these are compared byte by byte: by hash, each task's
   different texts are shuffled, copies of a text meet as one. A false suspect, of a chance collision of fingerprints,
   falls out here.

Which source a row belongs to follows from its file and its number there, not from how a job splits the scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import filesystem, shared_dir, written
from .place import block, free, placed

#: Bits of a fingerprint beyond log2 of the number of rows: of clean rows, 2 ** -SPARE become suspects.
SPARE = 10
#: Rows of an owner, about, beyond one owner for each shuffle partition.
OWNER_ROWS = 8_000_000
#: Rows of a source.
SOURCE_ROWS = 1 << 19
#: Sources whose bitmaps share one folder.
SOURCES_PER_FOLDER = 64


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Golomb-Rice code of ascending distinct values: all differences' quotients in unary (zeros, then a one), then from the next byte on
    their `bits` low bits each."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=values[:1] * 0).astype(np.int64)
    ends = np.cumsum((gaps >> bits) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = np.empty((len(gaps), bits), np.uint8)
    for j in range(bits):
        low[:, j] = (gaps >> (bits - 1 - j)) & 1
    return np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(blob: bytes, count: int, bits: int) -> np.ndarray:
    """The inverse of golomb_encode."""
    if not count:
        return np.zeros(0, np.int64)
    low_bytes = -(-count * bits // 8)
    raw = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - low_bytes]))
    gaps = np.diff(ends, prepend=-1) - 1 << bits
    low = np.unpackbits(raw[len(raw) - low_bytes :], count=count * bits).reshape(count, bits)
    for j in range(bits):
        gaps |= low[:, j].astype(np.int64) << (bits - 1 - j)
    return np.cumsum(gaps)


def rice_bits(span: int, count: int) -> int:
    """The best number of low bits for count values spread over span."""
    return max(0, int(math.floor(math.log2(max(1.0, 0.69 * span / max(1, count))))))


def _send(width: int, owner_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            source, fp = batch["source"].to_numpy(), batch["fp"].to_numpy()
            for s in np.unique(source).tolist():
                kept.setdefault(s, []).append(fp[source == s])
        for s, parts in kept.items():
            fp, counts = np.unique(np.concatenate(parts), return_counts=True)
            owner = fp >> (width - owner_bits)
            rows = {"source": [], "owner": [], "count": [], "bits": [], "list": [], "twice": []}
            for o in np.unique(owner).tolist():
                a, b = np.searchsorted(owner, [o, o + 1])
                own = fp[a:b] - (o << (width - owner_bits))
                k = rice_bits(1 << (width - owner_bits), b - a)
                for name, x in zip(rows, (s, o, b - a, k, golomb_encode(own, k), np.packbits(counts[a:b] > 1).tobytes())):
                    rows[name].append(x)
            yield pa.RecordBatch.from_pydict(rows, schema=_SENT)

    return run


_SENT = pa.schema([("source", pa.int64()), ("owner", pa.int32()), ("count", pa.int32()), ("bits", pa.int32()), ("list", pa.binary()), ("twice", pa.binary())])
_SENT_SQL = "source long, owner int, count int, bits int, list binary, twice binary"
_MARKED_SQL = "source long, owner int, count int, bits int, list binary, marks binary"


def _own(pdf: pd.DataFrame) -> pd.DataFrame:
    """At an owner: marks over each source's list what occurs elsewhere too, or twice there."""
    pdf = pdf.sort_values("source", kind="stable").reset_index(drop=True)
    lists = [golomb_decode(b, n, k) for b, n, k in zip(pdf["list"], pdf["count"], pdf["bits"])]
    every = np.sort(np.concatenate(lists))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    keep, marks = [], []
    for own, twice in zip(lists, pdf["twice"]):
        m = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(own)).astype(bool)
        if len(again):
            m |= again[np.minimum(np.searchsorted(again, own), len(again) - 1)] == own
        keep.append(m.any())
        marks.append(np.packbits(m).tobytes())
    pdf["marks"] = marks
    return pdf.loc[np.array(keep, bool), ["source", "owner", "count", "bits", "list", "marks"]]


def _suspect(path: str, folders: int, width: int, owner_bits: int):
    cache: dict[int, np.ndarray] = {}

    def marked(source: int) -> np.ndarray:
        """The fingerprints of this source that its owners marked."""
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, root = filesystem(path)
        folder = f"{root}/folder={source % folders}"
        if files.get_file_info(folder).type == fs.FileType.NotFound:
            return np.zeros(0, np.int64)
        got = ds.dataset(folder, filesystem=files, format="parquet").to_table(filter=ds.field("source") == source)
        out = [np.zeros(0, np.int64)]
        for r in got.to_pylist():
            own = golomb_decode(r["list"], r["count"], r["bits"]) + (r["owner"] << (width - owner_bits))
            out.append(own[np.unpackbits(np.frombuffer(r["marks"], np.uint8), count=r["count"]).astype(bool)])
        return np.unique(np.concatenate(out))

    def suspect(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, fp in batches:
            out, sources, fp = np.zeros(len(fp), bool), sources.to_numpy(), fp.to_numpy()
            for s in np.unique(sources).tolist():
                if s not in cache:
                    cache.clear()
                    cache[s] = marked(s)
                if len(own := cache[s]):
                    rows = sources == s
                    x = fp[rows]
                    out[rows] = own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x
            yield pd.Series(out)

    return F.pandas_udf(suspect, "boolean")


def suspects(docs: DataFrame, text: str = "text", spare: int = SPARE, source_rows: int = SOURCE_ROWS) -> tuple[DataFrame, str, str, str, str]:
    """docs with four more columns, whose names are returned: whether the row may have an exact copy, the text's 64-bit hash, and the
    row's place (see placed). Of rows with a copy none is missed."""
    spark = docs.sparkSession
    docs, file, row = placed(docs)
    flag, digest = free(docs, "suspect"), free(docs, "digest")
    rows = docs.count()
    width = min(62, max(16, math.ceil(math.log2(max(2, rows))) + spare))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // OWNER_ROWS))
    owner_bits = min(width - 8, math.ceil(math.log2(max(2, owners))))
    folders = max(1, rows // (source_rows * SOURCES_PER_FOLDER))
    source = block(file, row, source_rows)
    value = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    fp = F.shiftrightunsigned(value, 64 - width)
    own = docs.where(F.col(text).isNotNull()).select(source.alias("source"), fp.alias("fp"))
    path = shared_dir(spark)
    (
        own.mapInArrow(_send(width, owner_bits), _SENT_SQL)
        .groupBy("owner").applyInPandas(_own, _MARKED_SQL)
        .withColumn("folder", F.pmod("source", F.lit(folders)))
        .repartition("folder").sortWithinPartitions("folder", "source")
        .write.partitionBy("folder").parquet(path)
    )
    out = docs.withColumn(digest, value).withColumn(flag, F.col(text).isNotNull() & _suspect(path, folders, width, owner_bits)(source, fp))
    return out, flag, digest, file, row


def _first(doc_id: str, file: str, row: str) -> Column:
    """The order of copies: by doc_id, null last, then by place."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(file).alias("file"), F.col(row).alias("row"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, keep_id, kept) for every row of docs: keep_id is the least doc_id among the rows with
    the same bytes, kept is true for one row of them.

    A row without copies keeps itself. Rows with a null text are no copies of each other and are
    kept; empty texts are equal texts. A null doc_id is larger than any other; of rows that repeat a
    doc_id and a text one is kept. An empty table gives an empty result; other columns are ignored. options: see suspects().
    """
    df, flag, digest, file, row = suspects(docs, text, **options)
    df = df.select(_first(doc_id, file, row).alias("own"), F.col(text).alias("text"), F.col(flag).alias("flag"), F.col(digest).alias("digest"))
    alone = df.where(~F.col("flag")).select(F.col("own.id").alias("doc_id"), F.col("own.id").alias("keep_id"), F.lit(True).alias("kept"))
    copies = df.where("flag")
    # Each task hands on the different texts of a hash, so a text's copies meet as one row.
    groups = written(
        copies.groupBy("digest").agg(F.min("own").alias("best"), F.collect_set("text").alias("texts"))
        .select("digest", "best", F.when(F.size("texts") > 1, F.col("texts")).alias("texts"))
    )
    several = groups.where("texts IS NOT NULL").select("digest")
    one = groups.where("texts IS NULL").select("digest", "best")
    out = copies.select("own", "digest").join(one, "digest")
    if not several.isEmpty():  # different texts share a hash: theirs go by text
        rest = copies.join(several, "digest", "left_semi")
        out = out.select("own", "best").unionAll(rest.join(rest.groupBy("digest", "text").agg(F.min("own").alias("best")), ["digest", "text"]).select("own", "best"))
    return alone.unionAll(out.select(F.col("own.id").alias("doc_id"), F.col("best.id").alias("keep_id"), (F.col("own") == F.col("best")).alias("kept")))


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that exact_duplicates() keeps."""
    df, flag, digest, file, row = suspects(docs, text, **options)
    copies = df.where(flag).select(F.col(digest).alias("digest"), F.col(text).alias("text"), F.struct(_first(doc_id, file, row).alias("first"), F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("rest")).alias("row"))
    kept = copies.groupBy("digest", "text").agg(F.min_by("row", "row.first").alias("row"))
    columns = [F.col("text").alias(c) if c == text else F.col("row.rest").getField(c).alias(c) for c in docs.columns]
    return df.where(~F.col(flag)).select(docs.columns).unionAll(kept.select(columns))
