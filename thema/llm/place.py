"""Names for rows that hold in every job: the file and row of a Parquet scan, or numbers written with the table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import filesystem, is_plain_scan, shared_dir, written


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def placed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names are returned: a file (string) and a row's number in it (long). They are the row's own:
    however a later job splits its scan, and however often it is run, they stay. An input that isn't a scan of Parquet files is
    written first."""
    file, row = free(docs, "file"), free(docs, "row")
    if is_plain_scan(docs) and "_metadata" not in {c.lower() for c in docs.columns}:
        try:
            return docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), file, row
        except AnalysisException:  # a format without row numbers
            pass
    own = written(docs.withColumn(row, F.monotonically_increasing_id()))
    return own.withColumn(file, F.lit("")), file, row


def block(file: str, row: str, rows: int) -> Column:
    """The source of a row: runs of `rows` consecutive rows of a file share one. Different sources share a number by chance only."""
    return F.xxhash64(F.col(file), F.floor(F.col(row) / rows))


def repeated(df: DataFrame, times: str, keys: list[str], piece: int = 100_000) -> DataFrame:
    """Each row as often as its column `times` says, with the copy's number in "copy"; a row repeated very often is
    spread over tasks by keys (those that tell rows apart)."""
    last = F.floor((F.col(times) - 1) / piece).cast("long")
    few = df.where(F.col(times) <= piece).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    many = df.where(F.col(times) > piece).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(*keys, "_piece")
    many = many.withColumn("copy", F.explode(F.sequence(F.col("_piece") * piece, F.least(F.col(times), (F.col("_piece") + 1) * piece) - 1)))
    return few.unionAll(many.drop("_piece"))


def without(docs: DataFrame, file: str, row: str, bad: DataFrame, source_rows: int = 1 << 17, per_folder: int = 4_000_000) -> DataFrame:
    """docs of placed(), without the rows that bad(file, row) names. Only bad is shuffled: it is written by sources (runs of source_rows rows of a file),
    and a task reads what concerns its own rows from the shared folder."""
    source = lambda f, r: block(f, r, source_rows)
    own = written(bad.select("file", "row", source("file", "row").alias("source")))
    folders, path = max(1, own.count() // per_folder), shared_dir(docs.sparkSession)
    own.withColumn("folder", F.pmod("source", F.lit(folders))).repartition("folder").sortWithinPartitions("folder", "source").write.partitionBy("folder").parquet(path)
    cache: dict[int, dict[str, np.ndarray]] = {}

    def named(source: int) -> dict[str, np.ndarray]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, root = filesystem(path)
        folder = f"{root}/folder={source % folders}"
        if files.get_file_info(folder).type == fs.FileType.NotFound:
            return {}
        got = ds.dataset(folder, filesystem=files, format="parquet").to_table(columns=["file", "row"], filter=ds.field("source") == source)
        names, rows = np.array(got["file"].to_pylist(), object), got["row"].to_numpy()
        return {f: np.sort(rows[names == f]) for f in set(names.tolist())}  # several files share a source by chance only

    def stays(sources: pa.Array, names: pa.Array, rows: pa.Array) -> pa.Array:
        sources, rows, out = sources.to_numpy(zero_copy_only=False), rows.to_numpy(zero_copy_only=False), np.ones(len(rows), bool)
        for s in np.unique(sources).tolist():
            if s not in cache:
                cache.clear()
                cache[s] = named(s)
            at = np.flatnonzero(sources == s)
            of = np.array(names.take(pa.array(at)).to_pylist(), object)
            for f, gone in cache[s].items():
                own = at[of == f]
                out[own] = gone[np.minimum(np.searchsorted(gone, rows[own]), len(gone) - 1)] != rows[own]
        return pa.array(out)

    return docs.where(F.arrow_udf(stays, "boolean")(source(file, row), F.col(file), F.col(row)))
