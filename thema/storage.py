"""Tables written in the shared folder that the cluster names in spark.checkpoint.dir.

A written table cuts the lineage and survives the loss of executors. All tables of an application lie in a
folder of its own, which Hadoop deletes when the application ends; scratch() deletes them earlier.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Schemes of Hadoop that pyarrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
#: File systems for schemes that pyarrow lacks: by scheme, a function of the URI that gives (pyarrow file system, path in it).
FILESYSTEMS: dict[str, Callable[[str], tuple]] = {}


def qualified(spark: SparkSession, path: str) -> str:
    """The URI of path, on Hadoop's default file system if it names none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shared_root(spark: SparkSession) -> str:
    """The application's folder below spark.checkpoint.dir. Where that is unset, as in tests on one machine, a local folder is made and set;
    on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import atexit

        local = tempfile.mkdtemp(prefix="thema-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = "file://" + local
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{qualified(spark, root).rstrip('/')}/thema/{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI in the application's folder."""
    root = shared_root(spark)
    if root not in _marked:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _marked.add(root)
    path = f"{root}/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].paths.append(path)
    return path


_marked: set[str] = set()
_scopes: list[scratch] = []


class scratch:  # noqa: N801
    """A scope whose tables are deleted at its end, but for those kept. Results are lazy, so a result that leaves the scope must be
    written or kept with the tables that it reads:

        with scratch(spark):
            exact_duplicates(docs).write.parquet(path)
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        """df, whose own written table outlives the scope (and belongs to the one around it)."""
        self.kept.add(path_of(df))
        return df

    def __enter__(self) -> scratch:
        _scopes.append(self)
        return self

    def __exit__(self, *_) -> None:
        _scopes.remove(self)
        for path in self.paths:
            if path not in self.kept:
                drop_path(self.spark, path)
            elif _scopes:
                _scopes[-1].paths.append(path)


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._thema_path = path
    return out


def path_of(df: DataFrame) -> str | None:
    """Where written() put df."""
    return getattr(df, "__dict__", {}).get("_thema_path")


def drop(df: DataFrame) -> None:
    """Deletes the table of written(); nothing may read it any more."""
    if path := path_of(df):
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def filesystem(uri: str) -> tuple:
    """(pyarrow file system, path in it) of a URI, in the driver or in a task. s3a and s3n are S3; schemes that pyarrow has no file system for
    are looked up in FILESYSTEMS, and an error if they aren't there."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    if not colon:
        scheme, rest = "file", uri.removeprefix("file:")
    if scheme in FILESYSTEMS:
        return FILESYSTEMS[scheme](uri)
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    try:
        return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
    except (ValueError, NotImplementedError) as e:
        raise ValueError(f"no pyarrow file system for {scheme}://; add one to thema.storage.FILESYSTEMS") from e


def is_plain_scan(df: DataFrame) -> bool:
    """Whether df is a projection or filter over one file scan."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while True:
        name = plan.nodeName()
        if name.startswith("LogicalRelation") or name.startswith("Relation"):
            return True
        if name not in ("Project", "Filter") or plan.children().size() != 1:
            return False
        plan = plan.children().apply(0)


def spread(df: DataFrame, least_bytes: int = 16 << 20) -> DataFrame:
    """df over all cores if it is small: a table of less than least_bytes for each core often lies in a few splits, or row groups, and
    would be worked on by as many tasks only. Larger ones are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * least_bytes else df
