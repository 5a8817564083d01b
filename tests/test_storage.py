"""The shared folder: paths, scopes and file systems."""

import os
from types import SimpleNamespace

import pytest

from thema import storage


def spark_like(spark, master, root):
    """A session whose master and checkpoint folder are others."""
    conf = SimpleNamespace(get=lambda name, default=None: root if name == "spark.checkpoint.dir" else default, set=lambda *_: None)
    context = SimpleNamespace(master=master, applicationId="app-1", _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc, getConf=lambda: SimpleNamespace(get=lambda name: None))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_needs_a_folder(spark):
    with pytest.raises(ValueError):
        storage.shared_root(spark_like(spark, "spark://host:7077", None))


@pytest.mark.parametrize("master", ["local[2]", "spark://host:7077"])
def test_paths_without_scheme_are_on_the_default_file_system(spark, master, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert storage.shared_root(spark_like(spark, master, f"{tmp_path}")) == f"file://{tmp_path}/thema/app-1"
    try:
        conf.set("fs.defaultFS", "viewfs://cluster/")
        conf.set("fs.viewfs.mounttable.cluster.link./ckpt", f"file://{tmp_path}")
        assert storage.qualified(spark, "/ckpt") == "viewfs://cluster/ckpt"
        assert storage.shared_root(spark_like(spark, master, "/ckpt")) == "viewfs://cluster/ckpt/thema/app-1"
        assert storage.qualified(spark, "file:///x/y") == "file:///x/y"
    finally:
        conf.set("fs.defaultFS", before)


def test_scopes_delete_what_they_do_not_keep(spark):
    df = spark.range(5)
    with storage.scratch(spark) as outer:
        with storage.scratch(spark) as s:
            a, b = storage.written(df), s.keep(storage.written(df))
        assert not storage.exists(spark, storage.path_of(a)) and b.count() == 5
        c = outer.keep(storage.written(df))
    assert not storage.exists(spark, storage.path_of(b)) and c.count() == 5
    storage.drop(c)
    assert not storage.exists(spark, storage.path_of(c)) and storage.path_of(df) is None


def test_file_systems_by_scheme(monkeypatch, tmp_path):
    from pyarrow import fs

    files, path = storage.filesystem(f"file://{tmp_path}/a")
    assert isinstance(files, fs.LocalFileSystem) and path == f"{tmp_path}/a" and storage.filesystem(f"file:{tmp_path}")[1] == str(tmp_path)
    seen = []
    monkeypatch.setattr(fs, "FileSystem", SimpleNamespace(from_uri=lambda uri: (seen.append(uri), "p")))
    storage.filesystem("s3a://bucket/x")
    storage.filesystem("hdfs://nn/x")
    assert seen == ["s3://bucket/x", "hdfs://nn/x"]
    monkeypatch.undo()
    with pytest.raises(ValueError, match="FILESYSTEMS"):
        storage.filesystem("nowhere://a/b")
    monkeypatch.setitem(storage.FILESYSTEMS, "nowhere", lambda uri: ("files", uri[10:]))
    assert storage.filesystem("nowhere://a/b") == ("files", "a/b")


def test_folders(spark, tmp_path):
    assert storage.folders(spark, f"{tmp_path}/none") == []
    for n in ("b", "a"):
        os.makedirs(tmp_path / n)
    assert storage.folders(spark, str(tmp_path)) == ["a", "b"]
