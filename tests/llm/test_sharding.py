import duckdb
import numpy as np
import pytest

from thema.llm.sharding import Permutation, shard_assignment, sharding_sql, write_shards


@pytest.mark.parametrize("rows", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(rows):
    p, r = Permutation(rows, 5), np.arange(rows)
    q = p.position(r)
    assert sorted(q) == r.tolist() and (p.row(q) == r).all()
    shard, slot = p.locate(r, 100)
    assert (p.row_at(shard, slot, 100) == r).all()
    sizes = np.bincount(shard)
    assert sizes.max() - sizes.min() <= 1
    if rows > 100:
        assert (Permutation(rows, 6).position(r) != q).mean() > 0.9


def test_result_is_independent_of_partitions_and_agrees_with_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = shard_assignment(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    other = shard_assignment(docs.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert one.equals(other)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert one.equals(duckdb.sql(sharding_sql()).df().sort_values("doc_id").reset_index(drop=True)[one.columns])


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "b", 9), (None, None, 9), (-5, "", 9)], "doc_id long, text string, row int")
    got = shard_assignment(df, shard_rows=2).collect()
    assert sorted(r.row for r in got) == [0, 1, 2, 3] and sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert abs([r.row for r in got if r.doc_id == 1][0] - [r.row for r in got if r.doc_id == 1][1]) == 1
    assert shard_assignment(df.limit(0)).collect() == []


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i % 50 if i % 7 else None, f"t{i}") for i in range(100)], "doc_id long, text string")
    write_shards(df, f"{tmp_path}/s", shard_rows=10)
    got = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(r.text for r in got.collect()) == sorted(f"t{i}" for i in range(100))
    assert all(r["count"] == 10 for r in got.groupBy("_shard").count().collect())


def test_write_shards_keeps_clashing_columns_and_agrees_with_the_assignment(spark, tmp_path):
    df = spark.createDataFrame([(i % 40, f"t{i}", i, -i, 7) for i in range(100)], "doc_id long, text string, _shard int, _slot int, _k int")
    write_shards(df, f"{tmp_path}/s", shard_rows=10, shards_per_folder=2)
    got = spark.read.parquet(f"{tmp_path}/s")
    assert sorted((r.doc_id, r.text, r._shard, r._slot, r._k) for r in got.collect()) == sorted((i % 40, f"t{i}", i, -i, 7) for i in range(100))
    want = sorted((r.doc_id, r.shard, r.slot) for r in shard_assignment(df, shard_rows=10).collect())
    assert sorted((r["doc_id"], r["__shard"], r["__slot"]) for r in got.collect()) == want
    assert len([p for p in (tmp_path / "s").iterdir() if p.is_dir()]) == 5


def test_hot_ids_and_ids_of_other_types(spark):
    df = spark.range(300).selectExpr("if(id % 3 = 0, null, concat('d', id)) AS doc_id")
    got = shard_assignment(df, shard_rows=16).toPandas()
    assert sorted(got.row) == list(range(300)) and sorted(got.position) == list(range(300)) and got.doc_id.isna().sum() == 100
