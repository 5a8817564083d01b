import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thema.llm.exact_dedup import drop_exact_duplicates, exact_duplicates, golomb_decode, golomb_encode, rice_bits


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=200), st.integers(0, 40))
def test_golomb_round_trip(values, bits):
    v = np.array(sorted(values), np.int64)
    if len(v) and (v[-1] >> bits) > 100_000:
        bits = rice_bits(1 << 41, len(v))
    assert golomb_decode(golomb_encode(v, bits), len(v), bits).tolist() == v.tolist()


ROWS = [(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (None, "a", "z"), (3, "a", "y"), (4, None, "n"), (5, None, "n"), (6, "", "e"), (7, "", "e"), (8, "é" * 50_000, "l"), (9, "é" * 50_000, "l"), (10, "A", "x")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string")


def test_groups(spark):
    got = sorted((str(r.doc_id), str(r.keep_id), r.kept) for r in exact_duplicates(frame(spark)).collect())
    assert got == sorted([
        ("1", "1", True), ("2", "2", True), ("3", "1", False), ("None", "1", False), ("3", "1", False), ("4", "4", True), ("5", "5", True),
        ("6", "6", True), ("7", "6", False), ("8", "8", True), ("9", "8", False), ("10", "10", True),
    ])


def test_drop_keeps_columns_and_clashing_names(spark):
    df = frame(spark).withColumnRenamed("keep_id", "suspect").selectExpr("*", "1 AS digest", "2 AS nth")
    got = drop_exact_duplicates(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 4, 5, 6, 8, 10]


def test_empty(spark):
    assert exact_duplicates(frame(spark, [])).collect() == []
    assert drop_exact_duplicates(frame(spark, [])).collect() == []


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = docs.toPandas()
    p["want"] = p.groupby("text").doc_id.transform("min")
    got = exact_duplicates(docs).toPandas().merge(p, on="doc_id")
    assert len(got) == len(p) and (got.keep_id == got.want).all() and (got.kept == (got.doc_id == got.want)).all()


def test_false_suspects_fall_out(spark):
    """With fingerprints of 16 bits for thousands of rows most rows are suspects; the bytes decide."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('t', id % 3500) AS text")
    got = exact_duplicates(docs).toPandas()
    assert got.kept.sum() == 3500 and (got.keep_id == got.doc_id % 3500).all()


def kept(df):
    return df.where("kept").count()


@pytest.mark.parametrize("plain", [True, False])
def test_other_splits_between_call_and_action(spark, tmp_path, plain):
    """The result doesn't depend on how the scan is split when it is run."""
    spark.range(40_000).selectExpr("id AS doc_id", "concat('text ', id % 20000) AS text").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    docs = docs if plain else docs.distinct()
    names = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        spark.conf.set(names[0], "4")
        got, rows = exact_duplicates(docs, source_rows=1000), drop_exact_duplicates(docs, source_rows=1000)
        spark.conf.set(names[0], "16")
        spark.conf.set(names[1], "20000")
        spark.conf.set(names[2], "1000")
        assert kept(got) == 20_000 and got.count() == 40_000 and rows.count() == 20_000
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_hot_text_and_repeated_rows(spark):
    """A third of all rows hold one text, some of them with one doc_id; one row of them is kept."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, id % 7, id) AS doc_id", "if(id % 3 = 0, repeat('hot ', 500), concat('t', id)) AS text")
    got = exact_duplicates(docs).toPandas()
    assert len(got) == 3000 and got.kept.sum() == 2001 and (got.keep_id == 0).sum() == 1000
    assert drop_exact_duplicates(docs).count() == 2001


def test_hash_collisions_go_by_text(spark, monkeypatch):
    """Different texts under one hash stay apart."""
    import thema.llm.exact_dedup as module

    monkeypatch.setattr(module.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_duplicates(docs).collect()) == [(1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True)]
    assert sorted(r.doc_id for r in drop_exact_duplicates(docs).collect()) == [1, 2, 4]


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "doc_id string, text string")
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in exact_duplicates(docs).collect()) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]
