import random

import numpy as np
import pyarrow as pa
import pytest

from thema.llm.near_dedup import TREES, components, connected, drop_near_duplicates, near_duplicates, shingles, trees_for
from thema.llm.text import as_bytes, lower, word_hashes


def corpus(n=60, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [[r.choice(vocabulary) for _ in range(r.randint(60, 200))] for _ in range(n)]
    for i in range(0, n, 2):
        for _ in range(r.randint(1, 4)):
            copy = list(texts[i])
            for _ in range(max(1, len(copy) // 40)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(copy)
    return [" ".join(t) for t in texts]


def sets(texts, k=3):
    data, offsets = as_bytes(lower(pa.array(texts)))
    grams, first = shingles(*word_hashes(data, offsets), k)
    return [set(grams[first[i] : first[i + 1]].tolist()) for i in range(len(texts))]


def pairs_above(texts, threshold):
    s = sets(texts)
    return [(i, j) for i in range(len(s)) for j in range(i) if s[i] | s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j])]


@pytest.mark.parametrize("options", [{}, {"leaf": 2, "memory": 4, "trees": 16}])
def test_recall_against_brute_force(spark, options):
    """Also where nodes are split on Spark and within tasks."""
    texts = corpus()
    got = {r.doc_id: r.group_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect()}
    want = pairs_above(texts, 0.55)
    assert len(want) > 50
    assert sum(got[i] == got[j] for i, j in want) >= 0.9 * len(want)
    s = sets(texts)
    for i in range(60):
        for j in range(i):
            if not s[i] & s[j]:
                assert got[i] != got[j]


def test_brute_force_on_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    p = docs.toPandas()
    got = near_duplicates(docs).toPandas().set_index("doc_id").group_id
    want = pairs_above(p.text.tolist(), 0.5)
    ids = p.doc_id.tolist()
    assert want and sum(got[ids[i]] == got[ids[j]] for i, j in want) >= 0.9 * len(want)


BASE = " ".join(f"v{i}" for i in range(100))
ROWS = [(1, BASE), (2, BASE + " end"), (None, BASE), (1, BASE), (3, None), (4, ""), (5, ""), (6, "?!"), (7, "two words"), (8, "Two  words!"), (9, "one"), (10, "other text of its own here"), (11, "z " * 100_000)]


def test_edges(spark):
    df = spark.createDataFrame([(*r, "k") for r in ROWS], "doc_id long, text string, key string")
    got = near_duplicates(df).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.group_id, []).append((r.doc_id, r.kept))
    assert len(got) == len(ROWS) and all(sum(k for _, k in g) == 1 for g in groups.values())
    assert sorted(str(d) for d, _ in groups[1]) == ["1", "1", "2", "None"]
    assert sorted(d for d, _ in groups[7]) == [7, 8]
    assert all(len(groups[i]) == 1 for i in (3, 4, 5, 6, 9, 10, 11))
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 9, 10, 11]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == [] and drop_near_duplicates(df).collect() == []


def test_connected(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    a, b = np.array(edges).T
    label = components(131, a, b)
    got = {r.u: r.v for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    for i in range(131):
        assert got.get(i, i) == label[i]


def test_trees_follow_from_recall():
    assert TREES == trees_for(0.99, 0.5, 4) == 8 and trees_for(0.9, 0.5, 4) < 8 < trees_for(0.999, 0.5, 4)


def test_hot_groups_leave_by_their_pivot(spark):
    """Two large groups of near copies, one of exact ones, and nodes far above what a task takes; blocks of pairs are never needed."""
    r = random.Random(5)
    base = [[r.choice("abcdefghij") + str(r.randrange(900)) for _ in range(80)] for _ in range(2)]
    rows = []
    for i in range(600):
        words = list(base[i % 2])
        words[r.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "one text that very many documents share with each other") for i in range(300)] + [(None, "one text that very many documents share with each other")] * 50
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), memory=50, levels=6).toPandas()
    assert len(got) == len(rows) and got.kept.sum() == got.group_id.nunique() == 3
    assert sorted(got.group_id.value_counts().tolist()) == [300, 300, 350]


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("b", BASE), ("a", BASE + " end"), ("c", "other text")], "doc_id string, text string")
    assert sorted((r.doc_id, r.group_id, r.kept) for r in near_duplicates(df).collect()) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_dropped_rows_do_not_depend_on_the_splits(spark, tmp_path):
    """Rows are named by their places, whatever the splits; with many sources, in several folders and files."""
    from thema.llm.place import placed, without

    spark.range(5000).selectExpr("id", "id % 3 AS file", "-id AS row").repartition(4).write.parquet(f"{tmp_path}/t")
    df, file, row = placed(spark.read.parquet(f"{tmp_path}/t"))
    bad = df.where("id % 7 = 0").select(df[file].alias("file"), df[row].alias("row"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = without(df, file, row, bad, 100, 50)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        assert sorted(r.id for r in got.collect()) == [i for i in range(5000) if i % 7]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert without(df, file, row, bad.limit(0)).count() == 5000


def test_rows_that_repeat_and_clashing_names(spark):
    df = spark.createDataFrame([(1, BASE, "f", 1), (1, BASE, "g", 2), (None, BASE, "h", 3), (None, "?", "i", 4)], "doc_id long, text string, file string, row int")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns and len(rows := got.collect()) == 2 and {r.doc_id for r in rows} == {1, None}
