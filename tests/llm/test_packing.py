import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from thema.llm.packing import _words, _words_before, pack, pack_documents
from thema.llm.text import as_bytes


def brute(sizes, capacity):
    bins = []
    large = sorted((s for s in sizes if 3 * s > capacity), reverse=True)
    while large:
        a = large.pop(0)
        j = next((j for j, b in enumerate(large) if b <= capacity - a), None)
        bins.append([a] if j is None else [a, large.pop(j)])
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        best = min((b for b in bins if capacity - sum(b) >= s), key=lambda b: capacity - sum(b), default=None)
        bins.append([s]) if best is None else best.append(s)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_same_fill_as_packing_one_by_one(case):
    capacity, sizes = case
    h = Counter(sizes)
    runs = pack(h, capacity)
    size = np.array(sorted(sizes), np.int64)
    if not len(size):
        return
    rank = np.concatenate([np.arange(h[s]) for s in sorted(h)])
    to, offset = runs.places(h).find(size, rank)
    got = {}
    for s, b, o in zip(size.tolist(), to.tolist(), offset.tolist()):
        got.setdefault(b, []).append((o, s))
    for items in got.values():
        end = 0
        for o, s in sorted(items):
            assert o == end
            end += s
        assert end <= capacity and sum(3 * s > capacity for _, s in items) <= 2
    assert Counter(sum(s for _, s in x) for x in got.values()) == Counter(map(sum, brute(sizes, capacity)))


def test_documents(spark):
    rows = [(1, "a b c d e f g"), (2, None), (3, ""), (4, "  "), (5, "a\tb\nc"), (None, "x y"), (1, "a"), (6, "w " * 10_000)]
    got = pack_documents(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, length string"), capacity=5).collect()
    assert sorted(r.length for r in got if r.doc_id == 1) == [1, 2, 5]
    assert all(r.bin_id is None and r.length == 0 for r in got if r.doc_id in (2, 3, 4)) and len([r for r in got if r.doc_id in (2, 3, 4)]) == 3
    assert sum(r.length for r in got if r.doc_id == 6) == 10_000
    fill = {}
    for r in sorted((r for r in got if r.bin_id is not None), key=lambda r: (r.bin_id, r.offset)):
        assert fill.get(r.bin_id, 0) == r.offset
        fill[r.bin_id] = r.offset + r.length
    assert max(fill.values()) <= 5 and sorted(fill) == list(range(len(fill)))
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = pack_documents(docs).toPandas()
    again = pack_documents(docs.repartition(5)).toPandas()
    key = ["doc_id", "part"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    want = Counter(map(sum, brute([s for s in got.length if s], 2048)))
    assert Counter(got.groupby("bin_id").length.sum()) == want
    words = docs.toPandas().set_index("doc_id").text.str.split().str.len()
    assert (got.groupby("doc_id").length.sum() == words.sort_index()).all()


def test_large_capacity():
    r = np.random.default_rng(1)
    sizes = np.minimum(r.geometric(1 / 20_000, 3000), 131_072).tolist() + [131_072] * 5
    runs = pack(Counter(sizes), 131_072)
    want = brute(sizes, 131_072)
    assert runs.bins == len(want)
    h = Counter(sizes)
    places = runs.places(h)
    fill = Counter()
    for s, n in h.items():
        to, offset = places.find(np.full(n, s), np.arange(n))
        for b in to.tolist():
            fill[b] += s
    assert Counter(fill.values()) == Counter(map(sum, want))
    began = time.perf_counter()
    assert pack({s: 3 for s in range(1, 131_073)}, 131_072).bins > 0
    assert time.perf_counter() - began < 30


def test_documents_beyond_old_capacity(spark):
    got = pack_documents(spark.createDataFrame([(1, "w " * 200_000), (2, "a b")], "doc_id long, text string"), capacity=131_072).toPandas()
    assert sorted(got.length) == [2, 68_928, 131_072] and got.groupby("bin_id").length.sum().max() == 131_072


def test_blanks_are_counted_in_linear_time():
    began = time.perf_counter()
    assert _words(pa.array([" " * 10_000_000 + "a" + "\n" * 1_000_000, None, "", "a b", " a\u00a0b ", "x"])).to_pylist() == [1, 0, 0, 2, 1, 1]
    assert time.perf_counter() - began < 1


def test_words_of_a_large_batch_take_little_memory():
    for texts in (["some words of a text\n" * 150] * 8_000, ["some words of a text\n" * 1_200_000]):  # 25 MB each
        column = pa.array(texts)
        tracemalloc.start()
        got = _words(column)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert got.to_pylist() == [5 * x.count("\n") for x in texts]
        assert peak < 16e6


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(" \t\nab\u00a0\u4e2d", max_size=12), max_size=12), st.integers(1, 9))
def test_words_across_pieces(texts, piece):
    got = np.diff(_words_before(*as_bytes(pa.array(texts, pa.string())), piece))
    assert got.tolist() == [len((x or "").encode().split()) for x in texts]


def test_hot_ids_and_ids_of_other_types(spark):
    docs = spark.range(400).selectExpr("if(id % 3 = 0, null, concat('d', id)) AS doc_id", "repeat('w ', 3) AS text")
    got = pack_documents(docs, capacity=7, ranked=10).toPandas()
    assert len(got) == 400 and got.bin_id.value_counts().tolist() == [2] * 200 and sorted(set(got.offset)) == [0, 3]
    assert not got.duplicated(["bin_id", "offset"]).any() and got.doc_id.isna().sum() == 134
