import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thema.llm.decontam import Benchmark, drop_contaminated, shared_spans
from thema.llm.text import as_bytes, lower, word_hashes


def brute(docs, items, k, window):
    out = set()
    for d, a in enumerate(docs):
        for e, b in enumerate(items):
            least = max(k, min(k + window - 1, len(b)))
            for p in range(len(a)):
                for q in range(len(b)):
                    if a[p] == b[q] and (p == 0 or q == 0 or a[p - 1] != b[q - 1]):
                        n = 0
                        while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                            n += 1
                        if n >= least:
                            out.add((d, e, p, q, n))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_all_spans_against_brute_force(seed):
    r = random.Random(seed)
    words = [chr(97 + i) for i in range(r.choice([2, 4, 20]))]
    items = [[r.choice(words) for _ in range(r.randint(0, 30))] for _ in range(5)]
    docs = [[r.choice(words) for _ in range(r.randint(0, 30))] + (r.choice(items)[r.randint(0, 3) :] if r.random() < 0.5 else []) + [r.choice(words) for _ in range(r.randint(0, 9))] for _ in range(10)]
    k, w = r.choice([(3, 2), (2, 1), (4, 4)])
    data, offsets = as_bytes(lower(pa.array([" ".join(x) for x in docs])))
    own = word_hashes(data, offsets)
    b = Benchmark(pa.array([" ".join(x) for x in items]), k, w)
    got = b.spans(*own)
    assert len(got) == len(set(got)) and set(got) == brute(docs, items, k, w)
    assert {x[0] for x in b.spans(*own, one=True)} == {x[0] for x in got}


ITEM = " ".join(f"q{i}" for i in range(20))


def frames(spark):
    docs = [(1, "before " + ITEM + " after"), (2, ITEM.upper().replace(" ", ", ")), (3, " ".join(ITEM.split()[:12])), (4, " ".join(ITEM.split()[3:16])), (5, None), (6, ""), (None, ITEM), (1, "before " + ITEM + " after"), (7, "x " * 50_000 + ITEM)]
    items = [(10, ITEM), (11, ITEM), (12, None), (13, ""), (None, "r " * 13)]
    return spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("slice_bytes", [1 << 20, 8])
def test_edges_and_slices(spark, slice_bytes):
    docs, items = frames(spark)
    got = shared_spans(docs, items, slice_bytes=slice_bytes).collect()
    assert sorted((str(r.doc_id), r.item_id, r.doc_word, r.item_word, r.words) for r in got) == sorted(
        (d, i, p, q, n) for i in (10, 11) for d, p, q, n in [("1", 1, 0, 20), ("1", 1, 0, 20), ("2", 0, 0, 20), ("4", 0, 3, 13), ("None", 0, 0, 20), ("7", 50_000, 0, 20)]
    )
    kept = drop_contaminated(docs, items, slice_bytes=slice_bytes)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 5, 6]


def test_empty(spark):
    docs, items = frames(spark)
    assert shared_spans(docs.limit(0), items).collect() == [] and shared_spans(docs, items.limit(0)).collect() == []
    assert drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_table_against_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    import re

    split = lambda x: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", x.lower())
    p, q = docs.toPandas(), items.toPandas()
    shared = {}
    words = [split(t) for t in q.text]
    grams = {}
    for e, w in enumerate(words):
        for i in range(len(w) - 12):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(int(q.item_id[e]))
    for d, t in zip(p.doc_id, p.text):
        w = split(t)
        for i in range(len(w) - 12):
            for e in grams.get(tuple(w[i : i + 13]), ()):
                shared.setdefault((int(d), e), 0)
    got = {(r.doc_id, r.item_id) for r in shared_spans(docs, items).select("doc_id", "item_id").distinct().collect()}
    assert got == set(shared)
    bad = {d for d, _ in shared}
    assert sorted(r.doc_id for r in drop_contaminated(docs, items).select("doc_id").collect()) == sorted(set(p.doc_id) - bad)
    assert docs.where(F.col("doc_id").isin(list(bad))).count() == len(bad)


def test_short_items_and_ids_of_other_types(spark):
    """An item of fewer words than the guarantee is found where it stands whole."""
    short = "alpha beta gamma delta epsilon zeta eta theta iota"
    docs = spark.createDataFrame([("a", f"some words {short} and more of them to follow here"), ("b", short.rsplit(" ", 1)[0])], "doc_id string, text string")
    items = spark.createDataFrame([("i", short), ("j", "only seven words are in this one")], "item_id string, text string")
    assert [tuple(r) for r in shared_spans(docs, items).collect()] == [("a", "i", 2, 0, 9)]
    assert [r.doc_id for r in drop_contaminated(docs, items).collect()] == ["b"]
