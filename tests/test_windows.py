"""Windows over whole items against the pairs as rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thema.operators import cooc as C
from thema.operators import dictionary as D
from thema.operators import windows as W

ROWS = [(1, "a b a c d e f g a".split()), (2, "b a".split()), (1, "a a z".split()), (3, []), (4, None), (5, ["a"]), (6, "é я a b".split()), (6, "b".split())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "item_id long, tokens array<string>").repartition(3)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


@pytest.fixture(params=[1 << 22, 4])
def sizes(request, monkeypatch):
    monkeypatch.setattr(W, "RANGE_PAIRS", request.param)


def test_cooccurrence_of_repeated_items(docs, sizes):
    pairs = C.window_pairs(docs, 5)
    same(W.cooccurrence(docs, 5), C.cooccurrence(pairs))
    same(W.cooccurrence(docs, 5, symmetric=True), C.cooccurrence(pairs, symmetric=True))
    same(W.cooccurrence(docs, 2, different=True, min_tf=2, min_df=2), C.selected(C.cooccurrence(C.window_pairs(docs, 2)), 2, 2))


def test_pairs_never_travel_as_rows(docs):
    plan = W.cooccurrence(docs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_ppmi(docs, sizes):
    pairs = C.window_pairs(docs, 5)
    for measure, n in (("tf", pairs.agg((2 * F.count(F.lit(1))).alias("n"))), ("df", docs.agg(F.count(F.lit(1)).alias("n")))):
        want = C.ppmi(C.selected(C.cooccurrence(pairs)), _margins(pairs, docs), measure, n)
        a, b = ({(r["u"], r["v"]): r["value"] for r in t.collect()} for t in (W.ppmi(docs, 5, measure), want))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def _margins(pairs, docs):
    df = docs.select("item_id", F.explode("tokens").alias("u")).distinct().groupBy("u").agg(F.count(F.lit(1)).alias("n_df"))
    return C.marginals(pairs, docs).drop("n_df").join(df, "u")


def test_dictionary_of_repeated_items(docs, sizes):
    long = docs.select("item_id", F.lit("c").alias("class_id"), F.explode("tokens").alias("token"), F.lit(1.0).alias("weight"))
    same(D.gather(long), W.token_dictionary(docs, "c"))


def test_sums_over_neighbours(spark, docs, sizes):
    x = {t: [float(i + 1), float(i % 3)] for i, t in enumerate("abcdefgzéя")}
    tokens = W.by_frequency(W.token_sums(W.items(docs)).join(spark.createDataFrame(list(x.items()), "token string, x array<double>"), "token"))
    want = {}
    for _, ws in ROWS:
        for i, u in enumerate(ws or []):
            for v in (ws[max(0, i - 5) : i] + ws[i + 1 : i + 6]):
                if u != v:
                    want[u] = want.get(u, np.zeros(2)) + x[v]
    got = {}
    for r in W.neighbour_sums(docs, tokens, 5, lambda u, v: v, "x", 2).collect():
        got.setdefault(r["token"], [0, 0])[r["topic"]] = r["value"]
    assert got.keys() == want.keys() and all(list(want[k]) == got[k] for k in got)
