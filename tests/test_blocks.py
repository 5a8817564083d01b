"""Blocks of documents: bags without a shuffle, hierarchies and given start values of models whose matrices are tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thema.operators import dictionary as D
from thema.operators import windows as W
from thema.plans import partitioned as module
from thema.plans.hierarchy import Hierarchy
from thema.plans.model import TopicModel
from thema.plans.partitioned import PartitionedModel, bags
from thema.schema import DEFAULT_CLASS

TEXTS = [(1, "a b a c"), (2, "c d d"), (1, "a e"), (3, "zz"), (4, "é a b b b"), (5, "c a")]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(TEXTS, "item_id long, text string").withColumn("tokens", F.split("text", " "))
    long = docs.select("item_id", F.lit(DEFAULT_CLASS).alias("class_id"), F.explode("tokens").alias("token")).groupBy("item_id", "class_id", "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    own = bags(docs.select("item_id", F.array(F.lit(DEFAULT_CLASS)).alias("classes"), F.array("tokens").alias("lists")))
    d = W.token_dictionary(docs).where("token <> 'zz'")
    return long, own, d


def agree(a, b):
    x, y = a.phi(), b.phi()
    assert list(x.index) == list(y.index) and np.allclose(x, y, atol=1e-12)


def test_bags_are_the_long_corpus(corpus):
    long, own, d = corpus
    a, b = TopicModel(3, d).fit_offline(long, 2), PartitionedModel(3, d).fit_offline(own, 2)
    agree(a, b)
    assert a.history[-1]["perplexity"] == pytest.approx(b.history[-1]["perplexity"]) and b.history[-1]["items"] == 5
    x, y = ({r.item_id: r.theta for r in m.transform(c).collect()} for m, c in ((a, long), (b, own)))
    assert x.keys() == y.keys() == {1, 2, 3, 4, 5} and all(np.allclose(x[i], y[i]) for i in x)


def test_documents_are_not_shuffled(spark, corpus, monkeypatch):
    _, _, d = corpus
    own = bags(spark.createDataFrame([(1, [DEFAULT_CLASS], [["a", "b"]])], "item_id long, classes array<string>, lists array<array<string>>"))
    seen = []
    monkeypatch.setattr(module, "written", lambda df, f=module.written: seen.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    PartitionedModel(3, d).encode(own)
    docs = [p for p in seen if "MapInArrow" in p and "tx_weight" in p and "FlatMapGroupsInArrow" not in p]
    assert docs and not any("Exchange" in p for p in docs)


def test_hierarchies_agree(corpus):
    long, own, d = corpus
    levels = []
    for kind, c in ((TopicModel, long), (PartitionedModel, own)):
        h = Hierarchy()
        h.add_level(kind(2, d))
        h.add_level(kind(3, d, seed=1), 0.5)
        levels.append(h.fit_offline(c, 2))
    agree(levels[0].levels[1], levels[1].levels[1])
    assert np.allclose(levels[0].get_psi(1), levels[1].get_psi(1))


def test_matrices_of_several_chunks(spark, corpus):
    long, own, d = corpus
    start = d.select("class_id", "token", F.array(F.length("token") * 0.1, F.ascii("token") * 0.01).alias("x"))
    m = PartitionedModel(2, d, start=start)
    assert {r["token"]: list(r["nwt"]) for r in m.m.collect()} == {r["token"]: list(r["x"]) for r in start.collect()}
    assert sorted(W.token_dictionary(long.select("item_id", F.array_repeat("token", F.col("weight").cast("int")).alias("tokens"))).collect()) == sorted(D.gather(long).collect())
