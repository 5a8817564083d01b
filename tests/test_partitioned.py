"""Models whose matrices are tables against those that the driver holds."""

import copy

import numpy as np
import pytest
from pyspark.sql import functions as F

from thema.operators import dictionary as D
from thema.operators.cumulative import Perplexity, ThetaSnippet
from thema.operators.phi_regularizers import BitermsPhi, DecorrelatorPhi, ImproveCoherencePhi, LabelRegularizationPhi, NetPlsaPhi, SmoothSparsePhi, SmoothTimeInTopicsPhi, SpecifiedSparsePhi
from thema.operators.theta_regularizers import SmoothSparseTheta, TopicSelectionTheta
from thema.plans import model as module
from thema.plans.corpus import bow
from thema.plans.model import TopicModel, topic_model
from thema.plans.partitioned import PartitionedModel
from thema.schema import DEFAULT_CLASS
from thema.storage import written


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    tags = docs.select(F.col("doc_id").alias("item_id"), F.lit("@lang").alias("class_id"), F.col("lang").alias("token"), F.lit(1.0).alias("weight"))
    ndw = written(bow(docs).unionByName(tags))
    return ndw, written(D.filtered(D.gather(ndw), class_id=DEFAULT_CLASS, min_df=5))


def agree(a, b):
    x, y = a.phi(), b.phi()
    y.index.names = x.index.names
    assert list(x.index) == list(y.index) and np.allclose(x, y, atol=1e-12)


C = {(DEFAULT_CLASS, "the", "and"): 3.0, (DEFAULT_CLASS, "and", "the"): 3.0}
REGULARIZERS = [
    {},
    {"a": SmoothSparsePhi(-0.5, classes=[DEFAULT_CLASS]), "b": DecorrelatorPhi(100.0, topics=["topic_0", "topic_1"]), "t": SmoothSparseTheta(-0.1), "s": TopicSelectionTheta(0.1)},
    {"a": DecorrelatorPhi(0.2, gamma=0.3), "b": LabelRegularizationPhi(2.0, dictionary={(DEFAULT_CLASS, "the"): 1.0}), "c": SpecifiedSparsePhi(0.9, mode="sparse_tokens", max_elements_count=2)},
    {"a": SpecifiedSparsePhi(0.9, max_elements_count=5, classes=[DEFAULT_CLASS]), "b": ImproveCoherencePhi(0.1, cooc=C), "c": BitermsPhi(0.1, cooc=C), "d": SmoothTimeInTopicsPhi(0.01, classes=["@lang"])},
    {"a": NetPlsaPhi(1e-4, class_id="@lang", vertices={"en": 1.0, "de": 2.0}, edges={("en", "de"): 1.0}, symmetric=True)},
]


@pytest.mark.parametrize("regularizers", REGULARIZERS)
def test_fits_agree(corpus, regularizers):
    ndw, d = corpus
    scores = {"p": Perplexity(), "s": ThetaSnippet(3)}
    options = {"class_weights": {DEFAULT_CLASS: 1.0, "@lang": 5.0}, "document_passes": 3, "regularizers": regularizers, "scores": scores}
    a, b = TopicModel(3, d, **copy.deepcopy(options)).fit_offline(ndw, 2), PartitionedModel(3, d, **copy.deepcopy(options), block_docs=7).fit_offline(ndw, 2)
    agree(a, b)
    for x, y in zip(a.history, b.history):
        assert x["perplexity"] == pytest.approx(y["perplexity"]) and x["sparsity_phi"] == pytest.approx(y["sparsity_phi"]) and x["p"] == pytest.approx(y["p"]) and x["s"].keys() == y["s"].keys()


def test_online_and_transform_agree(corpus):
    ndw, d = corpus
    chunks = [ndw.where(f"item_id % 3 = {i}") for i in range(3)]
    a, b = TopicModel(2, d, collection_unigram=True), PartitionedModel(2, d, collection_unigram=True, block_docs=5)
    for m in (a, b):
        m.fit_online(chunks, 1.0, 0.5).fit_online(chunks[:2], 1.0, 0.5, asynchronous=True)
    agree(a, b)
    assert a.history[-1]["perplexity"] == pytest.approx(b.history[-1]["perplexity"])
    x, y = ({r.item_id: r.theta for r in m.transform(ndw).collect()} for m in (a, b))
    assert x.keys() == y.keys() and all(np.allclose(x[i], y[i]) for i in x)


def test_size_chooses(corpus, monkeypatch):
    ndw, d = corpus
    assert isinstance(topic_model(2, d), TopicModel)
    monkeypatch.setattr(module, "MODEL_BYTES", 1000)
    model = topic_model(2, d, regularizers={"s": SmoothSparsePhi(-0.1)})
    assert isinstance(model, PartitionedModel) and model.fit_offline(ndw).history[0]["items"] == 40
