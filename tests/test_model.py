"""Models on Spark: kernel against relational form, fits, reshaping, saving, streaming, the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thema import cli
from thema.operators import dictionary as D
from thema.operators import estep, matrix, regularizers, scores
from thema.operators.model_scores import BackgroundTokensRatio, SparsityPhi, TopicKernel, TopicMassPhi, TopTokens
from thema.operators.phi_regularizers import BitermsPhi, DecorrelatorPhi, ImproveCoherencePhi, LabelRegularizationPhi, SmoothSparsePhi, SmoothTimeInTopicsPhi, SpecifiedSparsePhi, total
from thema.operators.theta_regularizers import HierarchySparsingTheta, SmoothPtdw, SmoothSparseTheta, TopicSelectionTheta
from thema.plans.config import ModelConfig, regularizer
from thema.plans.corpus import bow
from thema.plans.hierarchy import Hierarchy
from thema.plans.lda import Lda
from thema.plans.model import TopicModel, fit_relational
from thema.schema import DEFAULT_CLASS
from thema.storage import shared_dir, written


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    ndw = written(bow(spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")))
    return ndw, written(D.filtered(D.gather(ndw), min_df=5))


def long(model, spark, name="pwt"):
    return {(r.class_id, r.token, r.topic): r.value for r in model.matrix(spark, name).collect()}


def test_kernel_and_relational_form_agree(spark, corpus):
    ndw, d = corpus
    model = TopicModel(3, d, document_passes=2)
    start, items = written(model.matrix(spark, "nwt")), ndw.select("item_id").distinct()
    model.fit_offline(ndw, 2)
    nwt, phi = fit_relational(ndw, start, items, model.topics, 2, 2)
    got, want = long(model, spark), {(r.class_id, r.token, r.topic): r.value for r in phi.collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in got) < 1e-9
    known = ndw.join(d, ["class_id", "token"], "left_semi").agg(F.sum("weight")).first()[0]
    assert abs(nwt.agg(F.sum("value")).first()[0] - known) < 1e-6


def test_scores_agree_with_their_tables(spark, corpus):
    ndw, d = corpus
    model = TopicModel(3, d, document_passes=3, regularizers={"s": SmoothSparsePhi(-1.0)}).fit_offline(ndw, 2)
    phi, nwt = written(model.matrix(spark)), written(model.matrix(spark, "nwt"))
    assert abs(SparsityPhi()(model.m)["value"] - scores.sparsity_phi(phi, DEFAULT_CLASS).first()["value"]) < 1e-12
    kernel, table = TopicKernel(threshold=0.4)(model.m), {r.topic: r for r in scores.topic_kernel(phi, nwt, DEFAULT_CLASS, 0.4).collect()}
    for t in model.topics:
        assert kernel["size"][t] == table[t].size and abs(kernel["purity"][t] - table[t].purity) < 1e-9 and abs(kernel["contrast"][t] - table[t].contrast) < 1e-9
    top = TopTokens(5)(model.m)
    assert {t: [r.token for r in sorted(matrix.top_tokens(phi, 5).where(F.col("topic") == t).collect(), key=lambda r: r["rank"])] for t in model.topics} == top["tokens"]
    back = BackgroundTokensRatio(delta=0.3)(model.m)
    assert sorted(back["tokens"]) == sorted(r.token for r in scores.background_tokens(phi, nwt, DEFAULT_CLASS, 0.3).collect())
    assert abs(sum(TopicMassPhi()(model.m)["topic_ratio"].values()) - 1) < 1e-9
    theta = model.get_theta(ndw)
    before = model.clone()
    p = scores.perplexity(ndw, phi, theta.select("item_id", "topic", "value")).first()
    before.fit_offline(ndw)
    assert abs(before.history[-1]["perplexity"] - p["perplexity"]) < 1e-6 * p["perplexity"] and before.history[-1]["zero_words"] == p["zero_words"]


def test_regularizers_agree_with_their_tables(spark, corpus):
    ndw, d = corpus
    model = TopicModel(4, d, document_passes=2).fit_offline(ndw, 1)
    p, n = written(model.matrix(spark)), written(model.matrix(spark, "nwt"))
    values = {(r.class_id, r.token): r.value for r in d.collect()}
    tokens = model.m.tokens.tolist()
    pairs = {(DEFAULT_CLASS, tokens[i], tokens[(i * 7 + 3) % len(tokens)]): float(i % 5) for i in range(40)}
    cooc = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "class_id string, u string, v string, value double")
    for reg, table in [
        (SmoothSparsePhi(2.0, dictionary=values, kind="polynomial", a=2.0, n=0.5), regularizers.smooth_sparse(p, d, kind="polynomial", a=2.0, n=0.5)),
        (DecorrelatorPhi(2.0, topics=["topic_0", "topic_2"]), regularizers.decorrelator(p, ["topic_0", "topic_2"])),
        (LabelRegularizationPhi(2.0, dictionary=values), regularizers.label(n, d)),
        (SpecifiedSparsePhi(2.0, max_elements_count=7, probability_threshold=0.5), regularizers.specified_sparse(n, "topic", 7, 0.5)),
        (SpecifiedSparsePhi(2.0, mode="sparse_tokens", max_elements_count=2, probability_threshold=0.7), regularizers.specified_sparse(n, "token", 2, 0.7)),
        (ImproveCoherencePhi(2.0, cooc=pairs), regularizers.improve_coherence(n, cooc)),
        (BitermsPhi(2.0, cooc=pairs), regularizers.biterms(p, n, cooc)),
        (SmoothTimeInTopicsPhi(2.0, classes=[DEFAULT_CLASS]), regularizers.smooth_time(p, DEFAULT_CLASS)),
        (DecorrelatorPhi(2.0, gamma=0.3), regularizers.relative(regularizers.decorrelator(p), n, 0.3)),
    ]:
        got, row = total([reg], model.m), model.m.row_of
        want = np.zeros_like(got)
        for r in table.collect():
            want[row[r.class_id, r.token], model.topics.index(r.topic)] += 2.0 * r.value
        assert np.allclose(got, want, rtol=1e-7, atol=1e-9), type(reg).__name__


def test_perplexity_falls_and_clone_is_equal(corpus, spark):
    ndw, d = corpus
    model = TopicModel(4, d)
    other = model.clone()
    docs = model.encode(ndw)
    model.fit_offline(docs, 3)
    other.fit_offline(ndw, 3)
    assert np.allclose(model.m.pwt, other.m.pwt)
    p = model.score_tracker["perplexity"]
    assert p[0] > p[1] > p[2] and model.get_score("items") == 60


def test_online(corpus):
    ndw, d = corpus
    one, off = TopicModel(3, d), TopicModel(3, d)
    one.fit_online([ndw], apply=[1.0], decay=[0.0])
    off.fit_offline(ndw)
    assert np.allclose(one.m.pwt, off.m.pwt)
    chunks = [ndw.where(f"item_id % 3 = {i}") for i in range(3)]
    a, b = TopicModel(3, d), TopicModel(3, d)
    a.fit_online(chunks, 1.0, 0.5, asynchronous=True)
    docs = [b.encode(c) for c in chunks]
    first, second = b._pass(docs[0]), b._pass(docs[1])
    rho = [(1.0 + i) ** -0.5 for i in range(1, 4)]
    b._update((1 - rho[0]) * b.m.nwt + rho[0] * first[0], first[1])
    third = b._pass(docs[2])
    b._update((1 - rho[1]) * b.m.nwt + rho[1] * second[0], second[1])
    b._update((1 - rho[2]) * b.m.nwt + rho[2] * third[0], third[1])
    assert np.allclose(a.m.pwt, b.m.pwt)


def test_reshape_save_and_load(spark, corpus):
    ndw, d = corpus
    model = TopicModel(3, d).fit_offline(ndw, 1)
    path = shared_dir(spark)
    model.save(spark, path)
    again = TopicModel.load(spark, path)
    assert np.array_equal(again.m.pwt, model.m.pwt) and again.history[0]["pass"] == 1
    a, b = model.transform(ndw).orderBy("item_id").toPandas(), again.transform(ndw).orderBy("item_id").toPandas()
    assert np.allclose(np.stack(a.theta), np.stack(b.theta))
    again.reshape_topics(["topic_2", "new", "topic_0"])
    assert np.array_equal(again.m.pwt[:, 0], model.m.pwt[:, 2]) and not again.m.pwt[:, 1].any()
    again.rename_topics(["a", "b", "c"])
    some = d.where("df >= 10")
    model.reshape_tokens(some)
    assert len(model.m.tokens) == some.count()
    with pytest.raises(Exception):
        TopicModel.load(spark, path).save(spark, path)
    with pytest.raises(ValueError):
        model.get_phi(["none"])
    before = model.phi()
    model.overwrite("pwt", before.iloc[:5])
    assert np.allclose(model.m.pwt[:5], before.to_numpy()[:5]) and not model.m.pwt[5:].any()


def test_reuse_theta_and_theta_regularizers(corpus):
    ndw, d = corpus
    model = TopicModel(3, d, document_passes=1, reuse_theta=True, regularizers={"t": SmoothSparseTheta(-0.2), "sel": TopicSelectionTheta(0.1)}).fit_offline(ndw, 3)
    assert model.history[-1]["sparsity_theta"] > 0 and model.get_theta(eps=1e-9).count() < 180
    model.remove_theta()
    with pytest.raises(ValueError):
        model.get_theta()


def test_occurrences(spark, corpus):
    ndw, d = corpus
    model = TopicModel(3, d).fit_offline(ndw, 1)
    p = model.transform(ndw, "ptdw").toPandas()
    assert np.allclose(np.stack(p.p).sum(axis=1), 1)
    model.regularizers["smooth"] = SmoothPtdw(0.5, window=4)
    q = model.transform(ndw, "ptdw").toPandas()
    assert len(q) == len(p) and not np.allclose(np.stack(q.p), np.stack(p.p))


def test_classes_are_normalized_apart_and_predicted(spark, corpus):
    ndw, _ = corpus
    tags = ndw.select("item_id").distinct().select("item_id", F.lit("@tag").alias("class_id"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("token"), F.lit(1.0).alias("weight"))
    both = ndw.unionByName(tags)
    model = TopicModel(3, D.gather(both), class_weights={DEFAULT_CLASS: 1.0, "@tag": 50.0}).fit_offline(both, 5)
    for c in (DEFAULT_CLASS, "@tag"):
        assert np.allclose(model.m.pwt[model.m.classes == c].sum(axis=0), 1)
    got = model.predict(both, "@tag").groupBy("item_id").agg(F.sum("p").alias("p")).collect()
    assert len(got) == 60 and all(abs(r.p - 1) < 1e-9 for r in got)


def test_lda_is_the_model_with_its_regularizers(corpus):
    ndw, d = corpus
    a = Lda(3, d, alpha=0.1, beta=0.02).fit_offline(ndw, 2)
    b = TopicModel(3, d, regularizers={"t": SmoothSparseTheta(0.1), "p": SmoothSparsePhi(0.02)}).fit_offline(ndw, 2)
    assert np.allclose(a.m.pwt, b.m.pwt) and len(a.get_top_tokens(3)[0]) == 3
    with pytest.raises(ValueError):
        Lda(3, d, beta=[1.0])


def test_hierarchy(corpus):
    ndw, d = corpus
    h = Hierarchy()
    h.add_level(TopicModel(2, d))
    with pytest.raises(ValueError):
        h.add_level(TopicModel(3, d))
    h.add_level(TopicModel(3, d, seed=5, regularizers={"h": HierarchySparsingTheta(0.1)}))
    h.fit_offline(ndw, 1)
    psi = h.get_psi(1)
    assert psi.shape == (3, 2) and np.allclose(psi.sum(axis=0), 1)
    assert h.get_phi().shape[1] == 5 and h.transform(ndw).select("topic").distinct().count() == 5


def test_nothing_to_process(corpus):
    ndw, d = corpus
    with pytest.raises(ValueError):
        TopicModel(2, d).fit_offline(ndw.limit(0))
    with pytest.raises(ValueError):
        TopicModel(2, d).fit_offline(ndw.limit(5).withColumn("token", F.lit("?")))


def test_config_round_trip(corpus):
    ndw, d = corpus
    c = ModelConfig(["a", "b"], regularizers={"x": {"type": "SmoothSparsePhi", "tau": -0.5, "gamma": 0.2}}, scores={"top": {"type": "TopTokens", "num_tokens": 3}})
    again = ModelConfig.from_json(c.to_json())
    assert again == c and len(again.build(d).fit_offline(ndw).history[0]["top"]["tokens"]["a"]) == 3
    with pytest.raises(ValueError):
        ModelConfig(["a"], regularizers={"x": {"type": "SmoothSparsePhi", "gamma": 2}})
    name, r = regularizer("0.5 SparsePhi #obj @default_class", {"obj": ["obj_0", "obj_1"]})
    assert r.tau == -0.5 and r.topics == ["obj_0", "obj_1"] and r.classes == ["@default_class"]


def test_command_line(spark, tmp_path, corpus):
    (tmp_path / "c.vw").write_text("".join(f"d{i} a{i % 3}:2 b{i % 2} c |@tag t{i % 2}\n" for i in range(20)))
    out = lambda n: f"{tmp_path}/{n}"
    args = f"-c {out('c.vw')} -t obj:3;bg -p 3 --use-modality @default_class:1;@tag:5 --save-dictionary {out('dict')} --save-model {out('model')} --save-model-readable {out('readable')} --write-predictions {out('theta')} --predict-class @tag --write-class-predictions {out('cls')} --write-scores {out('scores')} --write-cooc-tf {out('cooc')} --write-ppmi-tf {out('ppmi')} --score Perplexity --score ClassPrecision --final-score SparsityPhi --write-vw-corpus {out('vw')} --save-batches {out('batches')}"
    model = cli.main([*args.split(), "--regularizer", "0.1 SparsePhi #obj"], spark)
    assert model.topics == ["obj_0", "obj_1", "obj_2", "bg"] and len(model.history) == 3
    theta = spark.read.option("header", True).csv(out("theta"), sep=";")
    assert theta.columns[:2] == ["id", "title"] and theta.count() == 20
    assert spark.read.option("header", True).csv(out("cls"), sep=";").count() == 20
    assert spark.read.parquet(out("dict")).count() == 8 and spark.read.text(out("cooc")).count() > 3
    assert model.history[0]["Perplexity"]["value"] == pytest.approx(model.history[0]["perplexity"]) and model.history[-1]["SparsityPhi"]["total_tokens"] > 0
    lines = {r.value.split(" ")[0]: r.value for r in spark.read.text(out("cooc")).collect()}
    assert not any("t0" in x or "t1" in x for x in lines.values()) and "b0:" in lines["a0"]  # a title's one tag meets no token of another modality
    assert cli.main(["--use-batches", out("batches"), "-t", "2", "-p", "1"], spark).updates == 1
    with pytest.raises(SystemExit):
        cli.main(["-c", out("c.vw"), "-t", "2", "-p", "1", "--regularizer", "1 ImproveCoherence"], spark)
    plain = cli.main(["-c", out("c.vw"), "-t", "2", "-p", "1"], spark)
    coherent = cli.main(["-c", out("c.vw"), "-t", "2", "-p", "1", "--read-cooc", out("cooc"), "--regularizer", "1000 ImproveCoherence"], spark)
    assert not np.allclose(plain.m.pwt, coherent.m.pwt)
    online = cli.main(["-c", out("vw"), "-t", "2", "-p", "1", "--update-every", "5"], spark)
    assert online.updates == 4
    assert cli.main(["-c", out("c.vw")], spark) is None


def test_stream_learns_as_online(spark, tmp_path, corpus):
    from thema.streaming.online import learn

    ndw, d = corpus
    for i in range(3):
        ndw.where(f"item_id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    model = TopicModel(3, d)
    stream = spark.readStream.schema(ndw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    learn(stream, model, lambda b: b, f"{tmp_path}/check", 1.0, 0.5).trigger(availableNow=True).start().awaitTermination()
    other = TopicModel(3, d).fit_online([ndw.where(f"item_id % 3 = {i}") for i in range(3)], 1.0, 0.5)
    assert model.updates == 3 and np.allclose(model.m.nwt.sum(), other.m.nwt.sum())


def test_relational_theta_of_items_without_known_tokens(spark, corpus):
    ndw, d = corpus
    phi = TopicModel(2, d).matrix(spark)
    other = spark.createDataFrame([(1, DEFAULT_CLASS, "?", 1.0)], "item_id long, class_id string, token string, weight double")
    theta = estep.theta_pass(other, phi, estep.uniform_theta(other, ["topic_0", "topic_1"]))
    assert [r.value for r in theta.collect()] == [0.5, 0.5]


def test_online_weights_by_hand(corpus):
    """rho_i = (tau0 + i) ** -kappa, i from 1 over the model's online updates; offline passes don't count."""
    ndw, d = corpus
    model = TopicModel(2, d).fit_offline(ndw, 2)
    before = model.m.nwt.copy()
    one = model._pass(model.encode(ndw))[0]
    model.fit_online([ndw], tau0=1.0, kappa=0.5)
    rho = 2**-0.5
    assert np.allclose(model.m.nwt, (1 - rho) * before + rho * one) and model.online_updates == 1 and model.updates == 3
    before = model.m.nwt.copy()
    one = model._pass(model.encode(ndw))[0]
    model.fit_online([ndw], tau0=1.0, kappa=0.5)
    assert np.allclose(model.m.nwt, (1 - 3**-0.5) * before + 3**-0.5 * one)


def test_batch_weights_reach_the_model(corpus):
    """n_wt of a source counts times its weight; Theta doesn't feel it."""
    from thema.sources.vectorizer import union_sources

    ndw, d = corpus
    a, b = ndw.where("item_id % 2 = 0"), ndw.where("item_id % 2 = 1")
    both, first, second = (TopicModel(2, d) for _ in range(3))
    weighted = both._pass(both.encode(union_sources([(a, 1.0), (b, 0.25)])))[0]
    assert np.allclose(weighted, first._pass(first.encode(a))[0] + 0.25 * second._pass(second.encode(b))[0])
    same = union_sources([(a, 1.0), (a, 3.0)])
    assert np.allclose(both._pass(both.encode(same))[0], 4 * first._pass(first.encode(a))[0])


def test_partial_sums_in_a_tree(corpus, monkeypatch):
    import thema.plans.model as module

    ndw, d = corpus
    want = TopicModel(2, d).fit_offline(ndw, 1)
    monkeypatch.setattr(module, "FAN", 2)
    got = TopicModel(2, d)
    got.fit_offline(got.encode(ndw).repartition(7), 1)
    assert np.allclose(got.m.nwt, want.m.nwt) and got.history[0]["perplexity"] == pytest.approx(want.history[0]["perplexity"])


def test_cumulative_scores(spark, corpus):
    from thema.operators.cumulative import ClassPrecision, CumulativeScore, Perplexity, SparsityTheta, ThetaSnippet

    class Words(CumulativeScore):
        def append(self, state, ids, batch, phi, theta):
            return self.merge(state, {"words": float(batch.weight.sum())})

    ndw, d = corpus
    tags = ndw.select("item_id").distinct().select("item_id", F.lit("@tag").alias("class_id"), F.lit("t").alias("token"), F.lit(1.0).alias("weight"))
    both = ndw.unionByName(tags)
    scores = {"all": Perplexity(), "own": Perplexity([DEFAULT_CLASS]), "tag": ClassPrecision("@tag"), "theta": SparsityTheta(), "some": ThetaSnippet(item_ids=[3]), "words": Words()}
    model = TopicModel(3, D.gather(both), scores=scores).fit_offline(both, 1)
    h = model.history[0]
    assert h["all"]["value"] == pytest.approx(h["perplexity"]) and h["own"]["value"] > h["all"]["value"]
    assert h["tag"] == {"error": 0, "total": 60, "value": 1.0} and h["theta"]["value"] == h["sparsity_theta"] and list(h["some"]) == [3]
    assert h["words"]["words"] == both.agg(F.sum("weight")).first()[0] and model.get_score("words") == h["words"]


def test_reshaped_tokens_count_with_phi_one(corpus):
    ndw, d = corpus
    some = d.where("df >= 10")
    model = TopicModel(2, some, document_passes=3).fit_offline(ndw, 1)
    theta = {r.item_id: np.array(r.theta) for r in model.transform(ndw).collect()}
    model.reshape_tokens(d)
    again = {r.item_id: np.array(r.theta) for r in model.transform(ndw).collect()}
    assert all(np.allclose(theta[i], again[i]) for i in theta)
    nwt = model._pass(model.encode(ndw))[0]
    i = int(np.flatnonzero(model._fresh)[0])
    rows = ndw.where((F.col("token") == model.m.tokens[i])).collect()
    assert np.allclose(nwt[i], sum(r.weight * theta[r.item_id] for r in rows))
    model.fit_offline(ndw, 1)
    assert model._fresh is None and model.m.pwt[i].any()


def test_process_accumulates(corpus):
    ndw, d = corpus
    model = TopicModel(2, d)
    model.process(ndw)
    once = model.m.nwt.copy()
    model.process(ndw, reset_nwt=False)
    assert np.allclose(model.m.nwt, 2 * once)
    model.normalize()
    model.attach("pwt")[0, 0] = 0.5
    assert model.m.pwt[0, 0] == 0.5
    model.dispose()
    assert model.m.tokens.size == 0


def test_saved_models_go_on(spark, corpus, tmp_path):
    """Regularizers, scores, Theta, parents and kinds of models come back."""
    from thema.operators.cumulative import Perplexity

    ndw, d = corpus
    regs = {"r": SmoothSparsePhi(-0.5, dictionary={(DEFAULT_CLASS, "a"): 2.0}), "t": SmoothSparseTheta(-0.1, alpha_iter=[1.0, 0.5]), "c": ImproveCoherencePhi(0.1, cooc={(DEFAULT_CLASS, "a", "b"): 1.0})}
    model = TopicModel(2, d, regularizers=regs, scores={"p": Perplexity(), "top": TopTokens(3)}, reuse_theta=True).fit_offline(ndw, 1)
    model.save(spark, f"{tmp_path}/m")
    again = TopicModel.load(spark, f"{tmp_path}/m")
    assert again.regularizers == model.regularizers and again.scores == model.scores
    model.export_score_tracker(spark, f"{tmp_path}/tracker")
    again.history = []
    again.import_score_tracker(spark, f"{tmp_path}/tracker")
    assert again.score_tracker == model.score_tracker
    for m in (model, again):
        m.fit_offline(ndw, 1)
    assert np.allclose(model.m.pwt, again.m.pwt) and again.history[-1]["p"] == model.history[-1]["p"]
    Lda(2, d, alpha=0.3).fit_offline(ndw, 1).save(spark, f"{tmp_path}/lda")
    assert isinstance(TopicModel.load(spark, f"{tmp_path}/lda"), Lda) and TopicModel.load(spark, f"{tmp_path}/lda").alpha == 0.3
    h = Hierarchy()
    h.add_level(TopicModel(2, d))
    h.add_level(TopicModel(3, d, seed=1))
    h.fit_offline(ndw, 1).save(spark, f"{tmp_path}/h")
    assert np.allclose(Hierarchy.load(spark, f"{tmp_path}/h").get_psi(1), h.get_psi(1))


def test_stream_goes_on_after_a_restart(spark, tmp_path, corpus):
    """A new process (a new model) takes up the state, and ends as one that never stopped."""
    from thema.streaming.online import learn

    ndw, d = corpus
    whole = TopicModel(2, d)
    for i in range(4):
        part = ndw.where(f"item_id % 4 = {i}").coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
        whole.fit_online([part], 1.0, 0.5)
        if i % 2:
            model = TopicModel(2, d)
            stream = spark.readStream.schema(ndw.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
            learn(stream, model, lambda b: b, f"{tmp_path}/check", 1.0, 0.5).trigger(availableNow=True).start().awaitTermination()
    assert model.online_updates == 4 and np.allclose(model.m.nwt.sum(), whole.m.nwt.sum()) and len(list((tmp_path / "check" / "model").iterdir())) == 2
