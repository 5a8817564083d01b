"""Queries over whole documents: words of all scripts, every document's pairs."""

from collections import Counter

from thema.functions.columns import words
from thema.plans import queries as Q

TEXTS = {1: "Été à la plage, été 2024", 2: "Москва и été", 3: "", 4: "la x_1 la"}


def _tables(spark, path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, "plage la")], "conv_id long, turn int, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def _pairs(names=None):
    import re

    out = Counter()
    for text in TEXTS.values():
        w = re.findall(r"\w+", text.lower())
        for i, u in enumerate(w):
            for v in w[i + 1 : i + 6]:
                out[u, v] += 1
                out[v, u] += 1
    return out


def test_words(spark):
    got = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").orderBy("doc_id").select(words("text").alias("w")).collect()
    assert [r["w"] for r in got] == [["été", "à", "la", "plage", "été", "2024"], ["москва", "и", "été"], [], ["la", "x_1", "la"]]


def test_pairs_of_documents(spark, tmp_path):
    d = _tables(spark, tmp_path)
    got = {(r["u"], r["v"]): r["tf"] for r in Q.queries()["cooc_tf_df_documents"](spark, d).collect()}
    assert got == dict(_pairs())


def test_coherence_counts_documents(spark, tmp_path):
    d = _tables(spark, tmp_path)
    n, pairs = Q.start_counters(Q._doc_dict(spark, d)).collect(), _pairs()
    for topic, got in ((r["topic"], r["coherence"]) for r in Q.queries()["score_coherence"](spark, d).collect()):
        top = [t for _, t in sorted(((r["value"], r["token"]) for r in n if r["topic"] == topic and r["value"] > 0), reverse=True)[:10]]
        want = sum(pairs[a, b] for i, a in enumerate(top) for b in top[i + 1 :])
        assert got == round(2.0 / (len(top) * (len(top) - 1)) * want, 6)


def test_dictionary_of_lists(spark, tmp_path):
    from thema.operators import dictionary as D
    from thema.plans.corpus import bow, table

    d = _tables(spark, tmp_path)
    want = D.gather(bow(table(spark, d, "documents"), split=words))
    assert sorted(Q._doc_dict(spark, d).collect()) == sorted(want.collect())


def test_fitted_corpus_has_all_scripts(spark, tmp_path):
    from thema.plans import fitted

    d = _tables(spark, tmp_path)
    ndw = fitted._corpus(spark, d)[0]
    assert {r["token"] for r in ndw.collect()} == {"été", "à", "la", "plage", "2024", "москва", "и", "x_1"}
