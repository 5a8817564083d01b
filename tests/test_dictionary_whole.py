"""Fitted queries keep the rarest tokens."""

from thema.plans import fitted


def test_rare_tokens_are_fitted(spark, tmp_path):
    texts = [(i, "common words here") for i in range(12)] + [(12, "unique words")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["token"] for r in fitted._corpus(spark, str(tmp_path))[1].collect()} == {"common", "words", "here", "unique"}
    assert "unique" in {r["token"] for r in fitted.lda(spark, str(tmp_path)).collect()}
