from collections import Counter
from pathlib import Path

import corpus_pipeline
from thema.llm.quality import train
from thema.storage import scratch, shared_root

from .plain import plain_words
from .test_packing import brute
from .test_quality import plain_quality


def plain_grams(text, k=3):
    w = plain_words(text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def shares(text, items):
    """Whether a text has 13 words in a row with an item in common (or all of an item of 8 to 12)."""
    w = plain_words(text.lower())
    return any(tuple(w[i : i + n]) in grams for n, grams in items.items() for i in range(len(w) - n + 1))


def test_stages_on_a_table(spark, sf_dir, tmp_path):
    """Every stage, on what the stage before kept, against plain Python that uses nothing of the stages but the fitted weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {"documents": docs.toPandas()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = docs.toPandas()
    order = ["documents", *(n for n, _ in corpus_pipeline.STAGES)]
    quality, exact, near, clean, packed = (kept[n] for n in order[1:])

    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    start = kept["documents"]
    q = start.text.map(lambda t: plain_quality(model, t))
    assert (abs(q - model.threshold) > 1e-6).all()
    assert sorted(quality.doc_id) == sorted(start.doc_id[q >= model.threshold])
    assert len(quality) < len(start)

    assert sorted(exact.doc_id) == sorted(quality.sort_values("doc_id").drop_duplicates("text").doc_id)

    sets = [plain_grams(t) for t in exact.text]
    alive = set(near.doc_id)
    ids = exact.doc_id.tolist()
    like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(len(ids)) for j in range(i)}
    pairs = [(ids[i], ids[j]) for (i, j), x in like.items() if x >= 0.55]
    assert pairs and sum(a in alive and b in alive for a, b in pairs) <= 0.1 * len(pairs)
    lonely = [ids[i] for i in range(len(ids)) if all(like[max(i, j), min(i, j)] < 0.35 for j in range(len(ids)) if j != i)]
    assert set(lonely) <= alive

    items: dict[int, set] = {}
    for text in spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas().text:
        w = plain_words(text.lower())
        n = min(13, len(w))
        if n >= 8:
            items.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    assert sorted(clean.doc_id) == sorted(d for d, t in zip(near.doc_id, near.text) if not shares(t, items))

    words = dict(zip(clean.doc_id, clean.text.str.split().str.len()))
    assert (packed.groupby("doc_id").length.sum() == [words[d] for d in sorted(words)]).all()
    assert Counter(packed.groupby("bin_id").length.sum()) == Counter(map(sum, brute([x for x in packed.length if x], 2048)))

    run = corpus_pipeline.run(spark, sf_dir).toPandas()
    key = ["doc_id", "part"]
    assert run.sort_values(key).reset_index(drop=True).equals(packed.sort_values(key).reset_index(drop=True))


def test_run_and_edges(spark, tmp_path):
    """Nulls, repeated rows, extra columns, empty tables."""
    good = "This is a calm sentence about the weather in {}.\nIt goes on for a while, as such texts about {} do, and ends."
    rows = [(i, good.format(f"a{i} b{i} c{i} d{i} e{i} f{i}", f"g{i} h{i} i{i} j{i} k{i}"), 0.5) for i in range(20)]
    rows += [(50, rows[0][1], 0.5), (0, rows[0][1], 0.5), (None, good.format("null", "nothing"), 0.5), (51, None, None), (52, "", 1.0), (53, "$$$ ### !!! $$$", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for name, n in (("some", 100), ("none", 0)):
        docs.limit(n).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1) for i in range(20)] + [(53, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == set(range(20)) - {3} | {None}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_only_live_tables_remain(spark, sf_dir):
    root = Path(shared_root(spark).removeprefix("file://"))
    before = set(root.iterdir()) if root.exists() else set()
    with scratch(spark):
        got = corpus_pipeline.run(spark, sf_dir)
        assert got.count() > 0 and len(set(root.iterdir()) - before) == 1  # the packed lengths
    assert set(root.iterdir()) == before
