import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from thema.llm.langid import fit, identify, train, viterbi, word_scripts


@pytest.mark.parametrize("seed", range(30))
def test_viterbi_against_all_paths(seed):
    r = np.random.default_rng(seed)
    s = int(r.integers(2, 4))
    first = np.append(0, np.cumsum(r.integers(0, 8, 5)))
    scores, penalty = r.normal(size=(first[-1], s)) * 2, float(r.choice([0.5, 2.0, 5.0]))
    path = viterbi(scores, first, penalty, block=int(r.choice([1, 2, 3, 64])))
    for d in range(5):
        x, own = scores[first[d] : first[d + 1]], path[first[d] : first[d + 1]]
        value = lambda p, x=x: sum(x[i, p[i]] for i in range(len(p))) - penalty * sum(p[i] != p[i - 1] for i in range(1, len(p)))
        if len(x):
            assert abs(value(own) - max(map(value, itertools.product(range(s), repeat=len(x))))) < 1e-9


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where("doc_id % 2 = 0"))
    got = identify(docs, model).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    test = got[got.doc_id % 2 == 1]
    assert (test.lang == test.language).mean() > 0.97
    for r in got.itertuples():
        ends = [0, *(x["end"] for x in r.spans)]
        assert [x["first"] for x in r.spans] == ends[:-1] and ends[-1] == r.words


def mixed():
    en, ru = "the quick brown fox jumps over the lazy dog and runs home", "быстрая лиса прыгает через ленивую собаку и бежит домой"
    de = "der schnelle braune fuchs springt über den faulen hund und läuft heim"
    return en, ru, de, fit(pa.array([en] * 3 + [ru] * 3 + [de] * 3), ["en"] * 3 + ["ru"] * 3 + ["de"] * 3)


def test_mixed_and_edges(spark):
    en, ru, de, model = mixed()
    rows = [(1, f"{en} {de} {ru} {en}"), (2, None), (3, ""), (4, "12 34"), (5, "?!"), (6, "漢字 漢字"), (7, f"{en} 2024 {en}"), (None, ru), (8, (en + " ") * 5000)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame([(*r, "xx") for r in rows], "doc_id long, text string, language string"), model).collect()}
    assert [(s["first"], s["end"], s["language"]) for s in got[1].spans] == [(0, 12, "en"), (12, 24, "de"), (24, 33, "ru"), (33, 45, "en")]
    assert got[1].language == "en" and got[None].language == "ru" and len(got[8].spans) == 1 and got[8].words == 60_000
    assert all(got[i].language == "und" for i in (2, 3, 4, 5, 6)) and got[2].spans == [] and len(got[6].spans) == 1
    assert len(got[7].spans) == 1 and got[7].language == "en"


def test_no_languages_and_empty(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    model = train(df)
    assert identify(df, model).first().language == "und"
    assert identify(df.limit(0), mixed()[3]).collect() == []


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(7, f"word{i}", "en") for i in range(50)] + [(None, "mot", "fr")] * 30, "doc_id long, text string, lang string")
    assert train(df, sample=5).languages == ["en", "fr"]


def plain_words(text):
    return [m.group().decode() for m in re.finditer(rb"[0-9a-z\x80-\xff]+", text.encode())]


def plain_spans(model, text, penalty=8.0):
    """Labels of a text's words by plain loops: scripts, sums over trigrams, and Viterbi one word after the other."""
    names, out = [*model.languages, "und"], []
    for word in plain_words(text.lower()):
        script = int(word_scripts(np.frombuffer(word.encode(), np.uint8), np.zeros(1, np.int64))[0])
        raw, row = word.encode() + b"\0", [0.0] * len(names)
        allowed = model.uses[script]
        for j in range(len(names) - 1):
            for i in range(len(raw)):
                two, one = (raw[i - 2] if i > 1 else 0), (raw[i - 1] if i else 0)
                row[j] += float(model.logs[((raw[i] | one << 8 | two << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 16, j])
            if not allowed[j]:
                row[j] = -50.0
        if allowed.any():
            row[-1] = -50.0
        out.append([0.0] * (len(names) - 1) + [1e-6] if script == 0 else row)
    best, back = [0.0] * len(names), []
    for row in out:
        top = max(range(len(names)), key=lambda j: best[j])
        came = [j if best[j] >= best[top] - penalty else top for j in range(len(names))]
        best = [max(best[j], best[top] - penalty) + row[j] for j in range(len(names))]
        back.append(came)
    return out, max(best, default=0.0)


def test_query_against_plain_python(spark, sf_dir):
    """op7_language_id over the whole table: every text's labels have the best score that plain loops find, and the language is that of most words."""
    import __spark_entry__ as entry

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    names = [*model.languages, "und"]
    got = {r.doc_id: r for r in entry.queries()["op7_language_id"](spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        scores, best = plain_spans(model, r.text or "")
        spans = got[r.doc_id].spans
        labels = [names.index(x["language"]) for x in spans for _ in range(x["first"], x["end"])]
        assert len(labels) == len(scores) == got[r.doc_id].words and all(a["language"] != b["language"] for a, b in zip(spans, spans[1:]))
        value = sum(s[j] for s, j in zip(scores, labels)) - 8.0 * (max(1, len(spans)) - 1)
        assert abs(value - best) < 1e-3 + 1e-6 * abs(best)
        most = Counter(names[j] for j in labels)
        assert got[r.doc_id].language == (min(most, key=lambda x: (-most[x], names.index(x))) if most else "und")


def test_long_text_and_ids_of_other_types(spark):
    en, ru, de, model = mixed()
    df = spark.createDataFrame([("x", (en + " ") * 20_000 + de)], "doc_id string, text string")
    got = identify(df, model).first()
    assert got.doc_id == "x" and got.words == 240_012 and [s["language"] for s in got.spans] == ["en", "de"]
