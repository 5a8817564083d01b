import itertools
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from thema.llm.quality import keep_good, likelihood, line_features, marginals, score_quality, train
from thema.llm.text import as_bytes

from .plain import plain_words


@pytest.mark.parametrize("seed", range(10))
def test_forward_backward_against_all_labellings(seed):
    r = np.random.default_rng(seed)
    first = np.append(0, np.cumsum(r.integers(0, 6, 4)))
    unary, trans = r.normal(size=(first[-1], 2)) * 3, r.normal(size=(2, 2))
    p, joint, z = marginals(unary, trans, first, pairs=True)
    want, pairs, logs = np.zeros(first[-1]), np.zeros((2, 2)), 0.0
    for d in range(4):
        a, b = first[d], first[d + 1]
        if a == b:
            continue
        every = list(itertools.product((0, 1), repeat=b - a))
        score = np.array([sum(unary[a + i, y[i]] for i in range(b - a)) + sum(trans[y[i - 1], y[i]] for i in range(1, b - a)) for y in every])
        weight = np.exp(score - score.max())
        logs += np.log(weight.sum()) + score.max()
        weight /= weight.sum()
        for y, w in zip(every, weight):
            want[a:b] += w * np.array(y)
            for i in range(1, b - a):
                pairs[y[i - 1], y[i]] += w
    assert np.allclose(p, want) and np.allclose(joint, pairs) and np.isclose(z, logs)


def test_features_of_lines():
    import pyarrow as pa

    data, offsets = as_bytes(pa.array(["One line.\n\n  \nTWO!! TWO!!\n", None, "", "x"]))
    x, size, first = line_features(data, offsets)
    assert first.tolist() == [0, 2, 2, 2, 3] and size.tolist() == [10, 12, 1] and x[1, 0] > 0.9 and x[0, 0] < 0.2


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{os.path.dirname(sf_dir)}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs, labels.where("doc_id % 2 = 0")).toPandas().merge(labels.where("doc_id % 2 = 1").toPandas(), on="doc_id", suffixes=("", "_label"))
    good, bad = got[got.quality_label == 1], got[got.quality_label == 0]
    assert good.good.mean() > 0.97 and bad.good.mean() < 0.25


def small(spark):
    good = "This is a calm sentence about the weather.\nIt goes on for a while, as such texts do."
    bad = "BUY!!! NOW!!! ###\n$$$ %%% &&& ***\nFREE!!! FREE!!! FREE!!!"
    rows = [(i, (good if i % 2 else bad) + f" {i}") for i in range(40)] + [(90, None), (91, ""), (92, " \n "), (None, good), (1, good), (93, (good + "\n") * 3000)]
    docs = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, score double, good boolean")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (90, 1)], "doc_id long, quality int")


def test_edges(spark):
    docs, labels = small(spark)
    got = score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in (90, 91, 92):
            assert r.quality == 0 and not r.good
        else:
            assert r.good == (r.doc_id is None or r.doc_id % 2 == 1)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.good for r in got)
    assert score_quality(docs.limit(0), labels).collect() == []


def test_one_class_or_no_labels(spark):
    docs, labels = small(spark)
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert {r.doc_id for r in score_quality(docs, some).where("NOT good").collect()} == {90, 91, 92}


def test_sample_is_bounded(spark):
    docs, labels = small(spark)
    assert train(docs, labels, sample=3).weights.shape == train(docs, labels).weights.shape


def test_ids_of_other_types(spark):
    docs, labels = small(spark)
    text = lambda df: df.withColumn("doc_id", F.concat(F.lit("a-"), F.col("doc_id")))
    got = {r.doc_id: r.good for r in score_quality(text(docs), text(labels)).collect()}
    assert got["a-3"] and not got["a-4"]


def test_gradient_by_finite_differences():
    r = np.random.default_rng(4)
    first = np.array([0, 3, 3, 8, 9])
    x, y, weight = r.normal(size=(9, 4)), r.integers(0, 2, 9), np.array([0.5, 1.0, 2.0, 3.0])
    w, trans = r.normal(size=4), r.normal(size=(2, 2))
    at = lambda v: likelihood(v[:4], v[4:].reshape(2, 2), x, y, first, weight, 0.1)[0]
    v, h = np.append(w, trans.ravel()), 1e-6
    _, by_w, by_trans = likelihood(w, trans, x, y, first, weight, 0.1)
    want = [(at(v + h * e) - at(v - h * e)) / (2 * h) for e in np.eye(8)]
    assert np.allclose(np.append(by_w, by_trans.ravel()), want, atol=1e-6)


def plain_features(text):
    """Features of one text's lines, by plain loops over its bytes."""
    lines, digests = [], Counter()
    for part in text.encode().split(b"\n")[: None if text else 0]:
        lines.append(part)
    raw = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines and lines[-1] else [])
    raw = [x for x in raw if any(chr(c) not in " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" or c >= 0x80 for c in x)]
    digests.update(x.removesuffix(b"\n") for x in raw)
    out = []
    for x in raw:
        n = Counter()
        for b in x:
            c = chr(b)
            n["lead" if b >= 0xC0 else "rest" if b >= 0x80 else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "space" if c.isspace() else "stop" if c in ".,;:'\"?-()" else "!" if c == "!" else "code" if c in "<>{}[]|\\/=_" else "other"] += 1
        size, trimmed = len(x), x.removesuffix(b"\n")
        chars, tokens = size - n["space"] - n["rest"], n["space"] + 1 - x.endswith(b"\n")
        letters = n["lower"] + n["upper"] + n["lead"] + 1e-9
        words = plain_words(bytes(c + 32 if 65 <= c <= 90 else c for c in x).decode())
        again = sum(a == b for a, b in zip(words, words[1:]))
        last = (trimmed or x)[-1:]
        out.append([
            n["upper"] / letters, n["digit"] / chars, n["stop"] / tokens, n["other"] / tokens, n["lead"] / chars, n["!"] / tokens, n["code"] / tokens, math.log1p(size) / 5, math.log1p(tokens) / 4,
            min(chars / tokens, 30) / 10, float(last in (b".", b"!", b"?", b'"', b"'", b")")), float(digests[trimmed] > 1), float(tokens < 3), again / max(1, len(words)), min((n["other"] + n["!"] + n["code"]) / chars, 1),
        ])
    return out, [len(x) for x in raw]


def plain_quality(model, text):
    own, sizes = plain_features(text or "")
    if not own:
        return 0.0
    none = [0.0] * 15
    good = [float(np.dot(own[i] + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(own) else none) + [1.0], model.weights)) for i in range(len(own))]
    score = [[0.0, g] for g in good]
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    t, n = model.trans, len(own)
    ahead, back = [score[0]], [[0.0, 0.0]]
    for i in range(1, n):
        ahead.append([score[i][k] + add(ahead[-1][0] + t[0, k], ahead[-1][1] + t[1, k]) for k in (0, 1)])
    for i in range(n - 2, -1, -1):
        back.append([add(t[k, 0] + score[i + 1][0] + back[-1][0], t[k, 1] + score[i + 1][1] + back[-1][1]) for k in (0, 1)])
    back.reverse()
    p = [1 / (1 + math.exp(min(700, ahead[i][0] + back[i][0] - ahead[i][1] - back[i][1]))) for i in range(n)]
    return sum(a * b for a, b in zip(p, sizes)) / sum(sizes)


def test_query_against_plain_python(spark, sf_dir):
    """op9_quality over the whole table, row by row against features, forward-backward and weights in plain Python."""
    import __spark_entry__ as entry

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = train(docs, labels)
    got = {r.doc_id: r for r in entry.queries()["op9_quality"](spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        q = plain_quality(model, r.text)
        assert abs(got[r.doc_id].quality - q) < 1e-6 and (got[r.doc_id].good == (q >= model.threshold) or abs(q - model.threshold) < 1e-6)
