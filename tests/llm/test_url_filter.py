import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from thema.llm.text import as_bytes, lower
from thema.llm.url_filter import NAMES, block_labels, fit, lexical, score_urls, train


def features(url):
    x, _ = lexical(*as_bytes(lower(pa.array([url]))))
    return dict(zip(NAMES, x[0]))


def test_features():
    f = features("https://www.Cheap-1.example.com/a/b9?q=1&r=%20#top")
    assert (f["host length"], f["path length"], f["query length"], f["depth"], f["parameters"]) == (23, 5, 10, 2, 2)
    assert (f["host labels"], f["host hyphens"], f["longest host label"], f["secure"], f["fragment"], f["percent signs"]) == (4, 1, 7, 1, 1, 1)
    text = "www.cheap-1.example.com"
    p = np.array([text.count(c) for c in set(text)]) / len(text)
    assert abs(f["host entropy"] + (p * np.log2(p)).sum()) < 1e-9
    assert features("no-host")["depth"] == 0 and features("")["length"] == 0 and features("a.b/c")["host length"] == 3
    assert features("http://" + "a" * 100_000)["longest host label"] == 100_000


def test_batches_agree_with_single_rows():
    urls = ["https://a.b.c/x?y=1", "", "zzz", "http://q-w.e/r#t", "HTTP://UP.COM"]
    x, s = lexical(*as_bytes(lower(pa.array(urls))))
    for i, u in enumerate(urls):
        one, t = lexical(*as_bytes(lower(pa.array([u]))))
        assert np.allclose(x[i], one[0]) and s[i] == t[0]


def test_learns_a_rule_and_a_function():
    r = np.random.default_rng(0)
    urls = [f"http://site{i}.org/" + "a" * int(r.integers(1, 30)) + "/" * int(r.integers(0, 5)) for i in range(2000)]
    label = np.array([len(u) % 2 == 0 and u.count("/") > 4 or len(u) > 40 for u in urls]).astype(int)
    model = fit(pa.array(urls[:1500]), label[:1500])
    data, offsets = as_bytes(lower(pa.array(urls[1500:])))
    assert ((model.probabilities(data, offsets) > 0.5) == label[1500:]).mean() > 0.9


def plain(url):
    """Features of one URL by plain string operations."""
    def entropy(x):
        n = Counter(x.encode())
        return -sum(c / sum(n.values()) * math.log2(c / sum(n.values())) for c in n.values())

    url = url.lower()
    m = re.match("([^:]*)://", url)
    rest = url[m.end() :] if m else url
    before, mark, _ = rest.partition("#")
    address, _, _ = before.partition("?")
    host, slash, path = address.partition("/")
    path, query = slash + path, before[len(address) :]
    share = lambda x, of: sum(c in of for c in x) / max(1, len(x))
    digits, alnum = "0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"
    return [
        len(url.encode()), len(host), len(path), len(query), path.count("/"), query.count("="), host.count(".") + 1, host.count("-"), share(url, digits), share(host, digits), share(path, digits),
        entropy(host), entropy(path), 1 - share(url, alnum), max(map(len, host.split("."))), share(host, "aeiou"), float(bool(m) and m.end() == 8), float(bool(mark)), url.count("%"),
    ], host.rpartition(".")[2]


def test_query_against_plain_python(spark, sf_dir):
    """op6_url_filter over the whole table: features, suffix statistics over all labelled URLs, and trees walked one URL at a time."""
    import __spark_entry__ as entry

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labelled = pages.select("url", block_labels(pages["url"]).alias("label"))
    model = train(labelled)
    got = {r.page_id: r for r in entry.queries()["op6_url_filter"](spark, sf_dir).collect()}
    urls = {r.url: r.label for r in labelled.collect()}
    n, bad = Counter(plain(u)[1] for u in urls), Counter(plain(u)[1] for u, x in urls.items() if x)
    rate = sum(bad.values()) / len(urls)
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        x, suffix = plain(r.url)
        x = [*x, (bad[suffix] + 20 * rate) / (n[suffix] + 20), math.log((n[suffix] + 1) / (len(urls) + 1))]
        total = model.base
        for f, c, v in zip(model.feature, model.cut, model.value):
            node = 0
            for _ in range(4):
                node = 2 * node + 1 + (x[f[node]] > c[node] + 1e-12)
            total += v[node - len(f)]
        assert abs(got[r.page_id].score - 1 / (1 + math.exp(-total))) < 1e-9 and got[r.page_id].blocked == (got[r.page_id].score >= 0.5)


def test_suffixes_count_beyond_the_sample(spark):
    """Statistics cover all labelled URLs, also those that the trees aren't grown on."""
    rows = [(f"http://a{i}.org/x", 0) for i in range(50)] + [(f"http://b{i}.bad/x", 1) for i in range(50)] + [("http://c.rare/", 1)]
    model = train(spark.createDataFrame(rows, "url string, label int"), sample=5)
    assert len(model.suffixes) == 3 and abs(sum(math.exp(v) for _, v in model.suffixes.values()) - 104 / 102) < 1e-9


def test_held_out_hosts(spark, sf_dir):
    pages = spark.read.parquet(f"{os.path.dirname(sf_dir)}/sf0.1/pages.parquet").withColumn("label", block_labels(F.col("url")))
    host = F.pmod(F.xxhash64(F.regexp_extract("url", "://([^/]+)", 1)), F.lit(3))
    test = pages.where(host == 0)
    got = score_urls(test, train(pages.where(host > 0))).join(test.select("page_id", "label"), "page_id").toPandas()
    assert got[got.label == 1].blocked.mean() > 0.9 and got[got.label == 0].blocked.mean() < 0.02


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "http://x.y", 3), (4, "http://x.y", 3)], "page_id long, url string, score int")
    for labelled in ([("http://a-casino.x", 1), ("http://b.y", 0), (None, 1), ("http://c", None)], [("http://b.y", 0)], []):
        got = score_urls(df, train(spark.createDataFrame(labelled, "url string, label int"))).collect()
        assert len(got) == 4 and all(r.score is None and not r.blocked for r in got if r.page_id in (1, 2)) and not any(r.blocked for r in got if labelled == [])
    assert score_urls(df.limit(0), train(spark.createDataFrame([], "url string, label int"))).collect() == []


def test_block_labels(spark):
    rows = [("http://www.free-bets.com/x", 1), ("casino.org/a", 1), ("http://alphabets.com", 0), ("http://x.com/casino", 0), (None, None)]
    df = spark.createDataFrame(rows, "url string, want int").withColumn("got", block_labels(F.col("url")))
    assert all(r.got == r.want for r in df.collect())
