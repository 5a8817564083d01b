"""Parsers and writers on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from thema.functions.options import key_values, number_or_rate, topic_groups
from thema.operators import dictionary as D
from thema.sources import nwd, uci, vw, writers
from thema.sources.text import text_to_counts
from thema.sources.vectorizer import only_classes, union_sources

DOCWORD = "2\n3\n6\n1 3 2\n1 1 5\n1 2 3\n2 3 7\n2 2 1\n"


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"{tmp_path}/{name}"


@pytest.mark.parametrize("vocab,want", [("token1\ntoken2\ntoken3\n", {"token1": (5, 1, 5 / 18), "token2": (4, 2, 2 / 9), "token3": (9, 2, 0.5)}), ("token1 class1\ntoken2\ntoken3 class1", {"token1": (5, 1, 5 / 14), "token2": (4, 2, 1.0), "token3": (9, 2, 9 / 14)})])
def test_uci(spark, tmp_path, vocab, want):
    v = uci.read_vocab(spark, write(tmp_path, "v", vocab))
    ndw = uci.read_docword(spark, write(tmp_path, "d", DOCWORD), v)
    got = {r.token: (r.tf, r.df, r.value) for r in D.gather(ndw, v).collect()}
    assert {k: tuple(np.round(x, 9)) for k, x in got.items()} == {k: tuple(np.round(x, 9)) for k, x in want.items()}


@pytest.mark.parametrize("vocab", ["a\n\nb\n", "a\nb\na\n", "a b c\n"])
def test_bad_vocabularies(spark, tmp_path, vocab):
    with pytest.raises(Exception):
        uci.read_vocab(spark, write(tmp_path, "v", vocab)).collect()


@pytest.mark.parametrize("text", ["2\n3\n6\n1 9 2\n", "2\n3\n6\n1 1\n", "2\n3\n6\n1 0 2\n", "0\n3\n6\n", ""])
def test_bad_docwords(spark, tmp_path, text):
    v = uci.read_vocab(spark, write(tmp_path, "v", "a\nb\nc"))
    with pytest.raises(Exception):
        uci.read_docword(spark, write(tmp_path, "d", text), v).collect()


def test_uci_zero_based_and_zero_counts(spark, tmp_path):
    v = uci.read_vocab(spark, write(tmp_path, "v", "a\nb\nc"))
    got = uci.read_docword(spark, write(tmp_path, "d", "% note\n1 3 2\n7 0 1\n7 2 0\n\n7\t1  2.5\n"), v, unity_based=False).collect()
    assert sorted((r.item_id, r.token, r.weight) for r in got) == [(7, "a", 1.0), (7, "b", 2.5)]


def test_matrix_market(spark, tmp_path):
    path = write(tmp_path, "m", "%%MatrixMarket matrix coordinate real general\n2 3 3\n1 1 1\n1 3 2\n2 2 4\n")
    assert sorted((r.item_id, r.token, r.weight) for r in uci.read_docword(spark, path).collect()) == [(1, "0", 1.0), (1, "2", 2.0), (2, "1", 4.0)]
    v = uci.read_mm_vocab(spark, write(tmp_path, "v", "0 human 2\n1 computer 3\n2 time 1\n"))
    assert sorted(r.token for r in uci.read_docword(spark, path, v).collect()) == ["computer", "human", "time"]


VW = "doc1 hello world:2 |author alex:3\ndoc2 |author noname |@default_class hello:5"


def test_vw(spark, tmp_path):
    path = write(tmp_path, "c", VW)  # without a last newline
    want = [("doc1", "@default_class", "hello", 1.0), ("doc1", "@default_class", "world", 2.0), ("doc1", "author", "alex", 3.0), ("doc2", "@default_class", "hello", 5.0), ("doc2", "author", "noname", 1.0)]
    for transactions in (False, True):
        assert sorted((r.title, r.class_id, r.token, r.weight) for r in vw.read_vw(spark, path, transactions).collect()) == want
    assert only_classes(vw.read_vw(spark, path), ["author"]).count() == 2 and only_classes(vw.read_vw(spark, path), None).count() == 5


@pytest.mark.parametrize("line", ["alone", "d :1", "d a:", "d a:x", ""])
def test_bad_vw(spark, tmp_path, line):
    for transactions in (False, True):
        with pytest.raises(Exception):
            vw.read_vw(spark, write(tmp_path, "c", line + "\n"), transactions).collect()


def test_vw_writer(spark):
    ndw = spark.createDataFrame([(1, "a b", "@default_class", "x", 1.0), (1, "a b", "@default_class", "y z", 2.5), (1, "a b", "z", "t", 123456.0), (2, "c", "z", "t", 1.0)], "item_id long, title string, class_id string, token string, weight double")
    assert sorted(r.value for r in vw.vw_lines(ndw).collect()) == ["a_b x y_z:2.5 |z t:123456", "c |z t"]


def test_nwd(spark):
    names = dict(enumerate(["ab", "cd", "ef", "gh"]))
    dense = np.array([[i + j for j in range(5)] for i in range(1, 5)])
    got = {r.token: (r.tf, r.df) for r in D.gather(nwd.from_dense(spark, dense, names)).collect()}
    assert got == {"ab": (15, 5), "cd": (20, 5), "ef": (25, 5), "gh": (30, 5)}
    sparse = np.array([[1, 2, 3, 0, 0], [2, 0, 0, 0, 6], [0, 0, 5, 6, 7], [4, 5, 0, 0, 8]])
    got = {r.token: (r.tf, r.df) for r in D.gather(nwd.from_dense(spark, sparse, names)).collect()}
    assert got == {"ab": (6, 3), "cd": (8, 2), "ef": (18, 3), "gh": (17, 3)}


def test_cooc_files(spark, tmp_path):
    lines = spark.read.text(write(tmp_path, "c", "a b:2 c:3\nb a:9 |@m x:4 y:1\n|@m x y:5\na b:7\n"))
    got = {(r.class_u, r.u, r.class_v, r.v): r.value for r in writers.parse_cooc(lines).collect()}
    d = "@default_class"
    assert got == {(d, "a", d, "b"): 2, (d, "a", d, "c"): 3, (d, "b", d, "a"): 9, (d, "b", "@m", "x"): 4, (d, "b", "@m", "y"): 1, ("@m", "x", "@m", "y"): 5}
    both = {(r.u, r.v): r.value for r in writers.parse_cooc(lines, symmetric=True).collect()}
    assert both["c", "a"] == 3 and both["b", "a"] == 9 and both["y", "x"] == 5
    again = writers.cooc_lines(spark.createDataFrame([("a", "c", 1), ("a", "b", 2)], "u string, v string, tf long"), "tf").collect()
    assert [r.value for r in again] == ["a b:2 c:1"]


def test_dictionary_files(spark, tmp_path):
    d = spark.createDataFrame([("@c", "x", 0.25, 2.0, 1.0), ("@c", "y", 0.75, 6.0, 3.0)], "class_id string, token string, value double, tf double, df double")
    (tmp_path / "d.txt").write_text("\n".join(writers.dictionary_text(d, "dict", 4)))
    again, items = writers.read_dictionary_text(spark, f"{tmp_path}/d.txt")
    assert items == 4 and sorted(map(tuple, again.select(d.columns).collect())) == sorted(map(tuple, d.collect()))
    writers.write_dictionary(d, f"{tmp_path}/p")
    with pytest.raises(Exception):
        writers.write_dictionary(d, f"{tmp_path}/p")


def test_batches(spark, tmp_path):
    docs = spark.range(30).withColumnRenamed("id", "item_id")
    writers.write_batches(docs, f"{tmp_path}/b", 10)
    got = writers.read_batches(spark, f"{tmp_path}/b")
    assert sorted((r.batch_id, r["count"]) for r in got.groupBy("batch_id").count().collect()) == [("aaaaaa", 10), ("aaaaab", 10), ("aaaaac", 10)]
    assert spark.range(1).select(writers.batch_code(F.lit(26**6 - 1)).alias("x")).first().x == "zzzzzz"
    with pytest.raises(Exception):
        spark.range(1).select(writers.batch_code(F.lit(26**6))).collect()


def test_class_table_takes_the_first_of_equals(spark):
    p = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.0), (2, "b", 0.1)], "item_id long, class_token string, p double")
    assert [(r.id, r["class"]) for r in writers.class_table(p).collect()] == [(1, "a"), (2, "b")]


def test_texts_and_sources(spark):
    docs = spark.createDataFrame([(1, "One two. TWO"), (2, None)], "item_id long, text string")
    assert {r.token: r.n for r in text_to_counts(docs).collect()} == {"one": 1, "two": 2}
    both = union_sources([(docs, 1.0), (docs, 0.5)])
    assert sorted(r.batch_weight for r in both.collect()) == [0.5, 0.5, 1.0, 1.0]


def test_options():
    assert number_or_rate("25%") == (None, 0.25) and number_or_rate("0.5") == (None, 0.5) and number_or_rate("7") == (7.0, None)
    assert key_values("a:1;b:2,3") == [("a", 1.0), ("b", 2.0), ("", 3.0)]
    assert topic_groups("obj:2;bg:1") == {"obj": ["obj_0", "obj_1"], "bg": ["bg"]} and topic_groups("3") == {"topic": ["topic_0", "topic_1", "topic_2"]}


def test_filter_bounds(spark):
    d = spark.createDataFrame([("@a", t, 0.0, float(tf), float(df)) for t, tf, df in [("p", 1, 1), ("q", 2, 2), ("r", 3, 2), ("s", 9, 5)]] + [("@b", "p", 0.0, 1.0, 1.0)], "class_id string, token string, value double, tf double, df double")
    names = lambda x: sorted((r.class_id, r.token) for r in x.collect())
    assert names(D.filtered(d, class_id="@a", min_df=2, max_df=5)) == [("@a", "q"), ("@a", "r"), ("@b", "p")]
    assert names(D.filtered(d, max_size=2)) == [("@a", "s")]  # both of equal df at the cut go
    assert names(D.filtered(d, max_size=5)) == names(d)
    assert abs(sum(r.value for r in D.filtered(d, min_tf=2, recalculate_value=True).collect()) - 1) < 1e-12
    pairs = spark.createDataFrame([("@a", "p", "@a", "s", 1.0), ("@a", "q", "@a", "s", 2.0)], "class_u string, u string, class_v string, v string, value double")
    assert [r.value for r in D.filter_cooc(pairs, D.filtered(d, min_df=2)).collect()] == [2.0]


def test_batches_of_lines_with_gaps_and_names(spark, tmp_path):
    """Line numbers of far splits don't run out of batch names."""
    docs = spark.createDataFrame([(i + (40 << 33) * (i > 4), f"d{i}") for i in range(10)], "item_id long, title string")
    writers.write_batches(docs, f"{tmp_path}/code", 3)
    got = {r.title: r.batch_id for r in writers.read_batches(spark, f"{tmp_path}/code").collect()}
    assert got == {f"d{i}": f"aaaaa{'abcd'[i // 3]}" for i in range(10)}
    writers.write_batches(docs, f"{tmp_path}/guid", 5, names="guid")
    ids = {r.batch_id for r in writers.read_batches(spark, f"{tmp_path}/guid").collect()}
    assert len(ids) == 2 and all(len(x) == 36 and x.count("-") == 4 for x in ids)


def test_cooc_triples(spark):
    cooc = spark.createDataFrame([("a", "b", 2.5)], "u string, v string, value double")
    vocab = spark.createDataFrame([(0, "a"), (7, "b")], "word_id long, token string")
    assert [r.value for r in writers.cooc_triples(cooc, vocab).collect()] == ["0 7 2.5"]


def test_header_behind_many_comments(spark, tmp_path):
    (tmp_path / "m.mm").write_text("%%MatrixMarket\n" + "% c\n" * 2500 + "2 3 2\n1 1 5\n2 3 1\n")
    assert sorted((r.item_id, r.token, r.weight) for r in uci.read_docword(spark, f"{tmp_path}/m.mm").collect()) == [(1, "0", 5.0), (2, "2", 1.0)]


@pytest.mark.parametrize("window", [0, 2, 3])
def test_seen_pairs_against_loops(spark, window):
    from thema.operators.cooc import seen_pairs

    docs = [(0, ["b", "a", "c", "a"], [1.0, 2.0, 3.0, 4.0]), (1, ["a", "b"], [5.0, 0.5]), (2, [], []), (3, ["d"], [1.0])]
    want: dict = {}
    for _, t, w in docs:
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + (window or len(t)))):
                key = (t[j], t[i]) if (t[j], t[i]) in want else (t[i], t[j])
                want[key] = want.get(key, 0.0) + min(w[i], w[j])
    got = seen_pairs(spark.createDataFrame(docs, "item_id long, tokens array<string>, weights array<double>"), window)
    assert {(r.u, r.v): r.value for r in got.collect()} == want
