import math
from collections import defaultdict

import numpy as np
import pytest

from thema.llm.ppm import gram_pieces, pack, score_language, unpack
from thema.llm.text import CHUNK


def brute(texts, order):
    """A plain coder with tries of the whole corpus, without what occurs once."""
    trie = defaultdict(lambda: defaultdict(int))
    for t in texts:
        b = bytes(order) + t.encode()
        for i in range(order, len(b)):
            for k in range(order + 1):
                trie[b[i - k : i]][b[i]] += 1
    trie = {c: {s: n for s, n in seen.items() if n >= 2} for c, seen in trie.items()}
    out = []
    for t in texts:
        b, whole = bytes(order) + t.encode(), 0
        for i in range(order, len(b)):
            excluded, bits = set(), 0.0
            for k in range(order, -1, -1):
                seen = trie[b[i - k : i]]
                rest = {s: n for s, n in seen.items() if s not in excluded}
                total, kinds = sum(rest.values()), len(rest)
                if b[i] in rest:
                    bits += math.log2((total + kinds) / rest[b[i]])
                    break
                if kinds:
                    bits += math.log2((total + kinds) / kinds)
                excluded |= set(seen)
            else:
                bits += math.log2(256 - len(excluded))
            whole += round(bits * 1024)  # a byte's code length is a multiple of 1/1024 bit
        out.append(whole / 1024)
    return out


TEXTS = ["the cat sat", "the cat", "a dog ate the cat", "zebra", "the cat sat", "", "ünïcode the", "aaaaaaaaaaaaaab", "x\x00y"]


@pytest.mark.parametrize("order", [1, 2, 4, 6, 7])
def test_against_brute_force(spark, order):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(99, None, 0), (None, "the cat", 0)], "doc_id long, text string, bits int")
    want = brute([*TEXTS, "the cat"], order)  # the row with a null doc_id counts once more
    got = {r.doc_id: r for r in score_language(df, order).collect()}
    assert len(got) == len(TEXTS) + 2
    for i, t in enumerate(TEXTS):
        assert abs(got[i].bits - want[i]) < 1e-3 and got[i].n_bytes == len(t.encode())
    assert got[99].bits == 0 and got[99].bits_per_byte is None and got[5].bits_per_byte is None
    assert abs(got[None].bits - want[1]) < 1e-3


@pytest.mark.parametrize("options", [{}, {"source_rows": 7, "owners": 5, "asked": 50}])
def test_table_against_brute_force(spark, sf_dir, tmp_path, monkeypatch, options):
    """A whole table; also with many sources, trees of sums, owners in parts, and lists that are sent early."""
    import thema.llm.ppm as module

    if options:
        monkeypatch.setattr(module, "FAN", 2)
        monkeypatch.setattr(module, "HELD", 3000)
        monkeypatch.setattr(module, "SOURCES_PER_FOLDER", 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    p = docs.toPandas()
    want = dict(zip(p.doc_id, brute(p.text.tolist(), 6)))
    got = {r.doc_id: r.bits for r in score_language(docs, **options).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 + 1e-6 * want[i] for i in want)


def test_pack_round_trip():
    r = np.random.default_rng(1)
    x = np.sort(r.integers(0, 1 << 56, 1000).astype(np.uint64))
    assert (unpack(pack(x, 7), 1000, 7) == x).all() and len(unpack(pack(x[:0], 7), 0, 7)) == 0


def test_nothing_twice_and_empty(spark):
    one = spark.createDataFrame([(1, "abc"), (2, "xyz")], "doc_id long, text string")
    assert [r.bits_per_byte for r in score_language(one).collect()] == [8.0, 8.0]
    assert score_language(one.limit(0)).collect() == []


def test_copies_are_told_apart(spark):
    """Texts that stand twice cost less than those that stand once."""
    r = np.random.default_rng(3)
    texts = ["".join(map(chr, r.integers(97, 123, 300))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:40])]
    got = score_language(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id").bits_per_byte
    assert max(got[i] for i in [*range(40), *range(1000, 1040)]) < 2 < min(got[i] for i in range(40, 300))


def test_long_text_in_pieces():
    r = np.random.default_rng(0)
    data = r.integers(97, 100, 9 * CHUNK).astype(np.uint8)
    offsets = np.array([0, 10, 10, 10 + 8 * CHUNK, 9 * CHUNK])
    counts = np.zeros(4, np.int64)
    for grams, first, row in gram_pieces(data, offsets, 2):
        for i in range(len(first) - 1):
            counts[row + i] += first[i + 1] - first[i]
    assert counts.tolist() == np.diff(offsets).tolist()
    parts = [g for g, _, _ in gram_pieces(data, offsets, 2)]
    every = np.concatenate(parts)
    at = 10 + 5 * CHUNK
    assert every[at] == int(data[at - 2]) << 16 | int(data[at - 1]) << 8 | int(data[at]) and every[10] == data[10]


def test_junk_costs_more(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = docs.unionAll(spark.createDataFrame([(-1, "qzx%%jq#vw@@kk~~xjq&Q9!0Zq^W(7)Jx[Y]4{V}8")], "doc_id long, text string"))
    got = score_language(both).toPandas().set_index("doc_id").bits_per_byte
    assert got[-1] > got.median() + 1
