import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from thema.llm.decontam import shared_spans
from thema.llm.near_dedup import near_duplicates
from thema.llm.text import WORD_PATTERN, as_bytes, split_words

from .plain import plain_words

LETTERS = st.one_of(st.sampled_from("ab1 .«»¿\u00a0éß’—。、！Ａ東京かなカไทย々\u3400\U00020000\U0001F600ªμж"), st.characters(exclude_categories=["Cs"], min_codepoint=0x80))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=30), max_size=5))
def test_words_against_plain_python_and_the_pattern(texts):
    data, offsets = as_bytes(pa.array(texts, pa.string()))
    starts, ends, first = split_words(data, offsets)
    raw = data.tobytes()
    got = [[raw[starts[k] : ends[k]].decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert got == [plain_words(t) for t in texts]


def test_pattern_in_sql():
    text = "été «东京» 2024。かな—x ไทย"
    got = duckdb.execute("SELECT regexp_extract_all(?, ?)", [text, WORD_PATTERN]).fetchone()[0]
    assert got == plain_words(text) == ["été", "东", "京", "2024", "か", "な", "x", "ไ", "ท", "ย"]


def test_scripts_without_blanks(spark):
    """A long passage of Han text is found though it has few blanks, and one changed character leaves a near copy one."""
    r = np.random.default_rng(0)
    text = "".join(map(chr, r.integers(0x4E00, 0x9FFF, 300)))
    docs = spark.createDataFrame([(1, f"前{text[40:80]}後。"), (2, text[:200]), (3, text[:100] + "一" + text[101:200]), (4, "。！")], "doc_id long, text string")
    got = shared_spans(docs, spark.createDataFrame([(7, text[30:90])], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.words) for r in got) == [(1, 40), (2, 60), (3, 60)]
    groups = {r.doc_id: r.group_id for r in near_duplicates(docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 2, 4: 4}


def test_trimmed_gives_memory_back_after_the_call(monkeypatch):
    from thema.llm import text

    done = []
    monkeypatch.setattr(text, "trim", lambda: done.append("trim"))
    double = text.trimmed(lambda x, y: done.append("call") or x + y)
    assert double(2, 3) == 5 and done == ["call", "trim"]
