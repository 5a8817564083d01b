"""Language identification of mixed text: script ranges, word scores and Viterbi over words.

A word's script (of its first character) narrows the languages to those that use it; within them
byte-trigram log-likelihoods score the word. Viterbi with a penalty for each change of language
labels all words of a document; runs of one label are its spans. Words in a script that no known
language uses are labelled "und". Digits say nothing about the language and take that of their neighbours.

The model is fitted on texts of known language, a bounded number of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import as_bytes, chunks, lower, word_bounds

#: Texts of each language that the model is fitted on, at most: those with the least hash of doc_id.
SAMPLE = 500
#: Cost of a change of language, in nats.
PENALTY = 8.0
BUCKETS = 1 << 16
BLOCK = 64
#: Share of a language's words from which a script counts as its own.
SCRIPT_SHARE = 0.02
UNKNOWN = "und"

SCRIPTS = ["none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "thai", "hangul", "kana", "han", "other"]
#: Ends of code point ranges and the script up to each.
_RANGES = [
    (0x2F, 0), (0x39, 0), (0x40, 0), (0x5A, 1), (0x60, 0), (0x7A, 1), (0xBF, 0), (0x24F, 1), (0x36F, 11), (0x3FF, 2), (0x52F, 3), (0x58F, 11), (0x5FF, 4),
    (0x6FF, 5), (0x74F, 11), (0x77F, 5), (0x8FF, 11), (0xDFF, 6), (0xE7F, 7), (0x10FF, 11), (0x11FF, 8), (0x1DFF, 11), (0x1EFF, 1), (0x1FFF, 2), (0x303F, 0), (0x30FF, 9),
    (0x318F, 8), (0x33FF, 9), (0x9FFF, 10), (0xABFF, 11), (0xD7FF, 8), (0xF8FF, 11), (0xFAFF, 10), (0x1FFFF, 11), (0x3FFFF, 10), (0x10FFFF, 11),
]
_ENDS, _SCRIPT = np.array([r[0] for r in _RANGES]), np.array([r[1] for r in _RANGES], np.int8)
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:128] = [c if chr(c).isalnum() else 0 for c in range(128)]


def word_scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script of the character at each word's start."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[starts + j] for j in range(4))
    code = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)))
    return _SCRIPT[np.searchsorted(_ENDS, np.minimum(code, 0x10FFFF))]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams at every byte and behind every row: each byte with the two before it
    in its word (zeros before its start); what ends a word counts as a zero byte. Also where each row's first byte is."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    b = np.zeros(len(data) + rows, np.uint32)
    b[np.arange(len(data)) + row] = _LETTER[data]
    one = np.append(np.uint32(0), b[:-1])
    two = np.append(np.zeros(2, np.uint32), b[:-2])[: len(b)]
    two = np.where(one == 0, np.uint32(0), two)
    packed = b | one << np.uint32(8) | two << np.uint32(16)
    return (packed * np.uint32(0x9E3779B1)) >> np.uint32(16), offsets + np.arange(rows + 1)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float, block: int = BLOCK) -> np.ndarray:
    """The best labels of all chains, where a change of label costs penalty. Chains are cut in
    blocks; all blocks' transfer matrices are computed side by side, joined along each chain, and
    the labels traced back side by side again."""
    n, s = scores.shape
    length = np.diff(first)
    blocks = -(-length // block)
    head = np.append(0, np.cumsum(blocks))
    total = int(head[-1])
    if not n:
        return np.zeros(0, np.int8)
    chain = np.repeat(np.arange(len(length)), length)
    nth = np.arange(n) - first[:-1][chain]
    at = (head[:-1][chain] + nth // block) * block + nth % block
    p = np.zeros((total * block, s))
    p[at] = scores
    p = p.reshape(total, block, s)
    m = np.where(np.eye(s, dtype=bool), 0.0, -np.inf)[None].repeat(total, axis=0)
    for t in range(block):
        np.maximum(m, m.max(axis=2, keepdims=True) - penalty, out=m)
        m += p[:, t, None, :]
    order = np.argsort(-blocks, kind="stable")
    active = np.searchsorted(-blocks[order], -np.arange(blocks.max()), side="left")
    v = np.zeros((len(length), s))
    before = np.empty((total, s))  # best scores on entering each block
    for k, a in enumerate(active):
        own = order[:a]
        before[head[own] + k] = v[own]
        v[own] = (v[own][:, :, None] + m[head[own] + k]).max(axis=1)
    end, start = np.empty(total, np.int64), np.empty(total, np.int64)
    state = v.argmax(axis=1)
    for k in range(len(active) - 1, -1, -1):
        own = order[: active[k]]
        i = head[own] + k
        last = blocks[own] - 1 == k
        b = np.where(last, v[own].argmax(axis=1), state[own])
        a = (before[i] + m[i, :, b]).argmax(axis=1)
        end[i], start[i] = b, a
        state[own] = a
    best = np.full((total, s), -np.inf)
    best[np.arange(total), start] = 0.0
    top, moved = np.empty((block, total), np.int8), np.empty((block, total, s), bool)
    for t in range(block):
        top[t] = best.argmax(axis=1)
        other = best.max(axis=1, keepdims=True) - penalty
        moved[t] = best < other
        best = np.maximum(best, other) + p[:, t]
    path = np.empty((total, block), np.int8)
    state = end
    every = np.arange(total)
    for t in range(block - 1, -1, -1):
        path[:, t] = state
        state = np.where(moved[t, every, state], top[t], state)
    return path.reshape(-1)[at]


@dataclass
class LanguageModel:
    """logs: (BUCKETS, languages) log-likelihoods of trigrams, less their mean; uses: (scripts, languages)."""

    languages: list[str]
    logs: np.ndarray
    uses: np.ndarray

    def word_scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all words for each language and for unknown, and each row's first word (len rows+1)."""
        starts, ends, first = word_bounds(data, offsets)
        n = len(self.languages)
        out = np.zeros((len(starts), n + 1))
        if not len(starts):
            return out, first
        buckets, _ = trigrams(data, offsets)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        script = word_scripts(data, starts)
        for j in range(n):
            total = np.append(0.0, np.cumsum(self.logs[buckets, j], dtype=np.float64))
            out[:, j] = total[ends + row + 1] - total[starts + row]
        allowed = self.uses[script]
        out[:, :n][~allowed] = -50.0
        known = allowed.any(axis=1)
        out[known, n] = -50.0
        neutral = script == 0
        out[neutral] = 0.0
        out[neutral, n] = 1e-6  # of digits only: unknown
        return out, first

    def spans(self, data: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all spans: first word, end word (within the row) and label; and each row's first span (len rows+1)."""
        scores, first = self.word_scores(data, offsets)
        path = viterbi(scores, first, penalty)
        new = np.ones(len(path), bool)
        new[1:] = path[1:] != path[:-1]
        new[first[:-1][first[:-1] < len(path)]] = True
        at = np.flatnonzero(new)
        span = np.searchsorted(at, first)
        row = np.repeat(np.arange(len(first) - 1), np.diff(span))
        ends = np.append(at[1:], len(path))
        return at - first[row], ends - first[row], path[at], span


def fit(texts: pa.Array, languages: list[str]) -> LanguageModel:
    """A model from texts and their languages."""
    names = sorted(set(languages))
    counts = np.full((BUCKETS, len(names)), 0.1)
    uses = np.zeros((len(SCRIPTS), len(names)))
    label = np.array([names.index(x) for x in languages], np.int64)
    data, offsets = as_bytes(lower(texts))
    for a, b in chunks(offsets):
        own, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        buckets, at = trigrams(own, off)
        starts, _, first = word_bounds(own, off)
        script = word_scripts(own, starts)
        for i in range(b - a):
            counts[:, label[a + i]] += np.bincount(buckets[at[i] : at[i + 1]], minlength=BUCKETS)
            uses[:, label[a + i]] += np.bincount(script[first[i] : first[i + 1]], minlength=len(SCRIPTS))
    counts[0] = 0.1  # zero after zero: no part of a word
    logs = np.log(counts / counts.sum(axis=0)) if names else counts
    uses[0] = 0
    share = uses / np.maximum(uses.sum(axis=0), 1)
    return LanguageModel(names, (logs - logs.mean(axis=1, keepdims=True) if names else logs).astype(np.float32), share >= SCRIPT_SHARE)


def train(docs: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model fitted on at most `sample` texts of each language that docs names: those with the least
    hashes of doc_id. Null texts and languages are left out."""
    own = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.xxhash64("doc_id").alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = own.select("lang", "h").withColumn("nth", nth).where(F.col("nth") <= sample)
    keep = F.lit(False)
    for r in least.groupBy("lang").agg(F.max("h").alias("h")).orderBy("lang").collect():
        keep = keep | ((F.col("lang") == r["lang"]) & (F.col("h") <= F.lit(r["h"]).cast("long")))
    ties = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    got = own.where(keep).withColumn("nth", ties).where(F.col("nth") <= sample).orderBy("lang", "h", "text").toArrow()
    return fit(got["text"].combine_chunks(), got["lang"].to_pylist())


_OUT_SQL = "language string, words long, spans array<struct<first: long, end: long, language: string>>"
_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("language", pa.string())])


def identify(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, language, words, spans) for every row of docs. spans: word ranges [first, end) with their
    language, in order, covering all words; language: the one with most words, of equals the first by name.

    A text without words (null, empty, signs only) has no spans, and language "und"; so has one of
    digits only. Rows are
    labelled one by one, so repeated rows repeat their result. A model without languages labels all
    "und". doc_id may be of any type; other columns, a language column too, are ignored. An empty table gives an empty result.
    """
    names = [*model.languages, UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(lower(batch["text"]))
            for a, b in chunks(offsets):
                begin, end, label, first = model.spans(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], penalty)
                n = b - a
                row = np.repeat(np.arange(n), np.diff(first))
                words = np.bincount(row * len(names) + label, end - begin, minlength=n * len(names)).reshape(n, len(names)).astype(np.int64)
                most = words.argmax(axis=1)
                most[words.sum(axis=1) == 0] = len(names) - 1
                spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(end), pa.array(names).take(pa.array(label.astype(np.int64)))], fields=list(_SPAN))
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(a, n), pa.array(names).take(pa.array(most)), pa.array(words.sum(axis=1)),
                    pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), spans),
                ], names=["doc_id", "language", "words", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_OUT_SQL}")
