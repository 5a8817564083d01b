"""Benchmark decontamination by winnowing.

Texts are lower-cased word sequences; of scripts without blanks each character is a word. Of every WINDOW consecutive K-grams (K words each) the one with
the least hash is a fingerprint, so two texts that share K + WINDOW - 1 words in a row share a
fingerprint. Where a document's fingerprint is one of a benchmark item, the hit is extended word by
word both ways to the whole shared span. Spans of at least K + WINDOW - 1 words are reported, all of
them and nothing shorter, but for items of fewer words (K at least): those are reported where a document holds them whole.

The benchmark's fingerprints go to the tasks in slices of bounded size; a larger benchmark takes more
passes over the documents, which are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .place import free as _free
from .text import HashTable, as_bytes, chunks, kgrams, lower, trimmed, word_hashes

K = 8
WINDOW = 6
#: Bytes of benchmark text in a slice, about.
SLICE_BYTES = 16 << 20


def winnow(grams: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Positions in grams of the fingerprints of all rows: in every window the last of the least hashes.
    A row with fewer grams than a window is one window."""
    count = np.diff(first)
    full = np.maximum(count - window + 1, 0)
    n = len(grams) - window + 1
    picked = [np.zeros(0, np.int64)]
    if n > 0 and full.any():
        best, at = grams[:n].copy(), np.zeros(n, np.int8)
        for j in range(1, window):
            other = grams[j : n + j]
            less = other <= best
            np.copyto(best, other, where=less)
            at[less] = j
        starts = np.arange(full.sum()) + np.repeat(first[:-1] - np.append(0, np.cumsum(full)[:-1]), full)
        picked.append(starts + at[starts])
    for row in np.flatnonzero((count > 0) & (count < window)):
        own = grams[first[row] : first[row + 1]]
        picked.append(np.array([first[row] + len(own) - 1 - int(np.argmin(own[::-1]))]))
    return np.unique(np.concatenate(picked)) if len(picked) > 1 else picked[0]


class Benchmark:
    """Items' words and fingerprints."""

    def __init__(self, texts: pa.Array, k: int = K, window: int = WINDOW):
        self.k, self.window = k, window
        data, offsets = as_bytes(lower(texts))
        self.words, self.rows = word_hashes(data, offsets)
        grams, first = kgrams(self.words, self.rows, k)
        at = winnow(grams, first, window)
        item = np.searchsorted(first, at, side="right") - 1
        order = np.argsort(grams[at], kind="stable")
        fp, self.lo = np.unique(grams[at][order], return_index=True)
        self.hi = np.append(self.lo[1:], len(at))
        self.item, self.word = item[order], (at - first[item] + self.rows[item])[order]
        self.table = HashTable(fp)
        # Items too short for a window: a document's fingerprints needn't hold theirs, so all its K-grams are looked up.
        self.short = np.zeros(len(fp), bool)
        own = np.diff(first)[item] < window
        self.short[np.searchsorted(fp, grams[at][own])] = True
        self.any_short = HashTable(fp[self.short])
        self.of_short = np.flatnonzero(self.short)
        self.least = np.minimum(k + window - 1, np.diff(self.rows))

    def spans(self, words: np.ndarray, rows: np.ndarray, one: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word in the row, first word in the item, number of words) of all shared
        spans; with one, of one span of each row that has any."""
        grams, first = kgrams(words, rows, self.k)
        at = winnow(grams, first, self.window)
        found = self.table.find(grams[at])
        at, found = at[found >= 0], found[found >= 0]
        if len(self.of_short):
            every = self.any_short.find(grams)
            more = np.flatnonzero(every >= 0)
            at, i = np.unique(np.concatenate([at, more]), return_index=True)
            found = np.concatenate([found, self.of_short[every[more]]])[i]
        row = np.searchsorted(first, at, side="right") - 1
        out: list[tuple[int, int, int, int, int]] = []
        done: dict[tuple[int, int, int], int] = {}  # by row, item and diagonal: the end of the last span
        for r, p, f in zip(row.tolist(), (at - first[row] + rows[row]).tolist(), found.tolist()):
            for j in range(self.lo[f], self.hi[f]):
                i, q = int(self.item[j]), int(self.word[j])
                if done.get((r, i, p - q), -1) >= p + self.k or one and out and out[-1][0] == r:
                    continue
                ahead = min(int(rows[r + 1]) - p, int(self.rows[i + 1]) - q)
                behind = min(p - int(rows[r]), q - int(self.rows[i]))
                differ = np.flatnonzero(words[p : p + ahead] != self.words[q : q + ahead])
                right = int(differ[0]) if len(differ) else ahead
                if right < self.k:
                    continue  # equal hashes of different K-grams
                differ = np.flatnonzero((words[p - behind : p] != self.words[q - behind : q])[::-1])
                left = int(differ[0]) if len(differ) else behind
                done[r, i, p - q] = p + right
                if left + right >= self.least[i]:
                    out.append((r, i, p - left - int(rows[r]), q - left - int(self.rows[i]), left + right))
        return out


def _slices(benchmark: DataFrame, k: int, window: int, limit: int) -> Iterator[tuple[Benchmark, pa.Array]]:
    items = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    for i in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        got = own.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        if len(got):
            yield Benchmark(got["text"].combine_chunks(), k, window), got["item_id"].combine_chunks()


def shared_spans(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, words): every longest span of at least k + window - 1
    words (of a shorter item's words, k at least) that a document and a benchmark item share, by its first words' positions and its length.

    Null and empty texts share nothing. Rows that repeat, of either table, repeat their spans. A null
    doc_id or item_id is carried along. Empty tables give an empty result; other columns are ignored.
    """
    own = docs.select("doc_id", "text").where("text IS NOT NULL")
    schema = StructType([docs.schema["doc_id"], benchmark.schema["item_id"], *[StructField(c, LongType()) for c in ("doc_word", "item_word", "words")]])
    out = docs.sparkSession.createDataFrame([], schema)
    for items, ids in _slices(benchmark, k, window, slice_bytes):

        def spans(batches: Iterator[pa.RecordBatch], items: Benchmark = items, ids: pa.Array = ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = as_bytes(lower(batch["text"]))
                for a, b in chunks(offsets):
                    got = items.spans(*word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                    if got:
                        r, i, p, q, n = (np.array(x, np.int64) for x in zip(*got))
                        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(a + r)), ids.take(pa.array(i)), pa.array(p), pa.array(q), pa.array(n)], names=schema.names)

        out = out.unionAll(own.mapInArrow(spans, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs, all columns, that share no span with any benchmark item (see shared_spans)."""
    flag = _free(docs, "leak")
    out = docs
    for items, _ in _slices(benchmark, k, window, slice_bytes):
        out = out.withColumn(flag, _leaks(items)("text")).where(~F.col(flag)).select(docs.columns)
    return out


def _leaks(items: Benchmark):
    """A column function: whether a text shares a span with any of the items."""

    def leaks(text: pa.Array) -> pa.Array:
        data, offsets = as_bytes(lower(text))
        hit = np.zeros(len(text), bool)
        for a, b in chunks(offsets):
            got = items.spans(*word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), one=True)
            hit[[a + x[0] for x in got]] = True
        return pa.array(hit)

    return F.arrow_udf(trimmed(leaks), "boolean")
