"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is labelled good or bad; a line's features are its own (shares of character
classes, lengths, repetition) and those of the lines before and after it. Forward-backward gives each
line's probability of being good; a document's quality is their mean, weighted by the lines' lengths.

Labels exist for documents only. Training starts with each line carrying its document's label, then
relabels the lines of bad documents by the model's own marginals (the worst line of each stays bad)
and fits again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .place import free as _free
from .text import as_bytes, chunks, range_hash, trimmed, word_hashes

#: Labelled documents of each class that the model is fitted on, at most: those with the least hash of doc_id.
SAMPLE = 2000
#: Bytes of a text up to which its document may be in that sample.
SAMPLE_BYTES = 1 << 16
#: Weight of losing good documents against keeping bad ones, in the choice of the threshold.
KEEP = 3.0
_CLASSES = 10
_LUT = np.full(256, 5, np.int64)  # other symbols
for _i in range(256):
    _c = chr(_i)
    if _i >= 0xC0:
        _LUT[_i] = 6  # first byte of a non-ASCII character
    elif _i >= 0x80:
        _LUT[_i] = 7
    elif _c.islower():
        _LUT[_i] = 0
    elif _c.isupper():
        _LUT[_i] = 1
    elif _c.isdigit():
        _LUT[_i] = 2
    elif _c.isspace():
        _LUT[_i] = 3
    elif _c in ".,;:'\"?-()":
        _LUT[_i] = 4
    elif _c == "!":
        _LUT[_i] = 8
    elif _c in "<>{}[]|\\/=_":
        _LUT[_i] = 9
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
OWN = 15
FEATURES = 3 * OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all non-blank lines, their lengths in bytes and each row's first line (len rows+1)."""
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        return np.zeros((0, FEATURES)), np.zeros(0), np.zeros(rows + 1, np.int64)
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins[1:][data == 10] = True
    begins[n] = False
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    line_of = np.repeat(np.arange(len(starts)), ends - starts)
    c = np.bincount(line_of * _CLASSES + _LUT[data], minlength=len(starts) * _CLASSES).reshape(-1, _CLASSES).astype(float)
    size = (ends - starts).astype(float)
    real = size > c[:, 3]
    starts, ends, c, size = starts[real], ends[real], c[real], size[real]
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros((0, FEATURES)), np.zeros(0), first
    doc = np.repeat(np.arange(rows), np.diff(first))
    trimmed = ends - (data[ends - 1] == 10)
    digest = range_hash(data.astype(np.uint64) + np.uint64(1), starts, trimmed, 0x9E3779B97F4A7C15)
    _, inverse, times = np.unique(digest ^ (doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
    words, begin = word_hashes(_LOWER[data], np.append(starts, n))
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    again[begin[:-1][begin[:-1] < len(words)]] = False
    repeats = np.append(0, np.cumsum(again))
    repeats = (repeats[begin[1:]] - repeats[begin[:-1]]) / np.maximum(np.diff(begin), 1)
    chars = size - c[:, 3] - c[:, 7]
    tokens = c[:, 3] + 1 - (data[ends - 1] == 10)
    last = data[np.maximum(trimmed - 1, starts)]
    letters = c[:, 0] + c[:, 1] + c[:, 6] + 1e-9
    own = np.stack([
        c[:, 1] / letters, c[:, 2] / chars, c[:, 4] / tokens, c[:, 5] / tokens, c[:, 6] / chars, c[:, 8] / tokens, c[:, 9] / tokens,
        np.log1p(size) / 5, np.log1p(tokens) / 4, np.minimum(chars / tokens, 30) / 10, np.isin(last, (46, 33, 63, 34, 39, 41)).astype(float),
        (times[inverse] > 1).astype(float), (tokens < 3).astype(float), repeats, np.minimum((c[:, 5] + c[:, 8] + c[:, 9]) / chars, 1),
    ], axis=1)
    return with_neighbours(own, doc), size, first


def with_neighbours(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Lines' own features, those of the lines before and after, and one."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.concatenate([own, before, after, np.ones((len(own), 1))], axis=1)


def _order(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains by falling length, and how many of them are longer than 0, 1, 2, ... lines."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    return order, np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")


def marginals(unary: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = False, weight: np.ndarray | None = None):
    """Forward-backward for all chains at once. unary (lines, 2) and trans (2, 2) are log scores.
    Gives each line's probability of label 1; with pairs also the expected transitions and the sum of
    the chains' log partition functions, both times the lines' weights if there are any (equal within a chain)."""
    n = len(unary)
    order, active = _order(first)
    head = first[:-1][order]
    shift = unary.max(axis=1, keepdims=True)
    e, t = np.exp(unary - shift), np.exp(trans)
    alpha, scale = np.empty((n, 2)), np.ones(n)
    for k, m in enumerate(active):
        at = head[:m] + k
        a = e[at] if k == 0 else (alpha[at - 1] @ t) * e[at]
        s = a.sum(axis=1)
        scale[at] = s
        alpha[at] = a / s[:, None]
    beta = np.ones((n, 2))
    for k in range(len(active) - 1, 0, -1):
        at = head[: active[k]] + k
        beta[at - 1] = ((e[at] * beta[at]) @ t.T) / scale[at][:, None]
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    if not pairs:
        return p[:, 1]
    inner = np.ones(n, bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    i = np.flatnonzero(inner)
    joint = alpha[i - 1][:, :, None] * t[None] * (e[i] * beta[i] / scale[i][:, None])[:, None, :]
    weight = np.ones(n) if weight is None else weight
    return p[:, 1], np.tensordot(weight[i], joint, axes=1), (weight * (np.log(scale) + shift[:, 0])).sum()


@dataclass
class LineCrf:
    """weights: score of label good against bad; threshold: quality from which a document is good."""

    weights: np.ndarray
    trans: np.ndarray
    threshold: float

    def line_probabilities(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        good = x @ self.weights
        return marginals(np.stack([np.zeros(len(good)), good], axis=1), self.trans, first)

    def qualities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Quality of each row; 0 without any non-blank line."""
        x, size, first = line_features(data, offsets)
        return _weighted(self.line_probabilities(x, first), size, first)


def _weighted(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(p * size))
    weight = np.append(0, np.cumsum(size))
    return (total[first[1:]] - total[first[:-1]]) / np.maximum(weight[first[1:]] - weight[first[:-1]], 1e-9)


def likelihood(w: np.ndarray, trans: np.ndarray, x: np.ndarray, y: np.ndarray, first: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The chains' log likelihood, each times its weight, over the lines' weights in all, less l2 / 2 times the squares of w and trans; and its
    gradients by both."""
    lines = np.repeat(weight, np.diff(first))
    inner = np.ones(len(x), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i - 1], y[i]), lines[i])
    good = x @ w
    p, joint, z = marginals(np.stack([np.zeros(len(good)), good], axis=1), trans, first, pairs=True, weight=lines)
    total = lines.sum()
    value = ((lines * good * y).sum() + (seen * trans).sum() - z) / total - l2 / 2 * ((w * w).sum() + (trans * trans).sum())
    return value, x.T @ (lines * (y - p)) / total - l2 * w, (seen - joint) / total - l2 * trans


def fit_lines(x: np.ndarray, y: np.ndarray, first: np.ndarray, weight: np.ndarray, steps: int = 120, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Penalized conditional likelihood by gradient ascent with adaptive steps. weight is by chain."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        _, by_w, by_trans = likelihood(w, trans, x, y, first, weight, l2)
        g = np.append(by_w, by_trans.ravel())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[:-4], trans + move[-4:].reshape(2, 2)
    return w, trans


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, labels: np.ndarray) -> LineCrf:
    """The model from documents' features and labels (1 good). Without documents of both classes
    every document is good."""
    if len(np.unique(labels)) < 2 or not len(x):
        return LineCrf(np.append(np.zeros(x.shape[1] - 1), 20.0), np.zeros((2, 2)), 0.5)
    counts = np.bincount(labels, minlength=2)
    weight = len(labels) / (2.0 * counts[labels])
    y = np.repeat(labels, np.diff(first)).astype(np.int64)
    bad = np.repeat(labels == 0, np.diff(first))
    for last in (False, True):
        model = LineCrf(*fit_lines(x, y, first, weight), 0.5)
        p = model.line_probabilities(x, first)
        if not last:
            y = np.where(bad & (p < 0.5), 0, 1)
            has = np.flatnonzero((labels == 0) & (np.diff(first) > 0))
            worst = [first[d] + int(np.argmin(p[first[d] : first[d + 1]])) for d in has]
            y[worst] = 0
    q = _weighted(p, size, first)
    return LineCrf(model.weights, model.trans, _threshold(q, labels))


def _threshold(q: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the range of thresholds with the best accuracy, where the good documents together
    weigh KEEP times as much as the bad ones."""
    cuts = np.unique(np.concatenate([[0.0], q, [1.0]]))
    mid = (cuts[1:] + cuts[:-1]) / 2
    good, bad = np.sort(q[labels == 1]), np.sort(q[labels == 0])
    score = KEEP * (1 - np.searchsorted(good, mid) / len(good)) + np.searchsorted(bad, mid) / len(bad)
    best = mid[score >= score.max() - 1e-12]
    return float((best[0] + best[-1]) / 2)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(batch["text"])
        for a, b in chunks(offsets):
            x, size, first = line_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"].slice(a, b - a), "quality": batch["quality"].slice(a, b - a),
                "x": [x[first[i] : first[i + 1], :OWN].ravel() for i in range(b - a)], "size": [size[first[i] : first[i + 1]] for i in range(b - a)],
            }, schema=_TRAIN)


_TRAIN = pa.schema([("doc_id", pa.string()), ("quality", pa.int32()), ("x", pa.list_(pa.float64())), ("size", pa.list_(pa.float64()))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> LineCrf:
    """A model fitted on at most `sample` labelled documents of each class, none of more than sample_bytes. Null ids, texts and labels are left out;
    of documents that repeat an id the one with the fewest lines counts. Ids may be of any type."""
    known = labels.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(picked[0].unionAll(picked[1]))  # 2 * sample rows at most
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where(F.octet_length("text") <= sample_bytes).join(chosen, "doc_id")
    got = rows.mapInArrow(_collect, "doc_id string, quality int, x array<double>, size array<double>").toArrow().to_pylist()
    by_id: dict[str, dict] = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], len(r["x"]), r["x"])):
        by_id.setdefault(r["doc_id"], r)
    got = [by_id[k] for k in sorted(by_id)]
    own = np.concatenate([np.array(r["x"]) for r in got] + [np.zeros(0)]).reshape(-1, OWN)
    size = np.concatenate([np.array(r["size"]) for r in got] + [np.zeros(0)])
    lines = [len(r["size"]) for r in got]
    first = np.append(0, np.cumsum(lines)).astype(np.int64)
    x = with_neighbours(own, np.repeat(np.arange(len(got)), lines)) if len(own) else np.zeros((0, FEATURES))
    return fit(x, size, first, np.array([r["quality"] for r in got], np.int64))


def quality_udf(model: LineCrf):
    """A column function: quality of a text under the model."""

    def quality(text: pa.Array) -> pa.Array:
        data, offsets = as_bytes(text)
        parts = [model.qualities(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return F.arrow_udf(trimmed(quality), "double")


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality, good) for every row of docs.

    A null, empty or blank text has quality 0 and isn't good. Rows are scored one by one, so repeated
    rows repeat their result; other columns are ignored. With no labelled documents, or of one class
    only, all other documents are good. An empty table gives an empty result.
    """
    model = train(docs, labels, sample)
    scored = docs.select("doc_id", quality_udf(model)("text").alias("quality"))
    return scored.withColumn("good", F.col("quality") >= F.lit(model.threshold))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, that score_quality() calls good."""
    model = train(docs, labels, sample)
    q = _free(docs, "score")
    return docs.withColumn(q, quality_udf(model)("text")).where(F.col(q) >= F.lit(model.threshold)).select(docs.columns)
