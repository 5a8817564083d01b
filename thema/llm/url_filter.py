"""URL filter: gradient-boosted trees over lexical features.

Features need the URL alone: lengths, depth, digit ratios, entropies, counts of parameters and signs,
and statistics of the host's suffix (its last label) gathered from all labelled URLs. The trees are
grown on histograms under logistic loss.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import as_bytes, chunks, lower, range_hash

#: Labelled URLs of each class that the trees are grown on, at most: those with the least hash.
SAMPLE = 20_000
#: Suffixes with statistics of their own, at most.
SUFFIXES = 100_000
TREES = 60
DEPTH = 4
RATE = 0.2
BINS = 64
#: Words of blocklist categories that label a host in block_labels(), as a whole part between dots and hyphens.
BLOCK_WORDS = ("adult", "porn", "xxx", "sex", "casino", "poker", "bet", "bets", "gambling", "pills", "pharma", "viagra", "spam", "ads", "adserver", "track", "tracker", "warez", "malware", "phishing")
NAMES = [
    "length", "host length", "path length", "query length", "depth", "parameters", "host labels", "host hyphens", "digit ratio", "host digit ratio", "path digit ratio",
    "host entropy", "path entropy", "signs ratio", "longest host label", "vowel ratio of host", "secure", "fragment", "percent signs", "suffix rate", "suffix frequency",
]


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def _entropy(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits a byte of the ranges' distributions of bytes."""
    n = len(starts)
    size = ends - starts
    if not size.sum():
        return np.zeros(n)
    row = np.repeat(np.arange(n), size)
    at = np.arange(size.sum()) + np.repeat(starts - np.append(0, np.cumsum(size)[:-1]), size)
    key, counts = np.unique(row * 256 + data[at], return_counts=True)
    p = counts / size[key // 256]
    return np.bincount(key // 256, -p * np.log2(p), minlength=n)


def lexical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all URLs but the suffix's, and hashes of their suffixes."""
    n = len(offsets) - 1
    start, end = offsets[:-1], offsets[1:]
    data = np.append(data, np.zeros(1, np.uint8))

    def counted(chars: bytes):
        total = np.append(0, np.cumsum(_mask(chars)[data]))
        return lambda a, b: total[b] - total[a]

    def first(chars: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the first of chars is in each [a, b), or b."""
        at = np.append(np.flatnonzero(_mask(chars)[data]), len(data) + 1)
        return np.minimum(at[np.searchsorted(at, a)], b)

    colon = first(b":", start, end)
    has = (colon + 2 < end) & (data[np.minimum(colon + 1, len(data) - 1)] == 47) & (data[np.minimum(colon + 2, len(data) - 1)] == 47)
    host = np.where(has, colon + 3, start)
    secure = has & (colon - start == 5)
    hash_at = first(b"#", host, end)
    query = first(b"?", host, hash_at)
    path = first(b"/", host, query)
    digits, dots, hyphens, slashes = counted(b"0123456789"), counted(b"."), counted(b"-"), counted(b"/")
    equals, percent, vowels = counted(b"="), counted(b"%"), counted(b"aeiou")
    alnum = counted(b"abcdefghijklmnopqrstuvwxyz0123456789")
    size = np.maximum(end - start, 1)
    host_size, path_size = path - host, query - path
    marks = np.flatnonzero((data == 46))
    last = np.where(len(marks) > 0, np.searchsorted(marks, path) - 1, -1)
    dot = marks[np.maximum(last, 0)] if len(marks) else np.zeros(n, np.int64)
    suffix = np.where((last >= 0) & (dot >= host), dot + 1, host)
    # The longest label: gaps between the dots of a host.
    inside = marks[(np.searchsorted(host, marks, side="right") > 0)] if n and len(marks) else np.zeros(0, np.int64)
    row = np.searchsorted(host, inside, side="right") - 1
    ok = inside < path[row] if len(inside) else np.zeros(0, bool)
    inside, row = inside[ok], row[ok]
    edges_row = np.concatenate([np.arange(n), row, np.arange(n)])
    edges_at = np.concatenate([host - 1, inside, path])
    order = np.lexsort((edges_at, edges_row))
    gaps = np.diff(edges_at[order]) - 1
    same = edges_row[order][1:] == edges_row[order][:-1]
    longest = np.zeros(n)
    np.maximum.at(longest, edges_row[order][1:][same], gaps[same])
    x = np.stack([
        end - start, host_size, path_size, hash_at - query, slashes(path, query), equals(query, hash_at), dots(host, path) + 1, hyphens(host, path),
        digits(start, end) / size, digits(host, path) / np.maximum(host_size, 1), digits(path, query) / np.maximum(path_size, 1),
        _entropy(data, host, path), _entropy(data, path, query), 1 - alnum(start, end) / size, longest, vowels(host, path) / np.maximum(host_size, 1),
        secure, hash_at < end, percent(start, end),
    ], axis=1).astype(float)
    return x, range_hash(data.astype(np.uint64) + np.uint64(1), suffix, np.maximum(path, suffix), 0x9E3779B97F4A7C15)


@dataclass
class UrlModel:
    """Complete trees by level: features and thresholds of inner nodes, values of leaves; threshold on the probability."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    suffixes: dict[int, tuple[float, float]]
    unknown: tuple[float, float]

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, suffix = lexical(data, offsets)
        stats = np.array([self.suffixes.get(s, self.unknown) for s in suffix.tolist()]).reshape(-1, 2)
        return np.concatenate([x, stats], axis=1)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.features(data, offsets)
        rows = np.arange(len(x))
        total = np.full(len(x), self.base)
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))


def _suffix_stats(keys: np.ndarray, n: np.ndarray, bad: np.ndarray) -> tuple[dict[int, tuple[float, float]], tuple[float, float]]:
    """Smoothed rate of blocked URLs and log share, by suffix; from how many URLs each has, and how many blocked."""
    every = int(n.sum())
    rate = float(bad.sum() / every) if every else 0.5
    stats = {int(k): (float((b + 20 * rate) / (m + 20)), float(np.log((m + 1) / (every + 1)))) for k, b, m in zip(keys, bad, n)}
    return stats, (rate, float(-np.log(every + 1)))


def suffix_counts(suffix: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes, their numbers of URLs and of blocked ones."""
    keys, at = np.unique(suffix, return_inverse=True)
    return keys, np.bincount(at, minlength=len(keys)), np.bincount(at, y, minlength=len(keys))


def fit(urls: pa.Array, labels: np.ndarray, trees: int = TREES, rate: float = RATE, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> UrlModel:
    """Trees from URLs and their labels (1 blocked). With one class or none, that class's prior alone. counts: the suffixes' counts over
    all labelled URLs, if these are a sample."""
    data, offsets = as_bytes(lower(urls))
    x, suffix = lexical(data, offsets)
    y = np.asarray(labels, float)
    stats, unknown = _suffix_stats(*(counts if counts is not None and len(counts[0]) else suffix_counts(suffix, y)))
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = UrlModel(float(np.log(prior / (1 - prior))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), stats, unknown)
    if len(np.unique(y)) < 2:
        return UrlModel(20.0 if len(y) and y[0] else -20.0, model.feature, model.cut, model.value, stats, unknown)
    x = model.features(data, offsets)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    # A tree is chosen by the classes at equal weight.
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    total = np.full(len(y), 0.0)
    model.base = 0.0
    grown_f, grown_c, grown_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            base, count = (1 << level) - 1, 1 << level
            best = np.full(count, 1e-9)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                k = len(cuts[j]) + 1
                at = (node - base) * k + binned[:, j]
                gs = np.bincount(at, g, minlength=count * k).reshape(count, k).cumsum(axis=1)
                hs = np.bincount(at, h, minlength=count * k).reshape(count, k).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                top = gain.argmax(axis=1)
                for m in np.flatnonzero(gain[np.arange(count), top] > best):
                    best[m] = gain[m, top[m]]
                    f[base + m], c[base + m] = j, cuts[j][top[m]]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > c[node])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + 1)
        total += v[leaf]
        grown_f.append(f)
        grown_c.append(c)
        grown_v.append(v)
    model.feature, model.cut, model.value = np.array(grown_f), np.array(grown_c), np.array(grown_v)
    return model


def block_labels(url: Column, words: tuple[str, ...] = BLOCK_WORDS) -> Column:
    """1 if a part of the URL's host between dots and hyphens is one of words, else 0; null for null."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1)
    return F.arrays_overlap(F.split(host, r"[.:-]"), F.array(*[F.lit(w) for w in words])).cast("int")


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = as_bytes(lower(batch["url"]))
        label = batch["label"].to_numpy()
        for a, b in chunks(offsets):
            _, suffix = lexical(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            keys, n, bad = suffix_counts(suffix, label[a:b].astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(bad.astype(np.int64))], names=["suffix", "n", "bad"])


def train(labelled: DataFrame, sample: int = SAMPLE, suffixes: int = SUFFIXES) -> UrlModel:
    """A model with trees grown on labelled(url, label), at most `sample` different URLs of each class, and statistics of the suffixes of all of
    them, the `suffixes` most frequent by name (top-level domains are some 1,500; others count as unknown). Null URLs and labels are left out."""
    own = labelled.where("url IS NOT NULL AND label IN (0, 1)").groupBy("url").agg(F.max("label").alias("label"))
    least = [own.where(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(sample) for k in (0, 1)]
    got = least[0].unionAll(least[1]).orderBy("label", F.xxhash64("url"), "url").toArrow()
    counted = own.mapInArrow(_suffixes, "suffix long, n long, bad long").groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    counted = counted.orderBy(F.col("n").desc(), "suffix").limit(suffixes).toArrow()
    counts = tuple(counted[c].to_numpy() for c in ("suffix", "n", "bad"))
    return fit(got["url"].combine_chunks().cast(pa.string()), got["label"].to_numpy(), counts=(counts[0].view(np.uint64), *counts[1:]))


def score_urls(pages: DataFrame, model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """(page_id, url, score, blocked) for every row of pages: score is the probability of a blocked URL.

    A null or empty URL has a null score and isn't blocked. Rows are scored one by one, so repeated rows
    repeat their result; other columns are ignored. A model without URLs of both classes gives all the
    class it has, or blocks none. An empty table gives an empty result.
    """

    def score(url: pa.Array) -> pa.Array:
        data, offsets = as_bytes(lower(url))
        parts = [model.probabilities(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
        return pa.array(np.concatenate([np.zeros(0), *parts]), mask=np.diff(offsets) == 0)

    out = pages.select("page_id", "url", F.arrow_udf(score, "double")("url").alias("score"))
    return out.withColumn("blocked", F.coalesce(F.col("score") >= threshold, F.lit(False)))
