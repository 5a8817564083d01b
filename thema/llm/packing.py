"""Best-fit packing of documents into training sequences, with large-item matching.

Lengths are whole numbers up to the capacity, so the packing of a corpus of any size follows from
its histogram of lengths: at most `capacity` counts, gathered on the driver. Lengths above a third of
the capacity are matched greedily, the longest with the longest that still fits, two to a bin at
most; shorter ones then go, longest first, where the least room remains. All documents of one length
are placed together, as runs of (ranks -> bins); a document finds its bin from its length and its
rank among the documents of that length. The result is exactly that of packing the whole corpus one
document after the other, and doesn't depend on the partitioning.

A document longer than the capacity is cut in parts: full ones, each a bin of its own, and a rest
that is packed like a document. No text is cut off.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .place import repeated
from .sharding import BUCKETS, bucket_of
from .text import CHUNK, as_bytes, trimmed

#: Words in a bin.
CAPACITY = 2048
#: Items of a length that are sorted in one task, about.
RANKED = 100_000


@dataclass
class Runs:
    """Placements: count items of a size, from a rank on, `each` to a bin from bin `to` on, the first at `offset`."""

    size: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    to: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bins: int = 0

    def add(self, size: int, rank: int, count: int, to: int, each: int, offset: int) -> None:
        for column, value in zip((self.size, self.rank, self.count, self.to, self.each, self.offset), (size, rank, count, to, each, offset)):
            column.append(value)

    def places(self, histogram: dict[int, int]) -> Places:
        """The bins of all items of a packed histogram."""
        return Places(self, histogram)


class Places:
    """Runs in the order of (size, rank), found by an item's number in that order."""

    def __init__(self, runs: Runs, histogram: dict[int, int]):
        sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), np.int64)
        self.before = np.zeros(int(sizes[-1]) + 1 if len(sizes) else 1, np.int64)
        self.before[sizes] = np.append(0, np.cumsum([histogram[s] for s in sizes.tolist()]))[:-1]
        size, rank = np.array(runs.size, np.int64), np.array(runs.rank, np.int64)
        start = self.before[size] + rank
        order = np.argsort(start)
        self.start, self.rank = start[order], rank[order]
        self.to, self.each, self.offset = (np.array(x, np.int64)[order] for x in (runs.to, runs.each, runs.offset))

    def find(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of items given by size and rank."""
        i = np.searchsorted(self.start, self.before[size] + rank, side="right") - 1
        nth = rank - self.rank[i]
        return self.to[i] + nth // self.each[i], self.offset[i] + nth % self.each[i] * size


def pack(histogram: dict[int, int], capacity: int = CAPACITY) -> Runs:
    """Packs histogram[size] items of each size in 1 .. capacity."""
    runs = Runs()
    left = {s: n for s, n in histogram.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    gaps: list[int] = []  # gaps that some open bins have, ascending
    open_bins: dict[int, list[tuple[int, int]]] = {}  # by gap: (first bin, how many)

    def opened(to: int, count: int, gap: int) -> None:
        if gap > 0 and count:
            if gap not in open_bins:
                insort(gaps, gap)
                open_bins[gap] = []
            open_bins[gap].append((to, count))

    def take(size: int, count: int, to: int, each: int, offset: int) -> None:
        runs.add(size, rank[size], count, to, each, offset)
        rank[size] += count
        left[size] -= count

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        i = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside a
        if i >= 0 and large[i] == a and left[a] < 2:
            i -= 1
        if i < 0:
            take(a, n := left[a], runs.bins, 1, 0)
            opened(runs.bins, n, capacity - a)
        elif (b := large[i]) == a:
            n = left[a] // 2
            take(a, 2 * n, runs.bins, 2, 0)
            opened(runs.bins, n, capacity - 2 * a)
        else:
            n = min(left[a], left[b])
            take(a, n, runs.bins, 1, 0)
            take(b, n, runs.bins, 1, a)
            opened(runs.bins, n, capacity - a - b)
        runs.bins += n
        for x in {a, b} if i >= 0 else {a}:
            if not left[x]:
                del large[bisect_left(large, x)]

    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while m := left[s]:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                gap, to, have = capacity, runs.bins, -(-m // (capacity // s))
                runs.bins += have
            else:
                gap = gaps[at]
                to, have = open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap], gaps[at]
            each = gap // s  # a bin that was just used has the least gap while another item fits
            full = min(have, m // each)
            rest = m - full * each if full < have else 0
            rest = min(rest, each - 1)
            if full:
                take(s, full * each, to, each, capacity - gap)
                opened(to, full, gap - each * s)
            if rest:
                take(s, rest, to + full, rest, capacity - gap)
                opened(to + full, 1, gap - rest * s)
            used = full + (rest > 0)
            opened(to + used, have - used, gap)
    return runs


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _words(text: pa.Array) -> pa.Array:
    return pa.array(np.diff(_words_before(*as_bytes(text))))


def _words_before(data: np.ndarray, offsets: np.ndarray, piece: int = CHUNK) -> np.ndarray:
    """The number of words that begin before each offset. Counted in pieces of so many bytes, whatever the rows' lengths: what it takes
    beside the texts doesn't grow with them."""
    out = np.zeros(len(offsets), np.int64)
    heads = offsets[:-1][np.diff(offsets) > 0]
    total = 0
    for at in range(0, len(data), piece):
        space = _SPACE[data[at : at + piece]]
        end = at + len(space)
        begins = ~space
        begins[1:] &= space[:-1]
        if at:
            begins[0] &= _SPACE[data[at - 1]]
        own = heads[slice(*np.searchsorted(heads, [at, end]))] - at
        begins[own] = ~space[own]
        sums = total + np.cumsum(begins)
        ends = slice(*np.searchsorted(offsets, [at, end], side="right"))
        out[ends] = sums[offsets[ends] - at - 1]
        total = int(sums[-1])
    return out


def words(text: str = "text") -> Column:
    """The number of words: runs of anything but white space (blanks, tabs, line ends); 0 for null."""
    return F.arrow_udf(trimmed(_words), "long")(text)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, ranked: int = RANKED) -> DataFrame:
    """(doc_id, part, length, bin_id, offset) for every part of every row of docs.

    length: a column of lengths, the number of words by default. A text without any (null, empty,
    blank) takes no place: one row of length 0 with a null bin_id and offset. Of equal lengths,
    rows go in the order of a hash of doc_id, then doc_id, null last; rows that repeat a doc_id are
    packed each. doc_id may be of any type. Other columns are ignored. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.coalesce((words() if length is None else length).cast("long"), F.lit(0)).alias("n")
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("long"))
    items = written(
        docs.select("doc_id", n)
        .select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
        .select("doc_id", "part", F.least(F.lit(capacity), F.col("n") - F.col("part") * capacity).cast("long").alias("length"))
    )
    histogram = {r["length"]: r["n"] for r in items.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = pack(histogram, capacity).places(histogram)
    # A length's items are sorted in buckets of about `ranked`; merging neighbouring buckets doesn't change the order.
    shift = np.zeros(len(places.before), np.int64)
    for s, count in histogram.items():
        shift[s] = max(0, (BUCKETS * ranked // count).bit_length() - 1) if count < BUCKETS * ranked else 0
    shift = np.minimum(shift, BUCKETS.bit_length() - 1)

    @F.pandas_udf("int")
    def merged(length: pd.Series, bucket: pd.Series) -> pd.Series:
        return pd.Series(bucket.to_numpy().astype(np.int32) >> shift[length.to_numpy()].astype(np.int32))

    @F.pandas_udf("bin_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        to, offset = places.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"bin_id": to, "offset": offset})

    # Rows that repeat a doc_id (or its absence) are one row with a count until they have their ranks.
    same = items.where("length > 0").groupBy("length", "doc_id", "part").agg(F.count(F.lit(1)).alias("m")).withColumn("bucket", merged("length", bucket_of(_number(items))))
    counts = same.groupBy("length", "bucket").agg(F.sum("m").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "part")
    first = F.coalesce(F.sum("m").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = same.withColumn("first", first).join(offsets, ["length", "bucket"]).withColumn("first", F.col("first") + F.col("before"))
    ranks = runs.where("m = 1").select("doc_id", "part", "length", F.col("first").alias("rank"))
    many = repeated(runs.where("m > 1"), "m", ["length", "doc_id", "part"], ranked)
    ranks = ranks.unionAll(many.select("doc_id", "part", "length", F.col("first") + F.col("copy")))
    packed = ranks.withColumn("at", place("length", "rank")).select("doc_id", "part", "length", "at.bin_id", "at.offset")
    nothing = items.where("length = 0").select("doc_id", "part", "length", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("long").alias("offset"))
    return packed.unionAll(nothing)


def _number(items: DataFrame) -> Column:
    """doc_id as a whole number: itself, or a hash of another type."""
    return F.col("doc_id").cast("long") if items.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long") else F.xxhash64("doc_id")
