"""Windows over the words of whole items: dictionaries, co-occurrence and its sums, with what an item holds counted in its own row.

Words become numbers by falling document frequency, from a written table that tasks read from the shared folder. Pairs of a piece of the corpus meet
as sorted 64-bit numbers (the rarer word first), and travel as compressed differences to the task of their range of words. Both directions of
a pair are one entry up to the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_CLASS
from ..storage import filesystem, path_of, written
from .dictionary import with_share
from .rank import numbered

#: Words of a piece that is counted at once, about.
PIECE = 1 << 19
#: Pairs, with repetitions, that one task puts together, about.
RANGE_PAIRS = 1 << 22
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 1 << 16


def items(docs: DataFrame) -> DataFrame:
    """(lists): the lists of words of an item, a row for each item, from (item_id, tokens). Rows of one id meet in one row, others stay where they are."""
    again = docs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("item_id").alias("again"))
    once = docs.select(F.array("tokens").alias("lists"))
    if again.isEmpty():
        return once
    same = docs["item_id"].eqNullSafe(again["again"])
    more = docs.join(again, same, "left_semi").groupBy("item_id").agg(F.collect_list("tokens").alias("lists"))
    return docs.join(again, same, "left_anti").select(F.array("tokens").alias("lists")).unionAll(more.select("lists"))


def _pieces(batches: Iterator[pa.RecordBatch]):
    """(words, list of each, item of each list) of pieces of about PIECE words; an item is in one piece."""
    for b in batches:
        lists = b["lists"]
        ends = np.asarray(lists.offsets)  # of items, in lists
        inner = lists.values
        at = np.asarray(inner.offsets).astype(np.int64)  # of lists, in words
        upto, a = at[ends], 0
        while a < b.num_rows:
            z = min(b.num_rows, max(a + 1, int(np.searchsorted(upto, upto[a] + PIECE, side="right")) - 1))
            own = at[ends[a] : ends[z] + 1]
            yield inner.values.slice(own[0], own[-1] - own[0]), np.repeat(np.arange(len(own) - 1), np.diff(own)), np.repeat(np.arange(z - a), np.diff(ends[a : z + 1]))
            a = z


def _coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    own = words.dictionary_encode()
    return np.asarray(own.indices.fill_null(-1)), own.dictionary


def _ends(list_of: np.ndarray, window: int) -> np.ndarray:
    """How many neighbours each word has within its list."""
    n = np.zeros(len(list_of), np.int64)
    for k in range(1, window + 1):
        same = list_of[k:] == list_of[:-k]
        n[k:] += same
        n[:-k] += same
    return n


def token_sums(own: DataFrame, window: int = 0) -> DataFrame:
    """(token, tf, df, ends) of items(): occurrences, items, and neighbours within the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, list_of, item_of in _pieces(batches):
            code, names = _coded(words)
            n, known = len(names), code >= 0
            ends = np.bincount(code[known], _ends(list_of, window)[known], n) if window else np.zeros(n)
            code, items_ = code[known].astype(np.int64), item_of[list_of[known]]
            pairs = np.sort(code * (int(items_.max()) + 1 if len(items_) else 1) + items_)
            new = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
            df = np.bincount(new // (int(items_.max()) + 1 if len(items_) else 1), minlength=n)
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(np.bincount(code, minlength=n)), pa.array(df), pa.array(ends.astype(np.int64))], names=["token", "tf", "df", "ends"])

    sums = own.mapInArrow(run, "token string, tf long, df long, ends long")
    return sums.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("tf", "df", "ends")])


def by_frequency(tokens: DataFrame) -> DataFrame:
    """tokens (token, df, ...) with num, numbers from 0 by falling df as powers of two; written."""
    bucket = F.struct((-F.floor(F.log2("df"))).alias("p"), F.pmod(F.xxhash64("token"), F.lit(64)).alias("h"))
    return written(numbered(tokens, "num", bucket, [F.col("token")]))


@lru_cache(maxsize=1)
def _table(uri: str, columns: tuple[str, ...]) -> dict[str, pa.Array]:
    """A table's columns in order of num; a worker keeps the last one."""
    import pyarrow.dataset as ds

    fs, path = filesystem(uri)
    got = ds.dataset(path, format="parquet", filesystem=fs).to_table(columns=["num", *columns], use_threads=False)
    order = np.empty(got.num_rows, np.int64)
    order[got["num"].to_numpy()] = np.arange(got.num_rows)
    return {c: got[c].combine_chunks().take(pa.array(order)) for c in columns}


def _numbers(words: pa.Array, uri: str, columns: tuple[str, ...]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The number of each word, -1 for those that the table lacks."""
    import pyarrow.compute as pc

    table = _table(uri, columns)
    code, names = _coded(words)
    at = pc.index_in(table["token"], value_set=names)  # few names, many words of the table
    found = np.flatnonzero(np.asarray(at.is_valid()))
    num = np.full(len(names) + 1, -1, np.int64)
    num[np.asarray(at.drop_null())] = found
    return num[code], table


def _pack(key: np.ndarray, tf: np.ndarray, df: np.ndarray) -> bytes:
    """Sorted keys and their counts by planes of bytes, compressed."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(key), -1).T).tobytes() for x in (np.diff(key, prepend=np.uint64(0)), tf.astype(np.uint32), df.astype(np.uint32))]
    return len(key).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(b"".join(planes), asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 16 * n, asbytes=True), np.uint8)
    key = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    tf, df = (np.ascontiguousarray(raw[a * n : (a + 4) * n].reshape(4, n).T).view(np.uint32).ravel() for a in (8, 12))
    return key, tf, df


def _ranges(tokens: DataFrame, count: int, window: int) -> np.ndarray:
    """Where ranges of numbers begin so that each has about as many pairs whose rarer word is in it: from sums over bins that are narrow for frequent
    words."""
    bins = tokens.groupBy(F.floor(64 * F.log2(F.col("num") + 1)).alias("bin")).agg(F.min("num").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf")).orderBy("first").collect()
    first, n, tf = (np.array([r[c] for r in bins], float) for c in ("first", "n", "tf"))
    if not len(first):
        return np.zeros(1, np.int64)
    pairs = np.cumsum(tf * np.cumsum(tf) / tf.sum()) * 2 * window
    parts = max(1, int(-(-pairs[-1] // RANGE_PAIRS)))
    cuts = np.interp(np.arange(1, parts) * pairs[-1] / parts, np.append(0, pairs), np.append(first, first[-1] + n[-1]))
    return np.unique(np.append(0, cuts.astype(np.int64)))


def window_cooccurrence(own: DataFrame, tokens: DataFrame, window: int, count: int, emit: Callable, schema: str, columns: tuple[str, ...] = ("token",)) -> DataFrame:
    """What emit(u, v, tf, df, table) yields for all pairs of tokens (by_frequency) within the window, in batches of (u, v) with u >= v as numbers; tf counts
    each pair of places once, df items. table has the named columns of tokens by number. count: the number of tokens."""
    uri, begins = path_of(tokens), _ranges(tokens, count, window)
    bits = max(1, int(count).bit_length())
    most = 1 << min(30, 63 - 2 * bits)  # items of a piece, for which bits are left
    if most < 2:
        raise ValueError(f"{count} tokens are too many")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, list_of, item_of in _pieces(batches):
            num, _ = _numbers(words, uri, columns)
            item = item_of[list_of]
            for a in range(0, int(item[-1]) + 1 if len(item) else 0, most):
                lo, hi = np.searchsorted(item, (a, a + most))
                x, where, who = num[lo:hi], list_of[lo:hi], (item[lo:hi] - a).astype(np.uint64)
                keys = []
                for k in range(1, window + 1):
                    ok = np.flatnonzero((where[k:] == where[:-k]) & (x[k:] >= 0) & (x[:-k] >= 0))
                    u, v = x[ok], x[ok + k]
                    keys.append((((np.maximum(u, v) << bits | np.minimum(u, v)).astype(np.uint64)) << np.uint64(63 - 2 * bits)) | who[ok])
                keys = np.concatenate(keys)
                if not len(keys):
                    continue
                keys.sort()
                pair = keys >> np.uint64(63 - 2 * bits)
                new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                fresh = np.append(True, keys[1:] != keys[:-1])
                tf, df, pair = np.diff(np.append(new, len(keys))), np.add.reduceat(fresh, new, dtype=np.int64), pair[new]
                cut = np.searchsorted(pair, (begins << bits).astype(np.uint64))
                cut = np.append(cut, len(pair))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([_pack(pair[cut[i] : cut[i + 1]], tf[cut[i] : cut[i + 1]], df[cut[i] : cut[i + 1]]) for i in some], pa.binary())], names=["part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            key, tf, df = (np.concatenate(x) for x in zip(*map(_unpack, held)))
            held.clear()
            order = np.argsort(key)
            key = key[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            tf, df, key = np.add.reduceat(tf[order], new, dtype=np.int64), np.add.reduceat(df[order], new, dtype=np.int64), key[new].astype(np.int64)
            for i in range(0, len(key), OUT_ROWS):
                k = key[i : i + OUT_ROWS]
                yield from emit(k >> bits, k & ((1 << bits) - 1), tf[i : i + OUT_ROWS], df[i : i + OUT_ROWS], _table(uri, columns))

        for b in batches:
            for part, data in zip(b["part"].to_pylist(), b["data"].to_pylist()):
                if part != at and held:
                    yield from out()
                at = part
                held.append(data)
        if held:
            yield from out()

    packed = own.mapInArrow(run, "part int, data binary")
    return packed.repartition(len(begins), "part").sortWithinPartitions("part").mapInArrow(add, schema)


def both_ways(u: np.ndarray, v: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs in both directions; a pair of equal tokens stands once."""
    other = u != v
    return np.append(u, v[other]), np.append(v, u[other]), *(np.append(c, c[other]) for c in counts)


def token_dictionary(docs: DataFrame, class_id: str = DEFAULT_CLASS) -> DataFrame:
    """dictionary.gather() of one class from (item_id, tokens), whose rows may repeat an id: sums of pieces alone are shuffled."""
    d = token_sums(items(docs)).select(F.lit(class_id).alias("class_id"), "token", F.col("tf").cast("double").alias("tf"), F.col("df").cast("double").alias("df"))
    return with_share(d).select("class_id", "token", "value", "tf", "df")


def _numbered(docs: DataFrame, window: int, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    own = items(docs)
    sums = token_sums(own, window)
    tokens = by_frequency(sums if names is None else sums.join(F.broadcast(names), "token", "left_semi"))
    return own, tokens, tokens.count()


def cooccurrence(docs: DataFrame, window: int, symmetric: bool = False, different: bool = False, min_tf: int = 0, min_df: int = 0, names: DataFrame | None = None) -> DataFrame:
    """cooc.cooccurrence() of the windows of (item_id, tokens): (u, v, tf, df); different: without pairs of equal tokens; names(token): of these tokens
    alone, where others keep their places."""
    own, tokens, count = _numbered(docs, window, names)

    def emit(u, v, tf, df, table):
        tf = np.where(u == v, 2 * tf, tf)
        keep = (tf >= min_tf) & (df >= min_df) & ((u != v) | (not different))
        u, v, tf, df = u[keep], v[keep], tf[keep], df[keep]
        if not symmetric:
            u, v, tf, df = both_ways(u, v, tf, df)
        yield pa.RecordBatch.from_arrays([table["token"].take(pa.array(u)), table["token"].take(pa.array(v)), pa.array(tf), pa.array(df)], names=["u", "v", "tf", "df"])

    out = window_cooccurrence(own, tokens, window, count, emit, "u string, v string, tf long, df long")
    return out if not symmetric else out.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "tf", "df")


def ppmi(docs: DataFrame, window: int, measure: str) -> DataFrame:
    """cooc.ppmi() of the windows of (item_id, tokens), of pairs of different tokens. measure: tf, under the number of all pairs, or df, under that of rows."""
    own, tokens, count = _numbered(docs, window)
    column = {"tf": "ends", "df": "df"}[measure]
    n = float(tokens.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0] if measure == "tf" else docs.count())

    def emit(u, v, tf, df, table):
        keep = u != v
        u, v, c = both_ways(u[keep], v[keep], (tf if measure == "tf" else df)[keep])
        size = np.asarray(table[column]).astype(float)
        ratio = (n / size[u]) / (size[v] / c)
        keep = ratio > 1
        yield pa.RecordBatch.from_arrays([table["token"].take(pa.array(u[keep])), table["token"].take(pa.array(v[keep])), pa.array(ratio[keep])], names=["u", "v", "ratio"])

    out = window_cooccurrence(own, tokens, window, count, emit, "u string, v string, ratio double", ("token", column))
    return out.select("u", "v", F.log("ratio").alias("value"))


def neighbour_sums(docs: DataFrame, tokens: DataFrame, window: int, term: Callable[[np.ndarray, np.ndarray], np.ndarray], column: str, topics: int) -> DataFrame:
    """(token, topic, value): the sum over all places of a token, and all neighbours v of another token in its window, of term(x_u, x_v), rows of topics
    numbers from rows of `column` of tokens (by_frequency); term is symmetric or looks at x_v alone. Sums over pairs that need no pairs to meet: tokens of a piece do."""
    uri, columns = path_of(tokens), ("token", column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, list_of, _ in _pieces(batches):
            num, table = _numbers(words, uri, columns)
            values = np.asarray(table[column].values).reshape(-1, topics)
            x = values[num] if len(values) else np.zeros((len(num), topics))
            sums, seen = np.zeros((len(num), topics)), np.zeros(len(num), bool)
            for k in range(1, window + 1):
                ok = np.flatnonzero((list_of[k:] == list_of[:-k]) & (num[k:] >= 0) & (num[:-k] >= 0) & (num[k:] != num[:-k]))
                u, v = x[ok], x[ok + k]
                sums[ok] += term(u, v)
                sums[ok + k] += term(v, u)
                seen[ok] = seen[ok + k] = True
            at, own = np.unique(num[seen], return_inverse=True)
            part = np.stack([np.bincount(own, sums[seen, t], len(at)) for t in range(topics)], axis=1)
            for i in range(0, len(at), OUT_ROWS):
                p = part[i : i + OUT_ROWS]
                yield pa.RecordBatch.from_arrays([table["token"].take(pa.array(at[i : i + OUT_ROWS])), *(pa.array(p[:, t]) for t in range(topics))], names=["token", *(f"t{t}" for t in range(topics))])

    parts = items(docs).mapInArrow(run, "token string, " + ", ".join(f"t{t} double" for t in range(topics)))
    total = parts.groupBy("token").agg(*[F.sum(f"t{t}").alias(f"t{t}") for t in range(topics)])
    return total.select("token", F.posexplode(F.array(*[f"t{t}" for t in range(topics)])).alias("topic", "value"))
