"""Language-model scoring by prediction by partial matching over bytes.

A context trie of depth ORDER is held by levels: for each context of 0 .. ORDER bytes the bytes seen
after it and how often. A byte is coded in its longest known context; if it wasn't seen there, an
escape is coded (estimated by the number of different bytes seen, method C) and the next shorter
context is tried without the bytes that the longer one would have coded (symbol exclusion), down to
equal chances for the bytes never seen. A document's score is its code length.

The trie is trained on the whole corpus, the document with it. What occurs once there is no evidence, as it may come from the document
itself: a byte counts in a context if it was seen there LEAST = 2 times. So a text of its own costs escapes down to contexts
that others share, and one that occurs twice is told by its other copy.

Code lengths depend on a byte and its ORDER predecessors, a gram. They are found in an exchange of compressed lists:

1. Every source (a run of rows of a file) sends its different grams and their numbers, sorted and packed, to owners: all grams
   whose context ends with the same LOCAL bytes have one owner.
2. An owner adds up its lists (in a tree, if they are many) and has all levels from LOCAL up; the levels below, of at most
   2 ** 24 grams, are gathered once and sent to all owners. It computes the code length of each of its grams.
3. The owner answers each list with the code lengths of its grams. An owner with many lists to answer is several, with a copy of its table each.
4. Every source's task reads its own answers from the shared folder and adds up the code lengths of its texts.

Neither texts nor a row for each gram of a text are shuffled, and nothing is sent to all tasks that grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import filesystem, scratch, shared_dir, written
from .place import block, placed
from .text import CHUNK, HashTable, as_bytes, chunks, trim

ORDER = 6
#: Times that a byte must have been seen in a context.
LEAST = 2
#: Bytes at a context's end that name its owner.
LOCAL = 3
#: Rows of a source; a task holds the table of one.
SOURCE_ROWS = 1 << 12
#: Bytes of the corpus's files for an owner, about; most owners.
OWNER_BYTES, OWNERS = 16 << 20, 1 << 13
#: Steps in a bit: code lengths of grams are rounded to them.
STEPS = 1024
#: Lists that are added up at once.
FAN = 64
#: Grams asked for in one answering task, about.
ASKED = 4_000_000
#: Different grams of a source from which a list is sent before its end.
HELD = 2_000_000
SOURCES_PER_FOLDER = 8


def gram_pieces(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Every byte with its `order` predecessors as a number, zeros before a row's start: arrays of about
    CHUNK grams, the first gram of each row in it (len rows+1), and the first row's index."""
    for a, b in chunks(offsets):
        own, first = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        row = np.repeat(np.arange(b - a), np.diff(first))
        padded = np.zeros(len(own) + order * (b - a), np.uint8)
        at = np.arange(len(own)) + order * (row + 1)
        padded[at] = own
        for i in range(0, len(own), 4 * CHUNK):  # more than one piece in a very long text only
            part = at[i : i + 4 * CHUNK]
            if len(part) and part[-1] - part[0] + 1 == len(part):
                windows = [padded[part[0] - j : part[-1] - j + 1] for j in range(order, -1, -1)]
            else:
                windows = [padded[part - j] for j in range(order, -1, -1)]
            grams = np.zeros(len(part), np.uint64)
            for x in windows:
                grams = grams << np.uint64(8) | x
            yield grams, np.clip(first - i, 0, len(part)), a


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different grams, ascending, and the sums of their numbers."""
    grams, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    heads = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return grams[heads], np.add.reduceat(n, heads) if len(heads) else n


def pack(grams: np.ndarray, size: int) -> bytes:
    """Ascending numbers of `size` bytes, compressed: their first bytes, then their second ones and so on."""
    planes = grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack(blob: bytes, count: int, size: int) -> np.ndarray:
    """The inverse of pack()."""
    raw = pa.Codec("zstd").decompress(blob, count * size, asbytes=True)
    out = np.zeros((count, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, count).T
    return out.view("<u8").ravel().astype(np.uint64)


_LISTS = pa.schema([("source", pa.int64()), ("owner", pa.int32()), ("count", pa.int64()), ("grams", pa.binary()), ("n", pa.binary())])
_LISTS_SQL = "source long, owner int, count long, grams binary, n binary"


def _owner(grams: np.ndarray, local: int, owners: int) -> np.ndarray:
    end = (grams >> np.uint64(8)) & np.uint64((1 << 8 * local) - 1)
    return (((end + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % owners


def _lists(order: int, owners: int):
    local, size = min(LOCAL, order), order + 1

    def cut(source: int, parts: list) -> pa.RecordBatch:
        grams, n = _merge(parts)
        owner = _owner(grams, local, owners)
        by = np.argsort(owner, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(owner[by])) + 1, len(by)) if len(by) else np.zeros(0, np.int64)
        columns: list[list] = [[], [], [], [], []]
        for a, b in zip(np.append(0, ends[:-1]), ends):
            own = by[a:b]
            for c, x in zip(columns, (source, int(owner[own[0]]), len(own), pack(grams[own], size), pack(n[own].astype(np.uint64), 8))):
                c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTS)], schema=_LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, parts, held = None, [], 0
        for batch in batches:
            every = batch["source"].to_numpy()
            edges = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            for a, b in zip(edges, np.append(edges[1:], len(every))):
                if every[a] != source:
                    if parts:
                        yield cut(source, parts)
                        trim()
                    source, parts, held = int(every[a]), [], 0
                for grams, _, _ in gram_pieces(*as_bytes(batch["text"].slice(a, b - a)), order):
                    parts.append(np.unique(grams, return_counts=True))
                    held += len(parts[-1][0])
                    if held > HELD:
                        parts = [_merge(parts)]
                        held = len(parts[0][0])
                        if held > HELD:
                            yield cut(source, parts)
                            parts, held = [], 0
        if parts:
            yield cut(source, parts)
        del parts
        trim()

    return run


def _shallow(order: int):
    """(gram, n) of the deepest level that all owners get, from lists."""
    local, size = min(LOCAL, order), order + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for batch in batches:
            for count, grams, n in zip(batch["count"].to_pylist(), batch["grams"].to_pylist(), batch["n"].to_pylist()):
                parts.append(_merge([(unpack(grams, count, size) & np.uint64((1 << 8 * local) - 1), unpack(n, count, 8).astype(np.int64))]))
                if len(parts) > 256:
                    parts = [_merge(parts)]
        if parts:
            grams, n = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n)], names=["gram", "n"])
        del parts
        trim()

    return run


class Level:
    """A level's grams, ascending: how often each occurs, and what its context has seen: all, of how many kinds; and how often its context's bytes
    follow the next shorter context. lengths: of its byte from the next shorter context down, without the bytes this context has seen."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, below: Level | None, shorter: int):
        self.grams, self.n = grams, n
        self.kept = n >= LEAST
        edges = np.flatnonzero(np.append(True, np.diff(grams >> np.uint64(8)) != 0)) if len(grams) else np.zeros(0, np.int64)
        times = np.diff(np.append(edges, len(grams)))
        summed = lambda x: np.repeat(np.add.reduceat(np.where(self.kept, x, 0), edges), times) if len(edges) else np.zeros(0, np.int64)
        self.all, self.kinds = summed(n), summed(np.ones(len(n), np.int64))
        if below is None:
            self.lengths = np.log2(256.0 - self.kinds)
            return
        at = np.searchsorted(below.grams, grams & np.uint64((1 << 8 * shorter) - 1))
        self.lengths = below.coded(at, summed(below.n[at]), self.kinds)

    def coded(self, at: np.ndarray, used: np.ndarray | int = 0, different: np.ndarray | int = 0) -> np.ndarray:
        """Code lengths of grams `at` from this level down, without bytes seen `used` times here, of so many kinds."""
        total, left = self.all[at] - used, self.kinds[at] - different
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(left > 0, np.log2((total + left) / left), 0.0)
            return np.where(self.kept[at], np.log2((total + left) / self.n[at]), escape + self.lengths[at])


def levels(grams: np.ndarray, n: np.ndarray, first: int, last: int, below: Level | None) -> Level:
    """The level of `last` bytes before the coded one, on top of those from `first` on and of what is below them."""
    for k in range(first, last + 1):
        own = _merge([(grams & np.uint64((1 << 8 * (k + 1)) - 1), n)]) if k < last else (grams, n)
        below = Level(*own, below, k)
    return below


_SUMS_SQL = "owner int, slot int, count long, grams binary, n binary"
_TABLE_SQL = "owner int, count long, grams binary, bits binary"
_ANSWER_SQL = "source long, count long, grams binary, bits binary"


def _added(order: int, shallow=None):
    """Lists of an owner (and slot) as one; with the levels below, an owner's table of code lengths."""
    size = order + 1

    def run(key: tuple, lists: pa.Table) -> pa.Table:
        parts: list = []
        for batch in lists.select(["count", "grams", "n"]).to_batches(max_chunksize=16):
            for r in batch.to_pylist():
                parts.append((unpack(r["grams"], r["count"], size), unpack(r["n"], r["count"], 8).astype(np.int64)))
        grams, n = _merge(parts)
        del parts
        own = {"owner": pa.array([key[0].as_py()], pa.int32()), "count": [len(grams)], "grams": [pack(grams, size)]}
        if shallow is None:
            return pa.table({"owner": own["owner"], "slot": pa.array([key[1].as_py()], pa.int32()), "count": own["count"], "grams": own["grams"], "n": [pack(n.astype(np.uint64), 8)]})
        top = levels(grams, n, min(LOCAL, order), order, shallow.value)
        trim()
        return pa.table(own | {"bits": [pack(np.rint(top.coded(np.arange(len(grams))) * STEPS).astype(np.uint64), 3)]})

    return run


def _answered(order: int):
    size = order + 1

    def run(lists: pa.Table, table: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if len(lists) and len(table):
            own = table.to_pylist()[0]
            known, bits = unpack(own["grams"], own["count"], size), unpack(own["bits"], own["count"], 3)
            for batch in lists.to_batches(max_chunksize=64):
                for r in batch.to_pylist():
                    found = bits[np.searchsorted(known, unpack(r["grams"], r["count"], size))]
                    for c, x in zip(columns, (r["source"], r["count"], r["grams"], pack(found, 3))):
                        c.append(x)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        trim()
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["source", "count", "grams", "bits"])

    return run


def _summed(path: str, folders: int, order: int):
    """A column function of source and text: code length in bits."""
    size, cache = order + 1, {}

    def lengths(source: int) -> tuple[HashTable, np.ndarray]:
        """The table of the answers to a source."""
        import pyarrow.dataset as ds

        files, root = filesystem(path)
        got = ds.dataset(f"{root}/folder={source % folders}", filesystem=files, format="parquet").to_table(filter=ds.field("source") == source)
        grams, bits = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for batch in got.to_batches(max_chunksize=64):
            for r in batch.to_pylist():
                grams.append(unpack(r["grams"], r["count"], size))
                bits.append(unpack(r["bits"], r["count"], 3).astype(np.uint32))
        known, at = np.unique(np.concatenate(grams), return_index=True)
        out = HashTable(known), np.concatenate(bits)[at]
        del got, grams, bits, at
        trim()
        return out

    def length(source: pa.Array, text: pa.Array) -> pa.Array:
        every = source.to_numpy(zero_copy_only=False)
        sums = np.zeros(len(every))
        edges = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        for a, b in zip(edges, np.append(edges[1:], len(every))):
            data, offsets = as_bytes(text.slice(a, b - a))
            if not len(data):
                continue
            if every[a] not in cache:
                cache.clear()
                cache[every[a]] = lengths(int(every[a]))
            table, bits = cache[every[a]]
            for grams, first, row in gram_pieces(data, offsets, order):
                total = np.append(0, np.cumsum(bits[table.find(grams)], dtype=np.int64))
                sums[a + row : a + row + len(first) - 1] += total[first[1:]] - total[first[:-1]]
        return pa.array(sums / STEPS)

    return F.arrow_udf(length, "double")


def score_language(docs: DataFrame, order: int = ORDER, source_rows: int = SOURCE_ROWS, owners: int | None = None, asked: int = ASKED) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) for every row of docs.

    A null or empty text has 0 bytes, 0 bits and null bits_per_byte. Rows that repeat a text have
    equal scores, and lower ones than if it stood once. A corpus in which nothing occurs twice gives 8 bits for every byte. Other columns are
    ignored. An empty table gives an empty result.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be from 1 to 7")
    spark = docs.sparkSession
    docs, file, row = placed(docs.select("doc_id", "text"))
    source = block(file, row, source_rows)
    if owners is None:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        owners = min(OWNERS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // OWNER_BYTES))
    sources = max(1, docs.count() // source_rows)
    folders = max(1, sources // SOURCES_PER_FOLDER)
    path = shared_dir(spark)
    with scratch(spark):
        lists = written(docs.where("text <> ''").select(source.alias("source"), "text").mapInArrow(_lists(order, owners), _LISTS_SQL))
        shallow = lists.select("count", "grams", "n").mapInArrow(_shallow(order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().sort_by("gram")
        local = min(LOCAL, order)
        sent = spark.sparkContext.broadcast(levels(shallow["gram"].to_numpy().view(np.uint64), shallow["n"].to_numpy(), 0, local - 1, None))
        slots = max(1, math.ceil(sources / FAN))
        sums = lists.select("owner", F.pmod("source", F.lit(slots)).cast("int").alias("slot"), "count", "grams", "n")
        while slots > 1:
            slots = math.ceil(slots / FAN)
            sums = sums.groupBy("owner", "slot").applyInArrow(_added(order), _SUMS_SQL).withColumn("slot", F.expr(f"slot % {slots}").cast("int"))
        tables = written(sums.groupBy("owner").applyInArrow(_added(order, sent), _TABLE_SQL))
        # A row for each owner, OWNERS at most.
        parts = lists.groupBy("owner").agg(F.sum("count").alias("asked")).join(tables.select("owner", F.col("count").alias("known")), "owner")
        parts = F.broadcast(parts.select("owner", F.ceil(F.col("asked") / F.greatest(F.lit(asked), 4 * F.col("known"))).cast("int").alias("parts")))
        left = lists.join(parts, "owner").withColumn("part", F.pmod(F.xxhash64("source"), F.col("parts"))).select("owner", "part", "source", "count", "grams")
        right = tables.join(parts, "owner").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("owner", "part", "count", "grams", "bits")
        answers = left.groupBy("owner", "part").cogroup(right.groupBy("owner", "part")).applyInArrow(_answered(order), _ANSWER_SQL)
        answers.withColumn("folder", F.pmod("source", F.lit(folders))).repartition("folder").sortWithinPartitions("folder", "source").write.option("parquet.block.size", 32 << 20).partitionBy("folder").parquet(path)
        sent.unpersist()
    text = F.coalesce("text", F.lit(""))
    n = F.octet_length(text).cast("long").alias("n_bytes")
    out = docs.select("doc_id", n, _summed(path, folders, order)(source, text).alias("bits"))
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")))
