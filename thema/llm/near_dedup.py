"""MinHash near-deduplication by chosen-path set similarity join.

A document is the set of its word K-grams and is embedded as MINHASHES minwise tokens. Independent trees
share one root, all documents; a node chooses 1 / threshold of the positions at random (from a hash of its path) and sends each document to
the child named by the document's minwise token there. Similar documents stay together on some path
with good probability, others part; repeating the tree makes the probability of missing a pair small. A node of at
most LEAF documents is compared exhaustively.

The levels run on Spark while nodes are larger than a task handles (MEMORY documents). A level compares a large node's
documents with one of them, its pivot, and labels those that are alike by it; a node whose documents all bear one label
is done, as they are connected already, so large groups of copies leave after a level. The subtree of
a smaller node is searched within one task in the same way. Connected components of the pairs found are the groups.

A text's identity is its MD5 sum; within the search it goes by a number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop, scratch, written
from .place import placed, repeated, without
from .text import WORD_PATTERN, as_bytes, chunks, lower, mix, range_hash, trim, word_hashes


def trees_for(recall: float, threshold: float, depth: int) -> int:
    """Trees after which a pair at the threshold has met in some node at this depth with probability recall: a node hands a pair on by each of its
    1 / threshold positions with probability threshold."""
    branches, p = max(1, round(1 / threshold)), 1.0
    for _ in range(depth):
        p = 1 - (1 - threshold * p) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p < 1 else 1


K = 3
THRESHOLD = 0.5
MINHASHES = 256
#: Probability that a pair at the threshold meets, and the depth it is asked for.
RECALL, DEPTH = 0.99, 4
TREES = trees_for(RECALL, THRESHOLD, DEPTH)
LEAF = 128
MEMORY = 20_000
#: Levels on Spark after which what is still larger than MEMORY (documents that share LEVELS chosen tokens without being like their pivots) is cut
#: in blocks, and every pair of blocks searched.
LEVELS = 24
#: Depth of a subtree within a task from which nodes are compared exhaustively, whatever their size.
DEEPEST = 12

_rng = np.random.default_rng(20240521)
_XOR = _rng.integers(0, 1 << 32, MINHASHES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, MINHASHES, dtype=np.uint32) | np.uint32(1)
_ROOT = _rng.permutation(MINHASHES)


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word k-grams, and each row's first (len rows+1). A row of 1 to k-1 words has
    one, of all of them."""
    n = np.diff(rows)
    counts = np.where(n > 0, np.maximum(n - (k - 1), 1), 0)
    first = np.append(0, np.cumsum(counts))
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    starts = np.arange(first[-1]) + np.repeat(rows[:-1] - first[:-1], counts)
    ends = np.minimum(starts + k, np.repeat(rows[1:], counts))
    return range_hash(words, starts, ends, 0xD6E8FEB86659FD93), first


def minhash(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(rows with grams, MINHASHES) minima."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    heads = first[:-1][np.diff(first) > 0]
    out = np.empty((len(heads), MINHASHES), np.uint32)
    for i in range(MINHASHES):
        out[:, i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], heads)
    return out


def positions(nodes: np.ndarray, branches: int) -> np.ndarray:
    """(nodes, branches) positions that nodes choose."""
    steps = np.arange(branches, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(nodes.astype(np.uint64)[:, None] + steps[None]) >> np.uint64(32)).astype(np.int64) % MINHASHES


def child(nodes: np.ndarray, position: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(nodes.astype(np.uint64) ^ (position.astype(np.uint64) << np.uint64(40))) + token.astype(np.uint64) + np.uint64(1))


def _signatures(k: int, roots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from of_batch(batch)
            trim()

    def of_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = as_bytes(lower(batch["text"]))
        keys = batch["ident"]
        for a, b in chunks(offsets):
            words, rows = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            grams, first = shingles(words, rows, k)
            own = np.flatnonzero(np.diff(first) > 0)
            if not len(own):
                continue
            m = minhash(grams, first)
            at = _ROOT[:roots]
            nodes = child(np.zeros((len(own), roots)), np.broadcast_to(at, (len(own), roots)), m[:, at]).view(np.int64)
            short = ((m * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                keys.slice(a, b - a).take(pa.array(own)),
                pa.array([r.tobytes() for r in short], pa.binary()),
                pa.ListArray.from_arrays(np.arange(0, len(own) * roots + 1, roots, dtype=np.int32), nodes.ravel()),
            ], names=["ident", "sig", "nodes"])

    return run


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 0 .. n-1 the least member of its component under the edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _alike(sig: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (a, b) agree in at least threshold of their minwise tokens."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), 8192):
        out[i : i + 8192] = (sig[a[i : i + 8192]] == sig[b[i : i + 8192]]).sum(axis=1) >= threshold * sig.shape[1]
    return out


def search(sig: np.ndarray, node: int, threshold: float, leaf: int = LEAF, deepest: int = DEEPEST) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect the similar documents of one node."""
    n = len(sig)
    label = np.arange(n)
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        """Records similar pairs; label stays each component's least member."""
        nonlocal label
        new = label[a] != label[b]
        if new.any():
            found_a.append(a[new])
            found_b.append(b[new])
            label = components(n, label[a[new]], label[b[new]])[label]

    branches = max(1, round(1 / threshold))
    todo = [(np.arange(n), node & ((1 << 64) - 1), 0)]
    while todo:
        own, v, depth = todo.pop()
        if (label[own] == label[own[0]]).all():
            continue
        if len(own) <= leaf or depth >= deepest:
            for i in range(len(own) - 1):
                rest = own[i + 1 :]
                rest = rest[label[rest] != label[own[i]]]
                hit = rest[(sig[rest] == sig[own[i]]).sum(axis=1) >= threshold * sig.shape[1]]
                if len(hit):
                    join(np.full(len(hit), own[i]), hit)
            continue
        pivot = own[v % len(own)]
        hit = own[(sig[own] == sig[pivot]).sum(axis=1) >= threshold * sig.shape[1]]
        join(np.full(len(hit), pivot), hit)
        if (label[own] == label[own[0]]).all():
            continue
        for at in positions(np.array([v], np.uint64), branches)[0]:
            token = sig[own, at]
            order = np.argsort(token, kind="stable")
            cuts = np.flatnonzero(np.diff(token[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    todo.append((own[part], int(child(np.array([v], np.uint64), np.array([at]), token[part[:1]])[0]), depth + 1))
    return np.concatenate([np.zeros(0, np.int64), *found_a]), np.concatenate([np.zeros(0, np.int64), *found_b])


def node_pairs(node: np.ndarray, sig: np.ndarray, threshold: float, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Connecting pairs of rows, of all nodes; node is ascending."""
    heads = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    sizes = np.diff(np.append(heads, len(node)))
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 16)]).tolist():
        i, j = np.triu_indices(size, 1)
        own = heads[sizes == size]
        a, b = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
        hit = _alike(sig, a, b, threshold)
        out_a.append(a[hit])
        out_b.append(b[hit])
    for k in np.flatnonzero(sizes > 16):
        a, b = search(sig[heads[k] : heads[k] + sizes[k]], int(node[heads[k]]), threshold, leaf)
        out_a.append(a + heads[k])
        out_b.append(b + heads[k])
    return np.concatenate(out_a), np.concatenate(out_b)


def _compare(threshold: float, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by node; a node that may go on in the next batch waits for it."""
        kept: list[pa.RecordBatch] = []

        def pairs(table: pa.Table) -> pa.RecordBatch:
            node, key = table["node"].to_numpy(), table["key"].to_numpy()
            sig = _matrix(table["sig"])
            a, b = node_pairs(node, sig, threshold, leaf)
            keys, at = np.unique(key, return_inverse=True)
            label = components(len(keys), at[a], at[b])
            own = np.flatnonzero(label != np.arange(len(keys)))
            return pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array(keys[label[own]])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch["node"].to_numpy()
            cut = int(np.searchsorted(node, node[-1]))
            if cut or kept and kept[-1]["node"][-1].as_py() != node[0]:
                yield pairs(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield pairs(pa.Table.from_batches(kept))

    return run


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, MINHASHES) of a column of signatures."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint16).reshape(len(column), MINHASHES)


def _branch(branches: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Labels what is like its node's pivot by the pivot, and sends each document to the node's children."""
        for batch in batches:
            if not batch.num_rows:
                continue
            node, key, label = batch["node"].to_numpy().view(np.uint64), batch["key"].to_numpy(), batch["label"].to_numpy()
            sig = _matrix(batch["sig"])
            like = (sig == _matrix(batch["pivot_sig"])).sum(axis=1) >= threshold * MINHASHES
            label = np.where(like, batch["pivot"].to_numpy(), label)
            at = positions(node, branches)
            new = child(np.repeat(node[:, None], branches, axis=1), at, np.take_along_axis(sig, at, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(new.ravel().view(np.int64)), pa.array(np.repeat(key, branches)), pa.array(np.repeat(label, branches))], names=["node", "key", "label"])

    return run


def _block_pairs(rows: DataFrame, memory: int) -> DataFrame:
    """(node, key, label) of nodes for all pairs of blocks of rows(node, key, label, n)."""
    blocks = F.ceil(F.col("n") / memory)
    own = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key", "node"), "blocks"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return own.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "key", "label")


def connected(edges: DataFrame) -> DataFrame:
    """(u, v): for every end of an edge (u, v) but the least of its component that least one. Stars are
    joined to larger ones and to smaller ones in turn until nothing changes; every round is a written table, and the one before is deleted.
    Least neighbours are partial aggregates, so a hub's edges meet in a join only, where adaptive execution splits them."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())

    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, now = None, state(edges)
    while now != before and now[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = down.select("u", F.col("m").alias("v")).unionAll(down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        old, edges = edges, written(small.distinct())
        drop(old)
        before, now = now, state(edges)
    return edges


def signed(docs: DataFrame, text: str, k: int, roots: int) -> DataFrame:
    """(ident, sig, nodes, key) of all different texts that have words, written: MD5 sum, minwise tokens, nodes below the trees' roots, and a number."""
    own = docs.where(F.col(text).isNotNull()).select(_ident(text).alias("ident"), F.col(text).alias("text"))
    own = own.mapInArrow(_signatures(k, roots), "ident binary, sig binary, nodes array<long>").dropDuplicates(["ident"])
    return written(own.withColumn("key", F.monotonically_increasing_id()))


def near_pairs(table: DataFrame, threshold: float, leaf: int, memory: int, levels: int) -> DataFrame:
    """(u, v): numbers of texts of the table of signed() that connect near duplicates."""
    branches = max(1, round(1 / threshold))
    rows = table.select(F.explode("nodes").alias("node"), "key", F.lit(-1).cast("long").alias("label"))
    sigs = table.select("key", "sig")
    edges = None
    for level in range(levels + 1):
        # Nodes whose documents bear one label are done; a label of -1 is none.
        stats = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        done = (F.col("low") == F.col("high")) & (F.col("low") >= 0)
        special = written(stats.where(done | (F.col("n") > memory)).select("node", "n", done.alias("done")))
        large = special.where("NOT done")
        some = not large.isEmpty()
        small = rows.join(special, "node", "left_anti") if some or level else rows
        if some and level == levels:
            small = small.unionAll(_block_pairs(rows.join(large, "node"), memory))
        nodes = small.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("keys")).where("size(keys) > 1")
        nodes = nodes.groupBy("keys").agg(F.min("node").alias("node"))  # trees often agree on a node's documents
        members = nodes.select("node", F.explode("keys").alias("key")).join(sigs, "key")
        found = members.repartition("node").sortWithinPartitions("node", "sig").select("node", "key", "sig").mapInArrow(_compare(threshold, leaf), "u long, v long")
        edges = found if edges is None else edges.unionAll(found)
        if not some or level == levels:
            break
        own = rows.join(large.select("node"), "node").join(sigs, "key").select("node", "key", "label", "sig")
        pivots = own.groupBy("node").agg(F.min_by(F.struct("key", "sig"), F.xxhash64("sig", "node")).alias("p")).select("node", F.col("p.key").alias("pivot"), F.col("p.sig").alias("pivot_sig"))
        rows = written(own.join(pivots, "node").mapInArrow(_branch(branches, threshold), "node long, key long, label long").distinct())
        edges = edges.unionAll(rows.where("label >= 0 AND label <> key").select(F.col("key").alias("u"), F.col("label").alias("v")).distinct())
    return edges


def _ident(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _has_words(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(f"[A-Z]|{WORD_PATTERN}"), F.lit(False))


def _components(docs: DataFrame, text: str, k: int = K, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, memory: int = MEMORY, levels: int = LEVELS) -> DataFrame:
    """(ident, comp) of all different texts that have words, written."""
    roots = trees * max(1, round(1 / threshold))
    if roots > MINHASHES:
        raise ValueError("too many trees")
    with scratch(docs.sparkSession) as s:
        table = signed(docs, text, k, roots)
        ends = connected(near_pairs(table, threshold, leaf, memory, levels)).withColumnsRenamed({"u": "key", "v": "root"})
        return s.keep(written(table.select("ident", "key").join(ends, "key", "left").select("ident", F.coalesce("root", "key").alias("comp"))))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, group_id, kept) for every row of docs: group_id is the least doc_id of its group, kept is
    true for one row of each group.

    Exact copies belong to a group too. A text without words (null, empty, signs only) is a group of
    its own and kept. Texts of fewer words than K are alike only if their words are the same. A null doc_id
    is larger than any other; of rows that repeat a doc_id and a text one is kept. doc_id may be of any type. An empty table
    gives an empty result; other columns are ignored. options: k, threshold, trees (see trees_for), leaf, memory, levels.
    """
    comps = _components(docs, text, **options)
    rows = docs.where(_has_words(text)).groupBy(_ident(text).alias("ident"), F.col(doc_id).alias("doc_id")).agg(F.count(F.lit(1)).alias("m")).join(comps, "ident")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ident")).alias("best"))
    rows = repeated(rows.join(best, "comp"), "m", ["ident", "doc_id"])
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("ident") == F.col("best.ident")) & (F.col("copy") == 0)
    out = rows.select("doc_id", F.col("best.doc_id").alias("group_id"), first.alias("kept"))
    alone = docs.where(~_has_words(text)).select(F.col(doc_id).alias("doc_id"))
    return out.unionAll(alone.select("doc_id", F.col("doc_id").alias("group_id"), F.lit(True).alias("kept")))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates() keeps. Texts are not shuffled: what goes is named by its place."""
    own, file, row = placed(docs)
    comps = _components(own, text, **options)
    keys = own.where(_has_words(text)).select(_ident(text).alias("ident"), F.col(doc_id).alias("doc_id"), F.col(file).alias("file"), F.col(row).alias("row"))
    rows = keys.join(comps, "ident")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ident", "file", "row")).alias("best")
    best = rows.groupBy("comp").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("comp", "best")
    bad = rows.join(best, "comp").where((F.col("file") != F.col("best.file")) | (F.col("row") != F.col("best.row")))
    return without(own, file, row, bad.select("file", "row")).select(docs.columns)
