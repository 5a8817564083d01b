"""Topic models whose matrices are tables: for any number of tokens and topics.

Documents lie in blocks, a file each, with the block's words numbered in it; they are never shuffled. Matrices are chunks of CHUNK rows. A pass sends each block
the rows of Phi that its words need, once for the whole block, runs the same kernel as a model that the driver holds, with the same regularizers of Theta and scores
of documents, and sends back its part of n_wt for those rows only; parts meet by chunk. Phi's
regularizers that look at one row at a time run in NumPy over chunks, the other ones as joins of long tables
(operators.regularizers). Only sums by class and topic reach the driver. Every pass is a written table, and the one before is deleted.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import random_rows
from ..operators import phi_regularizers as P
from ..operators import regularizers as R
from ..operators.cumulative import ClassPrecision, CumulativeScore
from ..operators.kernel import Batch, likelihood_sums, normalize_rows, transaction_sums
from ..operators.rank import token_numbers
from ..operators.theta_regularizers import HierarchySparsingTheta, PtdwRegularizer, ThetaRegularizer, TopicSelectionTheta
from ..operators.weights import weighted
from ..schema import DEFAULT_TRANSACTION, EPS, TINY
from ..storage import drop, filesystem, path_of, written
from .model import BATCH_DOCS, Matrices, Pass, _run

#: Bytes of a block's documents, as they are read, where there are more than a block for each core.
BLOCK_BYTES = 64 << 20
#: Words that are encoded at once, about.
PIECE = 1 << 19
#: Rows of a chunk of a matrix.
CHUNK = 1 << 16
#: Regularizers of Phi whose term of a token depends on that token's row alone.
BY_ROW = (P.SmoothSparsePhi, P.DecorrelatorPhi, P.MultiLanguagePhi, P.LabelRegularizationPhi)


def _matrix(column: pa.Array, topics: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), topics)


def _lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def _by_row(r: P.PhiRegularizer) -> bool:
    return isinstance(r, BY_ROW) or isinstance(r, P.SpecifiedSparsePhi) and r.mode != "sparse_topics"


def _even(spark: SparkSession, n: int) -> list[int]:
    """n numbers of which a hash partitioning into n gives each partition one."""
    got = spark.range(40 * n + 200).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).agg(F.min("id").alias("k")).collect()
    return [k for _, k in sorted((r["p"], r["k"]) for r in got)]


def _scan(uri: str, columns: list[str], where, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of a written table, read by the task itself; row groups that can't match `where` are left out."""
    import pyarrow.dataset as ds

    fs, path = filesystem(uri)
    yield from ds.dataset(path, format="parquet", filesystem=fs).scanner(columns=columns, filter=where, batch_size=rows, batch_readahead=1, fragment_readahead=1, use_threads=False).to_batches()


def _chunk(uri: str, chunk: int, column: str = "x"):
    """A column of a chunk's row; None if the table lacks the chunk."""
    import pyarrow.dataset as ds

    for b in _scan(uri, [column], ds.field("chunk") == chunk):
        if b.num_rows:
            return b[column][0]
    return None


def _rows_of(uri: str, chunk: int, size: int, topics: int) -> np.ndarray:
    x = _chunk(uri, chunk)
    return np.zeros((size, topics)) if x is None else np.frombuffer(x.as_buffer(), float).reshape(size, topics)


@dataclass
class Blocks:
    """An encoded corpus. docs: a file for each block, with its documents and, after them, its words by their numbers in the block; need: by chunk of a model's
    matrices and block, the rows that the block needs and their numbers there."""

    docs: DataFrame
    need: DataFrame
    keys: list[int]


def _grouped(ndw: DataFrame, class_weights: dict[str, float] | None, type_weights: dict[str, float] | None) -> DataFrame:
    """(item_id, title, scale, typed, x), a row for each item, from ndw as model.encode() takes it."""
    have = set(ndw.columns)
    own = weighted(ndw, class_weights)
    title = F.coalesce("title", F.col("item_id").cast("string")) if "title" in have else F.col("item_id").cast("string")
    scale = F.col("batch_weight").cast("double") if "batch_weight" in have else F.lit(1.0)
    tt = F.col("tt_name") if "tt_name" in have else F.lit(DEFAULT_TRANSACTION)
    tx_weight = F.lit(1.0) if not type_weights else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in type_weights.items() for x in kv]), tt), F.lit(0.0))
    pos = F.col("pos").cast("int") if "pos" in have else F.lit(0)
    tx = F.col("tx_id").cast("int") if "tx_id" in have else F.lit(0)
    x = F.struct(pos.alias("pos"), "class_id", "token", F.col("weight").cast("double").alias("w"), tx.alias("tx"), tx_weight.alias("tx_weight"))
    typed = F.max(tt != DEFAULT_TRANSACTION) if "tt_name" in have else F.lit(False)
    return own.groupBy("item_id", title.alias("title"), scale.alias("scale")).agg(F.array_sort(F.collect_list(x)).alias("x"), typed.alias("typed"))


def bags(docs: DataFrame, scale: float = 1.0) -> DataFrame:
    """(item_id, classes, lists, scale), a row for each item, from rows of (item_id, classes, lists) that may repeat an id: the words of an item, a list for each class of
    classes. A corpus in this form is encoded without a shuffle."""
    docs = docs.select("item_id", "classes", "lists")
    again = docs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("item_id").alias("again"))
    if not again.isEmpty():
        same = docs["item_id"].eqNullSafe(again["again"])
        more = docs.join(again, same, "left_semi").groupBy("item_id").agg(F.collect_list(F.struct("classes", "lists")).alias("y")).select("item_id", F.flatten("y.classes").alias("classes"), F.flatten("y.lists").alias("lists"))
        docs = docs.join(again, same, "left_anti").unionAll(more)
    return docs.withColumn("scale", F.lit(scale))


def _slices(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Batches of about PIECE words."""
    for b in batches:
        ends = np.asarray(b["lists" if whole else "x"].offsets)
        upto, a = np.asarray(b["lists"].values.offsets)[ends] if whole else ends, 0
        while a < b.num_rows:
            z = min(b.num_rows, max(a + 1, int(np.searchsorted(upto, upto[a] + PIECE, side="right")) - 1))
            yield b.slice(a, z - a)
            a = z


def _counted(b: pa.RecordBatch, class_weights: dict[str, float] | None):
    """Of a batch of bags: each item's words once, with their counts: (item, class, word, weight, transactions, names of classes, words)."""
    lists = b["lists"]
    inner = lists.flatten()
    words = inner.flatten().dictionary_encode()
    kinds = b["classes"].flatten().dictionary_encode()
    sizes = lambda x: np.diff(np.asarray(x.offsets))
    list_item = np.repeat(np.arange(b.num_rows), sizes(lists))
    of = np.repeat(np.arange(len(inner)), sizes(inner))
    word, kind = np.asarray(words.indices.fill_null(-1)).astype(np.int64), np.asarray(kinds.indices).astype(np.int64)
    n, k = len(words.dictionary), max(1, len(kinds.dictionary))
    of, word = of[word >= 0], word[word >= 0]
    key = (list_item[of] * k + kind[of]) * n + word
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count, key = np.diff(np.append(new, len(key))).astype(float), key[new]
    item, kind, word = key // (k * n) if n else key, key // n % k if n else key, key % n if n else key
    names = kinds.dictionary.to_pylist()
    if class_weights:
        count *= np.array([class_weights.get(c, 0.0) for c in names] or [0.0])[kind]
    return item, kind, word, count, None, names, words.dictionary


def _listed(b: pa.RecordBatch):
    """As _counted(), of _grouped()."""
    pos, cls, token, w, tx, tx_weight = b["x"].flatten().flatten()
    kinds, words = cls.dictionary_encode(), token.dictionary_encode()
    item = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(b["x"].offsets)))
    return item, np.asarray(kinds.indices).astype(np.int64), np.asarray(words.indices).astype(np.int64), np.asarray(w, float), (np.asarray(tx), np.asarray(tx_weight)), kinds.dictionary.to_pylist(), words.dictionary


_DOCS = "block int, item_id long, title string, idx array<int>, weight array<double>, tx array<int>, tx_weight array<double>, typed boolean, scale double, local int, class_id string, token string"


def _encoder(class_weights: dict[str, float] | None, keys: list[int], whole: bool):
    """Documents of a block in its own numbers, and its words at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known, count = keys[TaskContext.get().partitionId()], {}, 0
        names = [f.split()[0] for f in _DOCS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.bool_(), pa.float64(), pa.int32(), pa.string(), pa.string()]

        def batch(n: int, **columns) -> pa.RecordBatch:
            columns["block"] = pa.array(np.full(n, block, np.int32))
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

        for b in _slices(batches, whole):
            item, kind, word, weight, tx, classes, words = _counted(b, class_weights) if whole else _listed(b)
            both, at = np.unique(kind * max(1, len(words)) + word, return_inverse=True)
            texts, local = words.take(pa.array(both % max(1, len(words)))).to_pylist(), np.empty(len(both), np.int32)
            for i, (c, t) in enumerate(zip((both // max(1, len(words))).tolist(), texts)):
                own = known.setdefault(classes[c], {})
                if (place := own.get(t)) is None:
                    own[t] = place = count
                    count += 1
                local[i] = place
            idx = local[at.ravel()] if len(local) else np.zeros(0, np.int32)
            ends = pa.array(np.searchsorted(item, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(x))
            ids = b["item_id"]
            more = {} if tx is None else {"tx": lists(tx[0].astype(np.int32)), "tx_weight": lists(tx[1].astype(float))}
            yield batch(b.num_rows, item_id=ids.cast(pa.int64()), title=ids.cast(pa.string()) if whole else b["title"], idx=lists(idx), weight=lists(weight), typed=pa.array(np.zeros(b.num_rows, bool)) if whole else b["typed"], scale=b["scale"], **more)
        for c, own in known.items():
            texts, local = list(own), np.fromiter(own.values(), np.int32, len(own))
            for i in range(0, len(texts), CHUNK):
                part = pa.array(texts[i : i + CHUNK], pa.string())
                yield batch(len(part), local=pa.array(local[i : i + CHUNK]), class_id=pa.array([c] * len(part), pa.string()), token=part)

    return run


def _documents(uri: str, block: int, topics: int):
    """Kernel batches of a block, in its own numbers, with Theta's start."""
    import pyarrow.dataset as ds

    columns = ["item_id", "title", "idx", "weight", "tx", "tx_weight", "typed", "scale"]
    for big in _scan(uri, columns, (ds.field("block") == block) & ds.field("idx").is_valid()):
        step = BATCH_DOCS * max(1, 256 * big.num_rows // max(1, len(big["idx"].flatten())))  # more of short documents
        for a in range(0, big.num_rows, step):
            b = big.slice(a, step)
            flat = lambda name: np.asarray(b[name].flatten())
            start = np.asarray(b["idx"].offsets).astype(np.int64)
            plain = b["tx"].null_count > 0
            yield b["item_id"], Batch(flat("idx").astype(np.int64), flat("weight").astype(float), start - start[0], b["title"].to_pylist(), np.asarray(b["scale"]), None if plain else flat("tx").astype(np.int64), None if plain else flat("tx_weight").astype(float)), np.full((b.num_rows, topics), 1.0 / topics), bool(np.any(b["typed"].to_numpy(zero_copy_only=False)))


class PartitionedModel:
    """As plans.model.TopicModel: fit_offline, fit_online, process, transform, matrix and history, with the same options and results; scores are those of
    operators.cumulative but ClassPrecision. ndw may also be bags(), the rows of grouped documents (x; see _grouped) or what encode() gave."""

    def __init__(self, topics: int | list[str], dictionary: DataFrame, class_weights: dict[str, float] | None = None, type_weights: dict[str, float] | None = None, document_passes: int = 10, seed: int = -1, regularizers: dict[str, object] | None = None, scores: dict[str, CumulativeScore] | None = None, collection_unigram: bool = False, block_docs: int | None = None, start: DataFrame | None = None):
        """start(class_id, token, x): rows of both matrices; else they are random. block_docs: documents of a block, about."""
        self.topics = [f"topic_{i}" for i in range(topics)] if isinstance(topics, int) else list(topics)
        self.class_weights, self.type_weights, self.document_passes, self.seed = class_weights, type_weights, document_passes, seed
        self.regularizers, self.scores, self.collection_unigram, self.block_docs = dict(regularizers or {}), dict(scores or {}), collection_unigram, block_docs
        if any(not isinstance(s, CumulativeScore) or isinstance(s, ClassPrecision) for s in self.scores.values()):
            raise ValueError("scores of a partitioned model are added up over documents; others are functions of matrix()")
        self.history: list[dict] = []
        self.updates = self.online_updates = 0
        self._parents: list[tuple[list[str], str, float]] = []
        self.spark = dictionary.sparkSession
        own = dictionary if not class_weights else dictionary.where(F.col("class_id").isin(list(class_weights)))
        self.vocab = written(token_numbers(own.select("class_id", "token", "value", "tf")))
        self.size = self.vocab.count()
        self.classes = sorted(r["class_id"] for r in self.vocab.select("class_id").distinct().collect())
        self.chunks = max(1, -(-self.size // CHUNK))
        #: By chunk, what a hash partitioning knows it by; the last is that of sums.
        self.keys = _even(self.spark, self.chunks + 1)
        codes, chunk_of = {c: i for i, c in enumerate(self.classes)}, self._chunk_of()

        def names(t: pa.Table) -> pa.Table:
            t = t.sort_by("token_idx")
            code = np.array([codes[c] for c in t["class_id"].to_pylist()], np.int32)
            one = lambda c: pa.array([t[c].to_pylist()], pa.list_(pa.string()))
            return pa.table({"at": pa.array([t["at"][0].as_py()], pa.int32()), "chunk": pa.array([chunk_of[t["at"][0].as_py()]], pa.int32()), "size": pa.array([len(code)], pa.int32()), "class_id": one("class_id"), "token": one("token"), "value": pa.array([t["value"].to_numpy().astype(float).tobytes()]), "code": pa.array([code.tobytes()])})

        #: A row for each chunk: its tokens with their classes and shares.
        self.names = written(self._dealt(self.vocab).groupBy("at").applyInArrow(names, "at int, chunk int, size int, class_id array<string>, token array<string>, value binary, code binary"))
        if start is None:
            n, seed = len(self.topics), self.seed

            def random(_: int, size: int, own: Matrices) -> np.ndarray:
                return random_rows(own.classes, own.tokens, n, seed)

            self._set(*self._normalized(random, True))
            self.n = self.p
        else:
            self.p = self.n = self._packed(start)

    # -- chunks

    def _chunk_of(self) -> dict[int, int]:
        return {k: i for i, k in enumerate(self.keys)}

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """rows with token_idx, by chunk."""
        at = F.element_at(F.array(*[F.lit(k) for k in self.keys]), (F.col("token_idx") / F.lit(CHUNK)).cast("int") + 1)
        return rows.withColumn("at", at.cast("int")).repartition(len(self.keys), "at")

    def _packed(self, rows: DataFrame) -> DataFrame:
        """The matrix of rows (class_id, token, x); zeros for tokens that it lacks, tokens that the model lacks are left out."""
        chunk_of, topics, size = self._chunk_of(), len(self.topics), self.size

        def pack(t: pa.Table) -> pa.Table:
            chunk = chunk_of[t["at"][0].as_py()]
            x = np.zeros((min(CHUNK, size - chunk * CHUNK), topics))
            x[t["token_idx"].to_numpy() - chunk * CHUNK] = _matrix(t["x"].combine_chunks(), topics)
            return pa.table({"chunk": pa.array([chunk], pa.int32()), "x": pa.array([x.tobytes()])})

        own = rows.select("class_id", "token", "x").join(self.vocab.select("token_idx", "class_id", "token"), ["class_id", "token"])
        return written(self._dealt(own.select("token_idx", "x")).groupBy("at").applyInArrow(pack, "chunk int, x binary"))

    def _over_chunks(self, f, schema: str, strings: bool = False) -> DataFrame:
        """What f(chunk, size, own) yields for every chunk; own: Matrices of the chunk, of class codes and without tokens unless strings."""
        chunk_of, topics, names = self._chunk_of(), self.topics, path_of(self.names)
        p, n = (path_of(getattr(self, k)) if hasattr(self, k) else None for k in ("p", "n"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, size in zip(b["at"].to_pylist(), b["size"].to_pylist()):
                    chunk = chunk_of[at]
                    read = lambda c: np.array(_chunk(names, chunk, c).as_py(), object)  # noqa: E731, B023
                    x = [np.zeros((0, len(topics))) if uri is None else _rows_of(uri, chunk, size, len(topics)) for uri in (p, n)]
                    yield from f(chunk, size, Matrices(read("class_id") if strings else np.frombuffer(_chunk(names, chunk, "code").as_py(), np.int32), read("token") if strings else np.zeros(size, object), topics, *x))

        return self.names.select("at", "size").repartition(len(self.keys), "at").mapInArrow(run, schema)

    def _normalized(self, make, strings: bool = False) -> tuple[DataFrame, dict]:
        """The written matrix of the positive parts of make(chunk, size, own) over their sums by class, and by class the share of its zeros."""
        names, topics = path_of(self.names), len(self.topics)

        def code(chunk: int) -> np.ndarray:
            return np.frombuffer(_chunk(names, chunk, "code").as_py(), np.int32)

        def sums(chunk: int, size: int, own: Matrices) -> Iterator[pa.RecordBatch]:
            x, c = np.maximum(make(chunk, size, own), 0.0), code(chunk)
            for i in np.unique(c):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([int(i)], pa.int32()), _lists(x[c == i].sum(axis=0)[None])], names=["chunk", "code", "s"])

        s = np.zeros((len(self.classes), topics))
        for r in sorted(self._over_chunks(sums, "chunk int, code int, s array<double>", strings).collect()):
            s[r["code"]] += r["s"]

        def divide(chunk: int, size: int, own: Matrices) -> Iterator[pa.RecordBatch]:
            x, c = np.maximum(make(chunk, size, own), 0.0), code(chunk)
            p = np.divide(x, s[c], out=np.zeros_like(x), where=s[c] > 0)
            p[p < TINY] = 0.0
            zeros = {str(i): [int((p[c == i] < EPS).sum()), int((c == i).sum())] for i in np.unique(c)}
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([p.tobytes()]), pa.array([json.dumps(zeros)])], names=["chunk", "x", "zeros"])

        out = written(self._over_chunks(divide, "chunk int, x binary, zeros string", strings))
        count = np.zeros((len(self.classes), 2))
        for r in out.select("zeros").collect():
            for i, v in json.loads(r["zeros"]).items():
                count[int(i)] += v
        return out, {c: float(z / (n * topics)) for c, (z, n) in zip(self.classes, count) if n}

    def _set(self, p: DataFrame, sparsity: dict) -> None:
        self.p, self._sparsity = p, sparsity

    @property
    def m(self) -> DataFrame:
        """(token_idx, class_id, token, value, pwt, nwt)."""
        names = path_of(self.names)

        def rows(chunk: int, size: int, own: Matrices) -> Iterator[pa.RecordBatch]:
            value = np.frombuffer(_chunk(names, chunk, "value").as_py(), float)
            for i in range(0, size, 8192):
                z = min(size, i + 8192)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(chunk * CHUNK + i, chunk * CHUNK + z)), pa.array(own.classes[i:z], pa.string()), pa.array(own.tokens[i:z], pa.string()), pa.array(value[i:z]), _lists(own.pwt[i:z]), _lists(own.nwt[i:z])], names=["token_idx", "class_id", "token", "value", "pwt", "nwt"])

        return self._over_chunks(rows, "token_idx long, class_id string, token string, value double, pwt array<double>, nwt array<double>", True)

    # -- the E-step

    def encode(self, ndw: DataFrame | Blocks) -> Blocks:
        """The corpus as the model's passes read it; give it to several calls to encode once."""
        if isinstance(ndw, Blocks):
            return ndw
        whole = "lists" in ndw.columns
        rows, cores = ndw if whole or "x" in ndw.columns else _grouped(ndw, self.class_weights, self.type_weights), self.spark.sparkContext.defaultParallelism
        if self.block_docs:
            blocks = max(1, -(-rows.count() // self.block_docs))
            rows = rows.repartition(blocks, "item_id")
        else:
            leaves = ndw._jdf.queryExecution().optimizedPlan().collectLeaves()
            size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
            blocks = cores * max(1, -(-size // (BLOCK_BYTES * cores))) if size < 1 << 60 else max(cores, rows.rdd.getNumPartitions())  # Spark may not know it
            rows = rows.coalesce(blocks)
        keys = _even(self.spark, blocks)
        docs = written(rows.mapInArrow(_encoder(self.class_weights, keys, whole), _DOCS))
        chunk_of = self._chunk_of()

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by([("block", "ascending"), ("token_idx", "ascending")])
            block, row, local = (t[c].to_numpy() for c in ("block", "token_idx", "local"))
            at = t["at"][0].as_py()
            row = (row - chunk_of[at] * CHUNK).astype(np.int32)
            every, first = np.unique(block, return_index=True)
            ends = np.append(first, len(block))
            cut = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(ends, ends[1:])])
            return pa.table({"at": pa.array(np.full(len(every), at), pa.int32()), "block": pa.array(every, pa.int32()), "rows": cut(row), "locals": cut(local.astype(np.int32))})

        words = docs.where("local IS NOT NULL").select("block", "local", "class_id", "token").join(self.vocab.select("token_idx", "class_id", "token"), ["class_id", "token"])
        need = self._dealt(words.select("block", "local", "token_idx")).groupBy("at").applyInArrow(pack, "at int, block int, rows binary, locals binary")
        return Blocks(docs, written(need), keys)

    def _plan(self, **options) -> Pass:
        agents = [r for r in self.regularizers.values() if isinstance(r, ThetaRegularizer) and not isinstance(r, HierarchySparsingTheta)]
        return Pass(self.document_passes, agents, [r for r in self.regularizers.values() if isinstance(r, PtdwRegularizer)], **options)

    def _blocks(self, docs: Blocks, run, schema: str) -> DataFrame:
        """run(the rows of Phi that a block needs) of all blocks."""
        p, names, topics, chunk_of, unigram, size = path_of(self.p), path_of(self.names), len(self.topics), self._chunk_of(), self.collection_unigram, self.size

        def serve(t: pa.Table) -> pa.Table:
            chunk = chunk_of[t["at"][0].as_py()]
            x = _rows_of(p, chunk, min(CHUNK, size - chunk * CHUNK), topics)
            value = np.frombuffer(_chunk(names, chunk, "value").as_py(), float) if unigram else None
            rows = [np.frombuffer(r.as_buffer(), np.int32) for r in t["rows"]]
            return pa.table({"block": t["block"], "at": t["at"], "rows": t["rows"], "locals": t["locals"], "p": pa.array([x[r].tobytes() for r in rows]), "value": pa.array([value[r].tobytes() if unigram else None for r in rows], pa.binary())})

        kinds = "block int, at int, rows binary, locals binary, p binary, value binary"
        pieces = docs.need.repartition(len(self.keys), "at").groupBy("at").applyInArrow(serve, kinds)
        every = self.spark.createDataFrame([(k, None, b"", b"", b"", b"") for k in docs.keys], kinds)  # a block whose words are all unknown too
        return pieces.unionAll(every).repartition(len(docs.keys), "block").groupBy("block").applyInArrow(run, schema)

    def _local(self, docs: Blocks, plan: Pass):
        """A function of a block's rows that gives its documents in batches, with Phi and where the parts of its rows go."""
        topics, names, unigram, scores, uri = len(self.topics), self.topics, self.collection_unigram, self.scores, path_of(docs.docs)

        def local(t: pa.Table):
            import pyarrow.dataset as ds

            block = t["block"][0].as_py()
            t = t.filter(t["at"].is_valid())
            joined = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
            known, phi = joined("locals", np.int32), joined("p", float).reshape(-1, topics)
            at = np.full(int(known.max()) + 2 if len(known) else 1, -1, np.int64)
            at[known] = np.arange(len(known))
            plan.unigram = joined("value", float) if unigram else None
            if scores:
                words = [b for b in _scan(uri, ["local", "class_id", "token"], (ds.field("block") == block) & ds.field("local").is_valid(), CHUNK)]
                words = pa.Table.from_batches(words).sort_by("local").take(pa.array(known)) if words else pa.table({"class_id": pa.array([], pa.string()), "token": pa.array([], pa.string())})
                m = Matrices(np.array(words["class_id"].to_pylist(), object), np.array(words["token"].to_pylist(), object), names, phi, phi)
                plan.cumulative = {k: s.prepared(m) for k, s in scores.items()}

            def batches():
                for ids, batch, theta, typed in _documents(uri, block, topics):
                    batch.idx = at[np.minimum(batch.idx, len(at) - 1)]
                    yield ids, batch, theta, typed

            sizes = [len(x) // 4 for x in t["rows"].to_pylist()]
            return (t["at"].to_pylist(), t["rows"].to_pylist(), np.append(0, np.cumsum(sizes)).astype(int)), phi, batches()

        return local

    def _pass(self, ndw: DataFrame | Blocks) -> tuple[DataFrame, dict]:
        """(chunk, x) and the sums of all documents."""
        docs = self.encode(ndw)
        for r in self.regularizers.values():
            if isinstance(r, TopicSelectionTheta) and (r.topic_value is None or self.updates):
                r.refresh(self._topic_sums()[None])
        plan = self._plan()
        local, topics, last, size, chunk_of = self._local(docs, plan), len(self.topics), self.keys[-1], self.size, self._chunk_of()
        merged = self._merged()

        def run(t: pa.Table) -> pa.Table:
            (ats, rows, ends), phi, batches = local(t)
            n, sums, states = np.zeros(phi.shape), {}, {k: c.start() for k, c in plan.cumulative.items()}
            for ids, batch, theta, typed in batches:
                counters, p = _run(batch, phi, theta, typed, plan)
                n[counters.rows] += counters.nwt
                got = transaction_sums(batch, p, counters.theta) if typed else likelihood_sums(batch, phi, counters.theta, plan.unigram)
                for k, v in got.items():
                    sums[k] = sums.get(k, 0.0) + v
                for k, c in plan.cumulative.items():
                    states[k] = c.append(states[k], ids.to_pylist(), batch, phi, counters.theta)
            parts = [n[a:z].tobytes() for a, z in zip(ends, ends[1:])]
            return pa.table({"at": pa.array([*ats, last], pa.int32()), "rows": pa.array([*rows, b""], pa.binary()), "n": pa.array([*parts, b""], pa.binary()), "sums": pa.array([None] * len(parts) + [json.dumps({"sums": sums, "states": states})], pa.string())})

        def add(t: pa.Table) -> pa.Table:
            at = t["at"][0].as_py()
            if at == last:
                return pa.table({"chunk": pa.array([-1], pa.int32()), "x": pa.array([b""]), "sums": pa.array([json.dumps(merged(t["sums"].to_pylist()))])})
            chunk = chunk_of[at]
            x = np.zeros((min(CHUNK, size - chunk * CHUNK), topics))
            for r, n in zip(t["rows"], t["n"]):
                x[np.frombuffer(r.as_buffer(), np.int32)] += np.frombuffer(n.as_buffer(), float).reshape(-1, topics)
            return pa.table({"chunk": pa.array([chunk], pa.int32()), "x": pa.array([x.tobytes()]), "sums": pa.array([None], pa.string())})

        parts = self._blocks(docs, run, "at int, rows binary, n binary, sums string")
        total = written(parts.repartition(len(self.keys), "at").groupBy("at").applyInArrow(add, "chunk int, x binary, sums string"))
        got = merged(r["sums"] for r in total.where("chunk < 0").select("sums").collect())
        sums = got["sums"]
        if not sums.get("items"):
            raise ValueError("no items to process")
        if not sums["token_weight_in_effect"]:
            raise ValueError("no token of the items is in the model")
        if self._parents:
            total = self._with_parents(total)
        return total, sums | {"states": got["states"]}

    def _merged(self):
        """A function that adds up sums and states of blocks."""
        scores = self.scores

        def merged(texts) -> dict:
            sums, states = {}, {k: c.start() for k, c in scores.items()}
            for x in map(json.loads, texts):
                for k, v in x["sums"].items():
                    sums[k] = sums.get(k, 0.0) + v
                for k, c in scores.items():
                    states[k] = c.merge(states[k], x["states"][k])
            return {"sums": sums, "states": states}

        return merged

    def _topic_sums(self) -> np.ndarray:
        """n_wt by topic."""

        def sums(chunk: int, size: int, own: Matrices) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), _lists(own.nwt.sum(axis=0)[None])], names=["chunk", "s"])

        return np.sum([r["s"] for r in sorted(self._over_chunks(sums, "chunk int, s array<double>").collect())], axis=0)

    # -- the M-step

    def _long(self, m: DataFrame, column: str) -> DataFrame:
        names = F.array(*[F.lit(t) for t in self.topics])
        return m.select("class_id", "token", F.explode(F.arrays_zip(names.alias("topic"), F.col(column).alias("value"))).alias("x")).select("class_id", "token", "x.topic", "x.value")

    def _wide(self, long: DataFrame) -> DataFrame:
        each = [F.sum(F.when(F.col("topic") == t, F.col("value"))) for t in self.topics]
        return long.groupBy("class_id", "token").agg(F.array(*[F.coalesce(e, F.lit(0.0)) for e in each]).alias("r"))

    def _joined_term(self, r: P.PhiRegularizer, m: DataFrame) -> DataFrame:
        """(class_id, token, r) of a regularizer that looks at several rows."""
        spark, p, n = m.sparkSession, self._long(m, "pwt"), self._long(m, "nwt")
        some = lambda t: t if not r.classes else t.where(F.col("class_id").isin(r.classes))
        if isinstance(r, P.SpecifiedSparsePhi):
            out = R.specified_sparse(some(n), "topic", r.max_elements_count, r.probability_threshold, r.topics)
        elif isinstance(r, (P.ImproveCoherencePhi, P.BitermsPhi)):
            cooc = spark.createDataFrame([(*k, float(v)) for k, v in r.cooc.items()], "class_id string, u string, v string, value double")
            out = R.improve_coherence(n, cooc) if isinstance(r, P.ImproveCoherencePhi) else R.biterms(p if not r.topics else p.where(F.col("topic").isin(r.topics)), n, cooc)
        elif isinstance(r, P.SmoothTimeInTopicsPhi) and r.classes and len(r.classes) == 1:
            out = R.smooth_time(p, r.classes[0])
        elif isinstance(r, P.NetPlsaPhi):
            v = spark.createDataFrame([(t, float(d)) for t, d in r.vertices.items()], "token string, d double")
            edges = list(r.edges.items()) + ([((b, a), w) for (a, b), w in r.edges.items()] if r.symmetric else [])
            out = R.net_plsa(p, n, r.class_id, v, spark.createDataFrame([(a, b, float(w)) for (a, b), w in edges], "src string, dst string, w double"))
        else:
            raise ValueError(f"{type(r).__name__} needs a model that the driver holds, or one class")
        out = some(out)
        return self._wide(out if not r.topics else out.where(F.col("topic").isin(r.topics)))

    def _regularized(self, m: DataFrame) -> DataFrame:
        """m with x: nwt and the regularizers' terms."""
        regs = [r for r in self.regularizers.values() if isinstance(r, P.PhiRegularizer)]
        columns: list[tuple[str, P.PhiRegularizer]] = []
        for k, r in enumerate(x for x in regs if not _by_row(x)):
            m = m.join(self._joined_term(r, m).withColumnRenamed("r", f"r{k}"), ["class_id", "token"], "left")
            columns.append((f"r{k}", r))
        names, here = self.topics, [r for r in regs if _by_row(r)]
        base = [f.name for f in m.schema.fields if f.name not in [c for c, _ in columns]]

        def terms(b: pa.RecordBatch) -> tuple[Matrices, list[tuple[P.PhiRegularizer, np.ndarray]]]:
            own = Matrices(np.array(b["class_id"].to_pylist(), object), np.array(b["token"].to_pylist(), object), names, _matrix(b["pwt"], len(names)), _matrix(b["nwt"], len(names)))
            got = [(r, r.term(own)) for r in here]
            for c, r in columns:
                got.append((r, np.stack([np.zeros(len(names)) if x is None else np.array(x, float) for x in b[c].to_pylist()])))
            return own, got

        relative = [i for i, r in enumerate([*here, *(r for _, r in columns)]) if r.gamma is not None]
        coef: dict[tuple[int, str], np.ndarray] = {}
        if relative:  # sums by class and topic

            def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        own, got = terms(b)
                        for c in np.unique(own.classes):
                            at = own.classes == c
                            for i in relative:
                                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([c]), _lists(np.concatenate([own.nwt[at].sum(axis=0), np.abs(got[i][1][at]).sum(axis=0)])[None])], names=["i", "class_id", "s"])

            got = m.mapInArrow(sums, "i long, class_id string, s array<double>").groupBy("i", "class_id").agg(F.array(*[F.sum(F.element_at("s", j + 1)) for j in range(2 * len(names))]).alias("s"))
            order = [*here, *(r for _, r in columns)]
            for x in got.collect():
                r, s = order[x["i"]], np.array(x["s"])
                n_t, r_t = s[: len(names)], s[len(names) :]
                used = np.ones(len(names), bool) if not r.topics else np.isin(names, r.topics)
                if r_t[used].sum() > 0:
                    own = np.divide(n_t, r_t, out=np.zeros_like(n_t), where=r_t > 0)
                    coef[x["i"], x["class_id"]] = np.where(used, r.gamma * own + (1 - r.gamma) * n_t[used].sum() / r_t[used].sum(), 0.0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                own, got = terms(b)
                x = own.nwt.copy()
                for i, (r, term) in enumerate(got):
                    if i in relative:
                        scale = {c: coef.get((i, c), np.zeros(len(names))) for c in np.unique(own.classes)}
                        term = term * np.stack([scale[c] for c in own.classes])
                    x += r.tau * term
                yield pa.RecordBatch.from_arrays([*(b[c] for c in base), _lists(x)], names=[*base, "x"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema.fields if f.name in base)
        return m.mapInArrow(run, f"{kinds}, x array<double>")

    def _update(self, n: DataFrame, sums: dict) -> None:
        """Phi from the matrix n."""
        old, self.n, topics, uri = (self.p, self.n), n, len(self.topics), path_of(n)
        regs = [r for r in self.regularizers.values() if isinstance(r, P.PhiRegularizer)]
        if all(_by_row(r) and r.gamma is None for r in regs):

            def make(chunk: int, size: int, own: Matrices) -> np.ndarray:
                return own.nwt + sum((r.tau * r.term(own) for r in regs), np.zeros_like(own.nwt))

            self._set(*self._normalized(make, bool(regs)))
        else:
            x = self._packed(self._regularized(self.m).select("class_id", "token", "x"))
            own_uri = path_of(x)
            self._set(*self._normalized(lambda chunk, size, own: _rows_of(own_uri, chunk, size, topics)))
            drop(x)
        for t in {path_of(t): t for t in old}.values():
            if path_of(t) not in (uri, path_of(self.p)):
                drop(t)
        self.updates += 1
        row = {"pass": self.updates, "sparsity_phi": self._sparsity}
        if sums.get("normalizer"):
            row |= {"perplexity": float(np.exp(-sums["raw"] / sums["normalizer"])), "sparsity_theta": sums["zero_topics"] / max(1.0, sums["total_topics"]), "zero_words": int(sums["zero_words"]),
                    "items": int(sums["items"]), "token_weight": sums["token_weight"], "token_weight_in_effect": sums["token_weight_in_effect"]}
        self.history.append(row | {k: s.value(sums["states"][k]) for k, s in self.scores.items() if k in sums.get("states", {})})

    def _mixed(self, parts: list[tuple[DataFrame, float]]) -> DataFrame:
        """The weighted sum of matrices; written."""
        uris, topics = [(path_of(t), w) for t, w in parts], len(self.topics)

        def mix(chunk: int, size: int, own: Matrices) -> Iterator[pa.RecordBatch]:
            x = sum(w * _rows_of(u, chunk, size, topics) for u, w in uris)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([x.tobytes()])], names=["chunk", "x"])

        return written(self._over_chunks(mix, "chunk int, x binary"))

    # -- hierarchy

    def set_parent(self, parent: PartitionedModel, weight: float = 1.0) -> None:
        """The parent's topics become documents of n_wt, with this weight."""
        wide = PartitionedModel.__new__(PartitionedModel)
        wide.__dict__ |= self.__dict__ | {"topics": parent.topics}
        self._parents = [(parent.topics, path_of(wide._packed(parent.m.select("class_id", "token", F.col("nwt").alias("x")))), weight)]

    def _parent_theta(self) -> np.ndarray:
        """Theta of the parent's topics: sums over chunks in every inner pass."""
        names, uri, _ = self._parents[0]
        theta = np.full((len(names), len(self.topics)), 1.0 / len(self.topics))
        agents = [*self._plan().agents, *[r for r in self.regularizers.values() if isinstance(r, HierarchySparsingTheta)]]
        for i in range(self.document_passes):

            def part(chunk: int, size: int, own: Matrices, theta=theta) -> Iterator[pa.RecordBatch]:
                w, z = _rows_of(uri, chunk, size, len(names)), own.pwt @ theta.T
                ratio = np.divide(w, z, out=np.zeros_like(w), where=np.abs(z) >= TINY)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), _lists(np.append((ratio.T @ own.pwt).ravel(), (w != 0).any(axis=0))[None])], names=["chunk", "s"])

            got = np.sum([r["s"] for r in sorted(self._over_chunks(part, "chunk int, s array<double>").collect())], axis=0)
            n_td = theta * got[: theta.size].reshape(theta.shape)
            r = sum((a(n_td, names, i) for a in agents), np.zeros_like(n_td))
            has = got[theta.size :] > 0
            theta = np.where(has[:, None], normalize_rows(n_td + r), theta)
        return theta

    def _with_parents(self, total: DataFrame) -> DataFrame:
        names, uri, weight = self._parents[0]
        theta, topics, own_uri = self._parent_theta(), len(self.topics), path_of(total)

        def both(chunk: int, size: int, own: Matrices) -> Iterator[pa.RecordBatch]:
            w, z = _rows_of(uri, chunk, size, len(names)), own.pwt @ theta.T
            ratio = np.divide(w, z, out=np.zeros_like(w), where=np.abs(z) >= TINY)
            x = _rows_of(own_uri, chunk, size, topics) + weight * own.pwt * (ratio @ theta)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([x.tobytes()])], names=["chunk", "x"])

        out = written(self._over_chunks(both, "chunk int, x binary"))
        drop(total)
        return out

    def psi(self) -> pd.DataFrame:
        """p(topic | parent topic)."""
        return pd.DataFrame(self._parent_theta().T, index=self.topics, columns=self._parents[0][0])

    # -- fitting and reading

    def fit_offline(self, ndw: DataFrame | Blocks, passes: int = 1) -> PartitionedModel:
        if passes < 1:
            raise ValueError("passes must be positive")
        docs = self.encode(ndw)
        for _ in range(passes):
            self._update(*self._pass(docs))
        return self

    def fit_online(self, chunks: list[DataFrame | Blocks], tau0: float = 1024.0, kappa: float = 0.7, apply: list[float] | None = None, decay: list[float] | None = None, asynchronous: bool = False) -> PartitionedModel:
        """As TopicModel.fit_online."""
        docs, waiting = [self.encode(c) for c in chunks], []

        def merge(i: int, got: tuple[DataFrame, dict]) -> None:
            self.online_updates += 1
            rho = (tau0 + self.online_updates) ** -kappa
            a, d = apply[i] if apply else rho, decay[i] if decay else 1 - rho
            both = self._mixed([(self.n, d), (got[0], a)])
            drop(got[0])
            self._update(both, got[1])

        for i, c in enumerate(docs):
            waiting.append(self._pass(c))
            if not asynchronous or len(waiting) == 2:
                merge(i if not asynchronous else i - 1, waiting.pop(0))
        for got in waiting:
            merge(len(docs) - 1, got)
        return self

    def process(self, ndw: DataFrame | Blocks) -> dict[str, float]:
        """The E-step alone: n_wt anew; Phi stays. Gives the sums of the documents."""
        self.n, sums = self._pass(ndw)
        return sums

    def transform(self, ndw: DataFrame | Blocks, want: str = "theta") -> DataFrame:
        """(item_id, title, theta); want ptx: (item_id, title, pos, p) of transactions."""
        docs, plan = self.encode(ndw), self._plan(want=want)
        local = self._local(docs, plan)

        def run(t: pa.Table) -> pa.Table:
            _, phi, batches = local(t)
            ids, titles, thetas = [pa.array([], pa.int64())], [], [np.zeros((0, phi.shape[1]))]
            for own, batch, theta, typed in batches:
                ids.append(own)
                titles += batch.titles
                thetas.append(_run(batch, phi, theta, typed, plan)[0].theta)
            return pa.table({"item_id": pa.concat_arrays(ids), "title": pa.array(titles, pa.string()), "theta": _lists(np.concatenate(thetas))})

        def ptx(t: pa.Table) -> pa.Table:
            _, phi, batches = local(t)
            ids, titles, places, values = [pa.array([], pa.int64())], [], [np.zeros(0, np.int32)], [np.zeros(0)]
            for own, batch, theta, typed in batches:
                p = _run(batch, phi, theta, typed, plan)[1]
                doc = batch.doc_of
                new = np.ones(len(doc), bool)
                new[1:] = (batch.tx[1:] != batch.tx[:-1]) | (doc[1:] != doc[:-1])
                doc = doc[new]
                ids.append(own.take(pa.array(doc)))
                titles += [batch.titles[i] for i in doc]
                places.append((np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.int32))
                values.append(p)
            return pa.table({"item_id": pa.concat_arrays(ids), "title": pa.array(titles, pa.string()), "pos": np.concatenate(places), "p": np.concatenate(values)})

        return self._blocks(docs, run, "item_id long, title string, theta array<double>") if want == "theta" else self._blocks(docs, ptx, "item_id long, title string, pos int, p double")

    def matrix(self, _spark=None, name: str = "pwt", eps: float | None = None) -> DataFrame:
        """A matrix as (class_id, token, topic, value); with eps only values above it."""
        long = self._long(self.m, name)
        return long if eps is None else long.where(F.abs("value") > eps)

    def phi(self) -> pd.DataFrame:
        """Phi in the driver; for small models."""
        got = self.m.orderBy("token_idx").toPandas()
        return pd.DataFrame(np.stack(got["pwt"].tolist()), index=pd.MultiIndex.from_arrays([got["class_id"], got["token"]]), columns=self.topics)
