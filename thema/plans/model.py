"""Topic models: EM passes over a corpus of encoded documents.

A pass is one Spark job: tasks hold Phi, run the kernel over their documents and add up n_wt, one partial
sum for each partition; partial sums meet by blocks of rows in a shuffle, and their totals return to the driver, which
regularizes and normalizes. Documents are encoded once, token strings never travel again. Phi and
n_wt are the driver's: their size is checked against MODEL_BYTES. topic_model() chooses between this and plans.partitioned, whose matrices
are tables, by that size.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import random_row, random_rows
from ..operators import estep, matrix
from ..operators.cumulative import CumulativeScore
from ..operators.kernel import Batch, likelihood_sums, occurrences, plain, transaction_sums, transactions
from ..operators.phi_regularizers import PhiRegularizer, total
from ..operators.rank import token_numbers
from ..operators.theta_regularizers import HierarchySparsingTheta, PtdwRegularizer, ThetaRegularizer, TopicSelectionTheta
from ..operators.weights import weighted
from ..schema import DEFAULT_TRANSACTION, DOCUMENTS_CLASS, EPS, TINY
from ..storage import drop, drop_path, exists, shared_dir, written

#: Bytes that Phi may take in the driver and in each task.
MODEL_BYTES = 64 << 20
#: Rows of n_wt in a block.
BLOCK_ROWS = 4096
#: Partial sums of a block that one group adds up.
FAN = 64
#: Documents that the kernel takes at once.
BATCH_DOCS = 64


@dataclass
class Matrices:
    """tokens with their classes by row, topics by column."""

    classes: np.ndarray
    tokens: np.ndarray
    topics: list[str]
    pwt: np.ndarray
    nwt: np.ndarray

    @property
    def row_of(self) -> dict[tuple[str, str], int]:
        return {k: i for i, k in enumerate(zip(self.classes.tolist(), self.tokens.tolist()))}


def normalized(classes: np.ndarray, n: np.ndarray, r: np.ndarray | None = None) -> np.ndarray:
    """max(n + r, 0) over its sums within classes; zeros where a sum isn't positive."""
    x = np.maximum(n if r is None else n + r, 0.0)
    out = np.zeros_like(x)
    for c in np.unique(classes):
        rows = classes == c
        s = x[rows].sum(axis=0)
        out[rows] = np.divide(x[rows], s, out=np.zeros_like(x[rows]), where=s > 0)
    out[out < TINY] = 0.0
    return out


def random_matrix(classes: np.ndarray, tokens: np.ndarray, topics: int, seed: int = -1, tf: np.ndarray | None = None, dense_rate: float = 1.0, zero_rate: float = 0.0) -> np.ndarray:
    """Reproducible random rows, normalized by class. With tf, tokens beyond the dense_rate most frequent get zeros at zero_rate."""
    dense = np.ones(len(tokens), bool)
    if tf is not None and dense_rate < 1 and zero_rate > 0:
        order = np.lexsort((tokens, -tf))
        dense[order[int(dense_rate * len(tokens)) :]] = False
    rows = random_rows(classes, tokens, topics, seed)
    for i in np.flatnonzero(~dense):
        rows[i] = random_row(classes[i], tokens[i], topics, seed, zero_rate)
    return normalized(classes, rows)


def encode(ndw: DataFrame, vocab: DataFrame, class_weights: dict[str, float] | None = None, type_weights: dict[str, float] | None = None) -> DataFrame:
    """(item_id, title, idx, weight, tx, tx_weight, typed, scale), a row for each item, written once: ndw joined with vocab(token_idx, class_id,
    token), tokens in order of pos (or of their indices), unknown ones -1. ndw may have title, pos, tx_id and tt_name, and batch_weight, the
    weight of the item's source: items of one id but different weights are different items."""
    have = set(ndw.columns)
    own = weighted(ndw, class_weights)
    own = own.withColumn("title", F.coalesce("title", F.col("item_id").cast("string")) if "title" in have else F.col("item_id").cast("string"))
    own = own.withColumn("tt_name", F.col("tt_name") if "tt_name" in have else F.lit(DEFAULT_TRANSACTION))
    own = own.withColumn("tx_weight", F.lit(1.0)) if not type_weights else own.withColumn("tx_weight", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in type_weights.items() for x in kv]), F.col("tt_name")), F.lit(0.0)))
    joined = own.join(vocab.select("class_id", "token", "token_idx"), ["class_id", "token"], "left").withColumn("idx", F.coalesce("token_idx", F.lit(-1)).cast("int"))
    pos = F.col("pos") if "pos" in have else F.col("idx")
    tx = F.col("tx_id") if "tx_id" in have else F.lit(0)
    x = F.struct(pos.cast("int").alias("pos"), "idx", F.col("weight").cast("double").alias("w"), tx.cast("int").alias("tx"), "tx_weight")
    joined = joined.withColumn("scale", F.col("batch_weight").cast("double") if "batch_weight" in have else F.lit(1.0))
    docs = joined.groupBy("item_id", "title", "scale").agg(F.array_sort(F.collect_list(x)).alias("x"), F.max((F.col("tt_name") != DEFAULT_TRANSACTION)).alias("typed"))
    spark = ndw.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return written(docs.repartition(parts, "item_id").select("item_id", "title", F.col("x.idx").alias("idx"), F.col("x.w").alias("weight"), F.col("x.tx").alias("tx"), F.col("x.tx_weight").alias("tx_weight"), "typed", "scale"))


@dataclass
class Pass:
    """What a pass over documents does."""

    passes: int = 10
    agents: list = field(default_factory=list)
    editors: list = field(default_factory=list)
    unigram: np.ndarray | None = None
    sequences: bool = False
    want: str = "nwt"
    #: Rows that Phi lacks as yet: they play no part in Theta, and count with Phi = 1.
    fresh: np.ndarray | None = None
    cumulative: dict[str, CumulativeScore] = field(default_factory=dict)


def _batches(batches: Iterator[pa.RecordBatch], topics: int, previous: bool):
    """Kernel batches of Arrow batches, with Theta's start."""
    for big in batches:
        for at in range(0, big.num_rows, BATCH_DOCS):
            b = big.slice(at, BATCH_DOCS)
            lists = b["idx"]
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = lambda name, kind: np.asarray(b[name].flatten().to_numpy(zero_copy_only=False), kind)
            titles = b["title"].to_pylist()
            scale = b["scale"].to_numpy()
            typed = bool(np.any(b["typed"].to_numpy(zero_copy_only=False)))
            batch = Batch(flat("idx", np.int64), flat("weight", float), np.append(0, np.cumsum(sizes)), titles, scale, flat("tx", np.int64), flat("tx_weight", float))
            theta = np.full((len(titles), topics), 1.0 / topics)
            if previous:
                for i, t in enumerate(b["theta"].to_pylist()):
                    if t is not None:
                        theta[i] = t
            yield b["item_id"], batch, theta, typed


def _run(batch: Batch, phi: np.ndarray, theta: np.ndarray, typed: bool, plan: Pass):
    p = None
    if typed:
        counters, p = transactions(batch, phi, theta, plan.passes, plan.agents)
    elif plan.sequences or plan.editors:
        counters, p = occurrences(batch, phi, theta, plan.passes, plan.agents, plan.editors)
    else:
        counters = plain(batch, phi, theta, plan.passes, plan.agents, plan.fresh)
    return counters, p


def e_step(docs: DataFrame, phi: np.ndarray, plan: Pass) -> tuple[np.ndarray, dict[str, float]]:
    """n_wt and the sums of all documents. As many tasks as two for each core at most, so that the partial sums don't grow with the corpus;
    they are added up in a tree of FAN each."""
    rows, topics = phi.shape
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.coalesce(tasks)
    sent = docs.sparkSession.sparkContext.broadcast(phi)
    previous = "theta" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums, states = None, {}, {k: c.start() for k, c in plan.cumulative.items()}
        for ids, batch, theta, typed in _batches(batches, topics, previous):
            counters, p = _run(batch, sent.value, theta, typed, plan)
            own = np.zeros((rows, topics)) if own is None else own
            own[counters.rows] += counters.nwt
            if plan.fresh is not None:
                batch.idx = np.where((batch.idx >= 0) & plan.fresh[batch.idx], -1, batch.idx)
            got = transaction_sums(batch, p, counters.theta) if typed else likelihood_sums(batch, sent.value, counters.theta, plan.unigram)
            for k, c in plan.cumulative.items():
                states[k] = c.append(states[k], ids.to_pylist(), batch, sent.value, counters.theta)
            for k, v in got.items():
                sums[k] = sums.get(k, 0.0) + v
        if own is not None:
            slot = TaskContext.get().partitionId()
            blocks = [(slot, -1, b"", json.dumps({"sums": sums, "states": states}))]
            for i in range(0, rows, BLOCK_ROWS):
                part = own[i : i + BLOCK_ROWS]
                at = np.flatnonzero(part.any(axis=1))  # of rare tokens most partitions have none
                if len(at):
                    blocks.append((slot, i // BLOCK_ROWS, at.astype(np.int32).tobytes() + part[at].tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks), (pa.int32(), pa.int32(), pa.binary(), pa.string()))], names=["slot", "block", "data", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slot")
        slot, block = int(pdf["slot"].iloc[0]) // FAN, int(pdf["block"].iloc[0])
        if block < 0:
            sums, states = {}, {k: c.start() for k, c in plan.cumulative.items()}
            for x in map(json.loads, pdf["sums"]):
                for k, v in x["sums"].items():
                    sums[k] = sums.get(k, 0.0) + v
                for k, c in plan.cumulative.items():
                    states[k] = c.merge(states[k], x["states"][k])
            return pd.DataFrame({"slot": [slot], "block": [-1], "data": [b""], "sums": [json.dumps({"sums": sums, "states": states})]})
        data = np.zeros((min(BLOCK_ROWS, rows - block * BLOCK_ROWS), topics))
        for x in pdf["data"]:
            n = len(x) // (4 + 8 * topics)
            data[np.frombuffer(x, np.int32, n)] += np.frombuffer(x, np.uint8, offset=4 * n).view(np.float64).reshape(n, topics)
        at = np.flatnonzero(data.any(axis=1))
        return pd.DataFrame({"slot": [slot], "block": [block], "data": [at.astype(np.int32).tobytes() + data[at].tobytes()], "sums": [None]})

    schema = "slot int, block int, data binary, sums string"
    parts = docs.mapInArrow(run, schema)
    while True:
        parts = parts.groupBy("block", F.expr(f"slot div {FAN}")).applyInPandas(add, schema)
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    parts = parts.collect()
    sent.unpersist()
    nwt, sums = np.zeros((rows, topics)), {}
    for r in parts:
        if r["block"] < 0:
            got = json.loads(r["sums"])
            sums = got["sums"] | {"states": got["states"]}
        else:
            n = len(r["data"]) // (4 + 8 * topics)
            nwt[r["block"] * BLOCK_ROWS + np.frombuffer(r["data"], np.int32, n)] = np.frombuffer(r["data"], np.uint8, offset=4 * n).view(np.float64).reshape(n, topics)
    return nwt, sums


def infer(docs: DataFrame, phi: np.ndarray, plan: Pass) -> DataFrame:
    """want theta: (item_id, title, theta); ptdw: (item_id, title, pos, idx, p) by occurrence; ptx: (item_id, title, pos, p)
    by transaction. No shuffle."""
    topics = phi.shape[1]
    sent = docs.sparkSession.sparkContext.broadcast(phi)
    previous = "theta" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, batch, theta, typed in _batches(batches, topics, previous):
            counters, p = _run(batch, sent.value, theta, typed, plan)
            if plan.want == "theta":
                yield pa.RecordBatch.from_arrays([ids, pa.array(batch.titles), pa.array(list(counters.theta), pa.list_(pa.float64()))], names=["item_id", "title", "theta"])
                continue
            doc = batch.doc_of
            if plan.want == "ptx":
                new = np.ones(len(doc), bool)
                new[1:] = (batch.tx[1:] != batch.tx[:-1]) | (doc[1:] != doc[:-1])
                own = doc[new]
                pos = np.arange(len(own)) - np.searchsorted(own, own)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array([batch.titles[d] for d in own]), pa.array(pos.astype(np.int32)), pa.array(p)], names=["item_id", "title", "pos", "p"])
            else:
                pos = np.arange(len(doc)) - batch.start[doc]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array([batch.titles[d] for d in doc]), pa.array(pos.astype(np.int32)), pa.array(batch.idx.astype(np.int32)), pa.array(list(p), pa.list_(pa.float64()))], names=["item_id", "title", "pos", "idx", "p"])

    out = {"theta": "item_id long, title string, theta array<double>", "ptx": "item_id long, title string, pos int, p double", "ptdw": "item_id long, title string, pos int, idx int, p array<double>"}
    return docs.mapInArrow(run, out[plan.want])


class TopicModel:
    """An additively regularized topic model.

    ndw: (item_id, class_id, token, weight[, title, pos, tx_id, tt_name]). dictionary: (class_id, token, value, tf, df); its tokens are
    the model's. regularizers: by name, of Phi, Theta or occurrences. After each pass `history` gets a row of
    scores: perplexity, sparsity_phi, sparsity_theta, items and token weights, and those of `scores` (functions of Matrices).
    """

    def __init__(
        self, topics: int | list[str], dictionary: DataFrame, class_weights: dict[str, float] | None = None, type_weights: dict[str, float] | None = None, document_passes: int = 10, seed: int = -1,
        regularizers: dict[str, object] | None = None, scores: dict[str, Callable[[Matrices], object]] | None = None, reuse_theta: bool = False, collection_unigram: bool = False,
        dense_rate: float = 1.0, zero_rate: float = 0.0,
    ):
        self.topics = [f"topic_{i}" for i in range(topics)] if isinstance(topics, int) else list(topics)
        self.class_weights, self.type_weights, self.document_passes, self.seed = class_weights, type_weights, document_passes, seed
        self.regularizers, self.scores = dict(regularizers or {}), dict(scores or {})
        self.reuse_theta, self.collection_unigram = reuse_theta, collection_unigram
        self.history: list[dict] = []
        self.updates = self.online_updates = 0
        self._theta: DataFrame | None = None
        self._parents: list[tuple[list, np.ndarray, float]] = []
        self._fresh: np.ndarray | None = None
        self.initialize(dictionary, dense_rate, zero_rate)

    # -- vocabulary and matrices

    def initialize(self, dictionary: DataFrame, dense_rate: float = 1.0, zero_rate: float = 0.0) -> None:
        """Phi and n_wt from the dictionary's tokens (of the model's classes)."""
        own = dictionary if not self.class_weights else dictionary.where(F.col("class_id").isin(list(self.class_weights)))
        self.vocab = written(token_numbers(own.select("class_id", "token", "value", "tf")))
        n = self.vocab.count()
        if n * len(self.topics) * 8 > MODEL_BYTES:
            raise ValueError(f"Phi of {n} tokens and {len(self.topics)} topics exceeds MODEL_BYTES; topic_model() makes a PartitionedModel of that size")
        got = self.vocab.orderBy("token_idx").toPandas()
        classes, tokens = got["class_id"].to_numpy(object), got["token"].to_numpy(object)
        self.value = got["value"].to_numpy(float)
        start = random_matrix(classes, tokens, len(self.topics), self.seed, got["tf"].to_numpy(float), dense_rate, zero_rate)
        self.m = Matrices(classes, tokens, self.topics, start, start.copy())

    def encode(self, ndw: DataFrame) -> DataFrame:
        """The corpus as the model's passes read it; give it to several calls to encode once."""
        return ndw if "idx" in ndw.columns else encode(ndw, self.vocab, self.class_weights, self.type_weights)

    def _plan(self, **options) -> Pass:
        agents = [r for r in self.regularizers.values() if isinstance(r, ThetaRegularizer) and not isinstance(r, HierarchySparsingTheta)]
        editors = [r for r in self.regularizers.values() if isinstance(r, PtdwRegularizer)]
        cumulative = {k: s.prepared(self.m) for k, s in self.scores.items() if isinstance(s, CumulativeScore)}
        return Pass(self.document_passes, agents, editors, self.value if self.collection_unigram else None, fresh=self._fresh, cumulative=cumulative, **options)

    def _started(self, docs: DataFrame) -> DataFrame:
        if not self.reuse_theta or self._theta is None:
            return docs
        return docs.join(self._theta.select("title", "theta"), "title", "left")

    def _pass(self, docs: DataFrame) -> tuple[np.ndarray, dict[str, float]]:
        for r in self.regularizers.values():
            if isinstance(r, TopicSelectionTheta) and (r.topic_value is None or self.updates):
                r.refresh(self.m.nwt)
        docs = self._started(docs)
        nwt, sums = e_step(docs, self.m.pwt, self._plan())
        for agents, rows, weight in self._parents:
            nwt += weight * self._parent_counters(agents, rows)
        if not sums.get("items") and not nwt.any():
            raise ValueError("no items to process")
        if sums.get("items") and not sums["token_weight_in_effect"]:
            raise ValueError("no token of the items is in the model")
        if self.reuse_theta:
            self._theta = written(infer(docs, self.m.pwt, self._plan(want="theta")))
        return nwt, sums

    def _update(self, nwt: np.ndarray, sums: dict[str, float]) -> None:
        self.m.nwt, self._fresh = nwt, None
        regs = [r for r in self.regularizers.values() if isinstance(r, PhiRegularizer)]
        self.m.pwt = normalized(self.m.classes, nwt, total(regs, self.m) if regs else None)
        self.updates += 1
        row = {"pass": self.updates, "sparsity_phi": {c: float((np.abs(self.m.pwt[self.m.classes == c]) < EPS).mean()) for c in np.unique(self.m.classes)}}
        if sums.get("normalizer"):
            row |= {"perplexity": float(np.exp(-sums["raw"] / sums["normalizer"])), "sparsity_theta": sums["zero_topics"] / max(1.0, sums["total_topics"]), "zero_words": int(sums["zero_words"]),
                    "items": int(sums["items"]), "token_weight": sums["token_weight"], "token_weight_in_effect": sums["token_weight_in_effect"]}
        states = sums.get("states", {})
        row |= {name: f.value(states[name]) for name, f in self.scores.items() if isinstance(f, CumulativeScore) and name in states}
        self.history.append(row | {name: f(self.m) for name, f in self.scores.items() if not isinstance(f, CumulativeScore)})

    # -- fitting

    def fit_offline(self, ndw: DataFrame, passes: int = 1) -> TopicModel:
        if passes < 1:
            raise ValueError("passes must be positive")
        docs = self.encode(ndw)
        for _ in range(passes):
            self._update(*self._pass(docs))
        return self

    def fit_online(self, chunks: list[DataFrame], tau0: float = 1024.0, kappa: float = 0.7, apply: list[float] | None = None, decay: list[float] | None = None, asynchronous: bool = False) -> TopicModel:
        """An update after each chunk: n = decay * n + apply * n_hat; by default apply = rho = (tau0 + i) ** -kappa for the model's i-th online update,
        from 1, and decay = 1 - rho. asynchronous: chunk i+1 is processed under the Phi from before update i."""
        docs = [self.encode(c) for c in chunks]
        waiting: list[tuple[np.ndarray, dict]] = []

        def merge(i: int, got: tuple[np.ndarray, dict]) -> None:
            self.online_updates += 1
            rho = (tau0 + self.online_updates) ** -kappa
            a, d = apply[i] if apply else rho, decay[i] if decay else 1 - rho
            self._update(d * self.m.nwt + a * got[0], got[1])

        for i, c in enumerate(docs):
            waiting.append(self._pass(c))
            if not asynchronous or len(waiting) == 2:
                merge(i if not asynchronous else i - 1, waiting.pop(0))
        for got in waiting:
            merge(len(docs) - 1, got)
        return self

    def process(self, ndw: DataFrame, reset_nwt: bool = True) -> dict[str, float]:
        """The E-step alone: n_wt anew, or added to what there is; Phi stays. Gives the sums of the documents."""
        nwt, sums = self._pass(self.encode(ndw))
        self.m.nwt = nwt if reset_nwt else self.m.nwt + nwt
        return sums

    def normalize(self) -> None:
        """The M-step alone: Phi from n_wt, with the regularizers."""
        self._update(self.m.nwt, {})

    def transform(self, ndw: DataFrame, want: str = "theta") -> DataFrame:
        """Theta of documents; want ptdw or ptx: shares of each occurrence, p(x|d) of each transaction."""
        return infer(self._started(self.encode(ndw)), self.m.pwt, self._plan(want=want, sequences=want == "ptdw"))

    def predict(self, ndw: DataFrame, class_id: str) -> DataFrame:
        """(item_id, class_token, p): p(c|d) of a modality's tokens."""
        rows = np.flatnonzero(self.m.classes == class_id)
        names, phi = self.m.tokens[rows].tolist(), self.m.pwt[rows]
        theta = self.transform(ndw)
        each = [F.struct(F.lit(n).alias("class_token"), F.aggregate(F.zip_with("theta", F.array(*[F.lit(float(x)) for x in p]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("p")) for n, p in zip(names, phi)]
        return theta.select("item_id", F.inline(F.array(*each)))

    # -- hierarchy

    def set_parent(self, parent: TopicModel, weight: float = 1.0) -> None:
        """The parent's topics become documents of n_wt, with this weight."""
        at = self.m.row_of
        rows = np.zeros((len(parent.topics), len(self.m.tokens)))
        for i, k in enumerate(zip(parent.m.classes.tolist(), parent.m.tokens.tolist())):
            if k in at:
                rows[:, at[k]] = parent.m.nwt[i]
        self._parents = [(parent.topics, rows, weight)]

    def _parent_batch(self, names: list[str], rows: np.ndarray) -> Batch:
        doc, idx = np.nonzero(rows)
        return Batch(idx, rows[doc, idx], np.searchsorted(doc, np.arange(len(names) + 1)), names, np.ones(len(names)))

    def _parent_run(self, names: list[str], rows: np.ndarray):
        agents = [*self._plan().agents, *[r for r in self.regularizers.values() if isinstance(r, HierarchySparsingTheta)]]
        batch = self._parent_batch(names, rows)
        return plain(batch, self.m.pwt, np.full((len(names), len(self.topics)), 1.0 / len(self.topics)), self.document_passes, agents)

    def _parent_counters(self, names: list[str], rows: np.ndarray) -> np.ndarray:
        got = self._parent_run(names, rows)
        out = np.zeros_like(self.m.nwt)
        out[got.rows] = got.nwt
        return out

    def psi(self) -> pd.DataFrame:
        """p(topic | parent topic)."""
        names, rows, _ = self._parents[0]
        return pd.DataFrame(self._parent_run(names, rows).theta.T, index=self.topics, columns=names)

    # -- matrices in and out

    def matrix(self, spark: SparkSession, name: str = "pwt", eps: float | None = None) -> DataFrame:
        """A matrix as (class_id, token, topic, value); with eps only values above it."""
        x = getattr(self.m, name)
        wide = pa.table({"class_id": pa.array(self.m.classes, pa.string()), "token": pa.array(self.m.tokens, pa.string()), "v": pa.array(list(x), pa.list_(pa.float64()))})
        names = F.array(*[F.lit(t) for t in self.topics])
        long = spark.createDataFrame(wide).select("class_id", "token", F.explode(F.arrays_zip(names.alias("topic"), F.col("v").alias("value"))).alias("x"))
        long = long.select("class_id", "token", F.col("x.topic").alias("topic"), F.col("x.value").alias("value"))
        return long if eps is None else matrix.sparse(long, eps)

    def phi(self) -> pd.DataFrame:
        return pd.DataFrame(self.m.pwt, index=pd.MultiIndex.from_arrays([self.m.classes, self.m.tokens], names=["class_id", "token"]), columns=self.topics)

    def overwrite(self, name: str, values: pd.DataFrame) -> None:
        """Sets pwt or nwt from a frame like phi()'s; tokens and topics it lacks become zero."""
        own = values.reindex(index=self.phi().index, columns=self.topics).fillna(0.0)
        setattr(self.m, name, own.to_numpy(float))

    def reshape_topics(self, topics: list[str]) -> None:
        """Adds topics (zeros), drops and reorders them by name."""
        at = {t: i for i, t in enumerate(self.topics)}
        take = lambda x: np.stack([x[:, at[t]] if t in at else np.zeros(len(x)) for t in topics], axis=1)
        self.m = Matrices(self.m.classes, self.m.tokens, list(topics), take(self.m.pwt), take(self.m.nwt))
        self.topics = list(topics)

    def rename_topics(self, topics: list[str]) -> None:
        if len(topics) != len(self.topics):
            raise ValueError("as many names as topics, please")
        self.topics = self.m.topics = list(topics)

    def reshape_tokens(self, dictionary: DataFrame) -> None:
        """Tokens of a new dictionary: those known keep their counts and Phi; n_wt of new ones starts at random, and Phi gets them with the next
        update, up to which they play no part in Theta and count as if Phi were 1."""
        before, at = self.m, self.m.row_of
        self.initialize(dictionary)
        self._fresh = np.ones(len(self.m.tokens), bool)
        self.m.pwt[:] = 0.0
        for i, k in enumerate(zip(self.m.classes.tolist(), self.m.tokens.tolist())):
            if k in at:
                self.m.pwt[i], self.m.nwt[i] = before.pwt[at[k]], before.nwt[at[k]]
                self._fresh[i] = False

    def clone(self) -> TopicModel:
        out = copy.copy(self)
        out.m = Matrices(self.m.classes, self.m.tokens, list(self.topics), self.m.pwt.copy(), self.m.nwt.copy())
        out.history, out.regularizers, out.scores = list(self.history), dict(self.regularizers), dict(self.scores)
        return out

    def get_phi(self, topics: list[str] | None = None, classes: list[str] | None = None, name: str = "pwt") -> pd.DataFrame:
        """A matrix by (class_id, token); unknown topics are errors."""
        unknown = set(topics or []) - set(self.topics)
        if unknown:
            raise ValueError(f"unknown topics {sorted(unknown)}")
        rows = np.ones(len(self.m.tokens), bool) if classes is None else np.isin(self.m.classes, classes)
        own = pd.DataFrame(getattr(self.m, name), index=self.phi().index, columns=self.topics)[rows]
        return own if topics is None else own[topics]

    def get_phi_sparse(self, spark: SparkSession, eps: float = EPS) -> DataFrame:
        out = self.matrix(spark, "pwt", eps)
        if out.isEmpty():
            raise ValueError("no value above eps")
        return out

    def get_theta(self, ndw: DataFrame | None = None, eps: float | None = None) -> DataFrame:
        """(item_id, title, topic, value): of the last pass with reuse_theta, or of ndw; with eps values of at least it."""
        theta = self._theta if ndw is None else self.transform(ndw)
        if theta is None:
            raise ValueError("no Theta is kept; set reuse_theta or give documents")
        names = F.array(*[F.lit(t) for t in self.topics])
        long = theta.select("item_id", "title", F.explode(F.arrays_zip(names.alias("topic"), F.col("theta").alias("value"))).alias("x")).select("item_id", "title", "x.topic", "x.value")
        return long if eps is None else long.where(F.col("value") >= eps)

    def get_score(self, name: str):
        """A score of the last pass, or of the model now if it needs no documents."""
        own = self.scores.get(name)
        return self.history[-1][name] if own is None or isinstance(own, CumulativeScore) else own(self.m)

    @property
    def score_tracker(self) -> dict[str, list]:
        """By score, its values of all passes that have it."""
        return {k: [h[k] for h in self.history if k in h] for k in sorted({k for h in self.history for k in h})}

    def theta_matrix(self) -> DataFrame:
        """The kept Theta as a matrix (class_id, token, topic, value) with titles as tokens of DOCUMENTS_CLASS."""
        return self.get_theta().select(F.lit(DOCUMENTS_CLASS).alias("class_id"), F.col("title").alias("token"), "topic", "value")

    def export_score_tracker(self, spark: SparkSession, path: str) -> None:
        """(pass, score, value) of all passes as Parquet, values as JSON; refuses to overwrite."""
        rows = [(h["pass"], k, json.dumps(v, default=str)) for h in self.history for k, v in h.items() if k != "pass"]
        spark.createDataFrame(rows, "pass int, score string, value string").coalesce(1).write.parquet(path)

    def import_score_tracker(self, spark: SparkSession, path: str) -> None:
        """The history that export_score_tracker() wrote."""
        by: dict[int, dict] = {}
        for r in spark.read.parquet(path).collect():
            by.setdefault(r["pass"], {"pass": r["pass"]})[r["score"]] = json.loads(r["value"])
        self.history = [by[k] for k in sorted(by)]

    def remove_theta(self) -> None:
        self._theta = None

    def attach(self, name: str = "nwt") -> np.ndarray:
        """The matrix itself, not a copy: what is changed in it is changed in the model."""
        return getattr(self.m, name)

    def dispose(self) -> None:
        """Drops matrices, Theta, scores and regularizers, and deletes the vocabulary's table; the model can't be used any more."""
        drop(self.vocab)
        self.m, self._theta, self._parents, self._fresh = Matrices(np.zeros(0, object), np.zeros(0, object), self.topics, np.zeros((0, len(self.topics))), np.zeros((0, len(self.topics)))), None, [], None
        self.regularizers, self.scores, self.history = {}, {}, []

    def clear_scores(self) -> None:
        """Forgets the scores of past passes."""
        self.history = []

    def info(self) -> dict:
        return {"topics": self.topics, "tokens": len(self.m.tokens), "classes": sorted(set(self.m.classes)), "regularizers": sorted(self.regularizers), "scores": sorted(self.scores), "updates": self.updates, "seed": self.seed}

    def save(self, spark: SparkSession, path: str) -> None:
        """Both matrices, the dictionary and a kept Theta as Parquet; settings, regularizers, scores, parents and history as JSON; refuses to
        overwrite. Scores that are functions of the user's own can't be saved and are left out."""
        from .config import encoded

        head = {
            "kind": type(self).__name__, "topics": self.topics, "class_weights": self.class_weights, "type_weights": self.type_weights, "document_passes": self.document_passes, "seed": self.seed, "updates": self.updates,
            "online_updates": self.online_updates, "history": self.history, "reuse_theta": self.reuse_theta, "collection_unigram": self.collection_unigram, "regularizers": encoded(self.regularizers), "scores": encoded(self.scores),
            "parents": [[names, rows.tolist(), weight] for names, rows, weight in self._parents], "fresh": None if self._fresh is None else self._fresh.tolist(), "extra": {k: getattr(self, k) for k in ("alpha", "beta") if hasattr(self, k)}, "version": 2,
        }
        rows, text = pa.list_(pa.float64()), pa.string()
        wide = pa.table({
            "token_idx": np.arange(len(self.m.tokens)), "class_id": pa.array(self.m.classes, text), "token": pa.array(self.m.tokens, text), "value": self.value,
            "pwt": pa.array(list(self.m.pwt), rows), "nwt": pa.array(list(self.m.nwt), rows),
        })
        spark.createDataFrame(wide).write.parquet(f"{path}/matrices")
        spark.createDataFrame([(json.dumps(head, default=str),)], "value string").coalesce(1).write.text(f"{path}/settings")
        if self._theta is not None:
            self._theta.write.parquet(f"{path}/theta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicModel:
        head = json.loads(spark.read.text(f"{path}/settings").first()["value"])
        if head["version"] > 2:
            raise ValueError("written by a newer version")
        from . import config, lda

        out = (lda.Lda if head.get("kind") == "Lda" else cls).__new__(lda.Lda if head.get("kind") == "Lda" else cls)
        out.topics, out.history, out.updates, out.online_updates = head["topics"], head["history"], head["updates"], head.get("online_updates", 0)
        out.class_weights, out.type_weights, out.document_passes, out.seed = head["class_weights"], head["type_weights"], head["document_passes"], head["seed"]
        out.regularizers, out.scores = config.decoded(head.get("regularizers", {})), config.decoded(head.get("scores", {}))
        out.reuse_theta, out.collection_unigram = head.get("reuse_theta", False), head.get("collection_unigram", False)
        out._theta = spark.read.parquet(f"{path}/theta") if exists(spark, f"{path}/theta") else None
        out._parents = [(names, np.array(rows), weight) for names, rows, weight in head.get("parents", [])]
        out._fresh = None if head.get("fresh") is None else np.array(head["fresh"], bool)
        for k, v in head.get("extra", {}).items():
            setattr(out, k, v)
        saved = spark.read.parquet(f"{path}/matrices")
        got = saved.orderBy("token_idx").toPandas()
        out.vocab, out.value = saved.select("token_idx", "class_id", "token", "value"), got["value"].to_numpy(float)
        stack = lambda c: np.array(got[c].tolist()).reshape(len(got), len(out.topics))
        out.m = Matrices(got["class_id"].to_numpy(object), got["token"].to_numpy(object), list(out.topics), stack("pwt"), stack("nwt"))
        return out


def topic_model(topics: int | list[str], dictionary: DataFrame, class_weights: dict[str, float] | None = None, **options):
    """A TopicModel if its Phi is within MODEL_BYTES, else a PartitionedModel: both give the same."""
    from .partitioned import PartitionedModel

    own = dictionary if not class_weights else dictionary.where(F.col("class_id").isin(list(class_weights)))
    size = own.count() * (topics if isinstance(topics, int) else len(topics)) * 8
    return (TopicModel if size <= MODEL_BYTES else PartitionedModel)(topics, dictionary, class_weights, **options)


def fit_relational(ndw: DataFrame, nwt: DataFrame, items: DataFrame, topics: list, passes: int, document_passes: int = 10, regularize: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(n_wt, Phi) after passes on long tables only, for models that no task can hold. regularize(p, n) gives r_wt. Every pass is a written
    table; the one before is deleted."""
    spark = ndw.sparkSession
    phi, old = written(matrix.normalize(nwt)), []
    for _ in range(passes):
        theta = estep.uniform_theta(items, topics)
        for _ in range(document_passes):
            theta = _kept(estep.theta_pass(ndw, phi, theta), old)
        n = _kept(estep.counters(ndw, phi, theta), old)
        phi = written(matrix.normalize(n, regularize(phi, n) if regularize else None))
        for path in old[:-1]:
            drop_path(spark, path)
        old = old[-1:]
    return n, phi


def _kept(df: DataFrame, paths: list[str]) -> DataFrame:
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    paths.append(path)
    return df.sparkSession.read.parquet(path)


