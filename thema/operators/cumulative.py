"""Scores that are added up over the documents of a pass, under the Phi it began with and the Theta it found: aggregates with a start, an
append for each batch of documents, and a merge, run in the tasks of the pass. States are of JSON (numbers, lists, dicts with text keys).

TopicModel(scores=...) takes them beside functions of the matrices; one's own are subclasses of CumulativeScore.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np

from ..schema import DEFAULT_CLASS, EPS, TINY
from .kernel import Batch, segment_sums

if TYPE_CHECKING:
    from ..plans.model import Matrices


class CumulativeScore:
    """Sums of numbers by name, unless merge() is replaced."""

    def prepared(self, m: Matrices) -> CumulativeScore:
        """What travels to the tasks: the score with what it needs of the model."""
        return self

    def start(self) -> dict:
        return {}

    def append(self, state: dict, ids: list, batch: Batch, phi: np.ndarray, theta: np.ndarray) -> dict:
        """state with a batch of documents. phi: rows by batch.idx (-1 is unknown); theta: a row for each document."""
        raise NotImplementedError

    def merge(self, a: dict, b: dict) -> dict:
        return {k: a.get(k, 0) + b.get(k, 0) for k in a.keys() | b.keys()}

    def value(self, state: dict):
        return state


@dataclass
class Perplexity(CumulativeScore):
    """exp(-sum n ln p / sum n) over the tokens of classes (all by default; unknown tokens count where all do). A tiny p is replaced by the
    token's share of what its document has of these classes, or by the dictionary's value of unigram, (class, token) -> value."""

    classes: list[str] | None = None
    unigram: dict[tuple[str, str], float] | None = None

    def prepared(self, m: Matrices) -> Perplexity:
        out = copy.copy(self)
        out.rows = None if not self.classes else np.isin(m.classes, self.classes)
        out.values = None if self.unigram is None else np.array([self.unigram.get(k, 0.0) for k in zip(m.classes, m.tokens)])
        out.unigram = None
        return out

    def append(self, state: dict, ids: list, batch: Batch, phi: np.ndarray, theta: np.ndarray) -> dict:
        known, doc = batch.idx >= 0, batch.doc_of
        own = np.maximum(batch.idx, 0)
        use = np.ones(len(own), bool) if self.rows is None else known & self.rows[own]
        p = theta[doc].sum(axis=1)
        p[known] = np.einsum("ij,ij->i", phi[own[known]], theta[doc[known]])
        weight = np.where(use, batch.weight, 0.0)
        n_d = segment_sums(weight, batch.start)[doc]
        other = np.divide(weight, n_d, out=np.ones_like(n_d), where=n_d > 0)
        if self.values is not None:
            u = np.where(known, self.values[own], 0.0)
            other = np.where(u > 0, u, other)
        zero, counts = np.abs(p) < TINY, weight > 0
        raw = float((weight * np.log(np.where(zero, np.maximum(other, 1e-300), np.maximum(p, 1e-300))))[counts].sum())
        return self.merge(state, {"raw": raw, "normalizer": float(weight.sum()), "zero_words": int((zero & counts).sum())})

    def value(self, state: dict) -> dict:
        n = state.get("normalizer", 0.0)
        return state | {"value": float(np.exp(-state["raw"] / n)) if n else 0.0}


@dataclass
class SparsityTheta(CumulativeScore):
    topics: list[str] | None = None
    eps: float = EPS

    def prepared(self, m: Matrices) -> SparsityTheta:
        out = copy.copy(self)
        out.columns = np.arange(len(m.topics)) if not self.topics else np.flatnonzero(np.isin(m.topics, self.topics))
        return out

    def append(self, state: dict, ids: list, batch: Batch, phi: np.ndarray, theta: np.ndarray) -> dict:
        own = theta[:, self.columns]
        return self.merge(state, {"zero_topics": int((np.abs(own) < self.eps).sum()), "total_topics": own.size})

    def value(self, state: dict) -> dict:
        return state | {"value": state.get("zero_topics", 0) / max(1, state.get("total_topics", 0))}


@dataclass
class ClassPrecision(CumulativeScore):
    """How often a document's most probable token of the class (of equals the last) is among its own."""

    class_id: str = DEFAULT_CLASS

    def prepared(self, m: Matrices) -> ClassPrecision:
        out = copy.copy(self)
        out.rows = np.flatnonzero(m.classes == self.class_id)
        return out

    def append(self, state: dict, ids: list, batch: Batch, phi: np.ndarray, theta: np.ndarray) -> dict:
        if not len(self.rows):
            return state
        p = theta @ phi[self.rows].T
        best = self.rows[p.shape[1] - 1 - p[:, ::-1].argmax(axis=1)]
        hit = np.bincount(batch.doc_of, batch.idx == best[batch.doc_of], minlength=batch.docs) > 0
        return self.merge(state, {"error": int((~hit).sum()), "total": batch.docs})

    def value(self, state: dict) -> dict:
        return state | {"value": 1 - state.get("error", 0) / max(1, state.get("total", 0))}


@dataclass
class ThetaSnippet(CumulativeScore):
    """Theta of some documents: the largest item_id of each remainder modulo num_items, or those of item_ids."""

    num_items: int = 10
    item_ids: list[int] | None = None

    def append(self, state: dict, ids: list, batch: Batch, phi: np.ndarray, theta: np.ndarray) -> dict:
        own = {}
        for i, row in zip(ids, theta):
            if i is not None and (self.item_ids is None or i in self.item_ids):
                slot = str(i if self.item_ids is not None else i % self.num_items)
                if slot not in own or own[slot][0] < i:
                    own[slot] = [i, row.tolist()]
        return self.merge(state, own)

    def merge(self, a: dict, b: dict) -> dict:
        return {k: max((x[k] for x in (a, b) if k in x), key=lambda v: v[0]) for k in a.keys() | b.keys()}

    def value(self, state: dict) -> dict:
        return {i: row for i, row in sorted(state.values())}


@dataclass
class ItemsProcessed(CumulativeScore):
    def append(self, state: dict, ids: list, batch: Batch, phi: np.ndarray, theta: np.ndarray) -> dict:
        return self.merge(state, {"num_items": batch.docs, "token_weight": float(batch.weight.sum()), "token_weight_in_effect": float(batch.weight[batch.idx >= 0].sum())})
