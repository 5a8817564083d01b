"""Phi regularizers as NumPy terms over a model that the driver holds; operators.regularizers has the same as DataFrames.

Each has tau, gamma (for relative mode, or None), and term(model) giving R of Phi's shape, before tau.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np

from .theta_regularizers import transform

if TYPE_CHECKING:
    from ..plans.model import Matrices


@dataclass
class PhiRegularizer:
    tau: float = 1.0
    gamma: float | None = None
    topics: list[str] | None = None
    classes: list[str] | None = None

    def mask(self, m: Matrices) -> np.ndarray:
        """Where the term applies."""
        t = np.ones(len(m.topics), bool) if not self.topics else np.isin(m.topics, self.topics)
        c = np.ones(len(m.tokens), bool) if not self.classes else np.isin(m.classes, self.classes)
        return c[:, None] & t[None]

    def term(self, m: Matrices) -> np.ndarray:
        raise NotImplementedError


def _values(m: Matrices, dictionary: dict[tuple[str, str], float] | None, missing: float) -> np.ndarray:
    if dictionary is None:
        return np.ones(len(m.tokens))
    return np.array([dictionary.get(k, missing) for k in zip(m.classes, m.tokens)])


@dataclass
class SmoothSparsePhi(PhiRegularizer):
    dictionary: dict[tuple[str, str], float] | None = None
    kind: str = "constant"
    a: float = 1.0
    n: float = 1.0

    def term(self, m: Matrices) -> np.ndarray:
        return self.mask(m) * _values(m, self.dictionary, 0.0)[:, None] * transform(m.pwt, self.kind, self.a, self.n)


@dataclass
class DecorrelatorPhi(PhiRegularizer):
    topic_pairs: dict[str, dict[str, float]] | None = None

    def term(self, m: Matrices) -> np.ndarray:
        p = m.pwt
        if not self.topic_pairs:
            own = np.where(self.mask(m), p, 0.0)
            return -own * (own.sum(axis=1, keepdims=True) - own)
        r, at = np.zeros_like(p), {t: i for i, t in enumerate(m.topics)}
        rows = PhiRegularizer(classes=self.classes).mask(m)[:, :1]
        for first, seconds in self.topic_pairs.items():
            if first in at:
                s = sum((w * p[:, at[t]] for t, w in seconds.items() if t in at), np.zeros(len(p)))
                r[:, at[first]] = -p[:, at[first]] * (s - p[:, at[first]])
        return r * rows


@dataclass
class MultiLanguagePhi(PhiRegularizer):
    def term(self, m: Matrices) -> np.ndarray:
        return np.zeros_like(m.nwt)


@dataclass
class LabelRegularizationPhi(PhiRegularizer):
    dictionary: dict[tuple[str, str], float] | None = None

    def term(self, m: Matrices) -> np.ndarray:
        own = np.where(self.mask(m), m.nwt, 0.0)
        s = own.sum(axis=1, keepdims=True)
        return _values(m, self.dictionary, 0.0)[:, None] * np.divide(own, s, out=np.zeros_like(own), where=s > 0)


@dataclass
class SpecifiedSparsePhi(PhiRegularizer):
    mode: str = "sparse_topics"
    max_elements_count: int = 20
    probability_threshold: float = 0.99

    def term(self, m: Matrices) -> np.ndarray:
        mask, r = self.mask(m), np.zeros_like(m.nwt)
        rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
        own = m.nwt[np.ix_(rows, columns)]
        own = own if self.mode == "sparse_topics" else own.T
        order = np.lexsort((np.broadcast_to(-np.arange(len(own))[:, None], own.shape), -own), axis=0)
        ranked = np.take_along_axis(own, order, axis=0)
        before = np.cumsum(ranked, axis=0) - ranked
        k = np.arange(len(own))[:, None]
        keep = (k < self.max_elements_count) & ((k == 0) | (before < self.probability_threshold * own.sum(axis=0)))
        drop = np.zeros(own.shape, bool)
        np.put_along_axis(drop, order, ~keep, axis=0)
        out = np.where(drop, -own, 0.0)
        r[np.ix_(rows, columns)] = out if self.mode == "sparse_topics" else out.T
        return r


@dataclass
class _Cooc(PhiRegularizer):
    """cooc: (class_id, u, v) -> value."""

    cooc: dict[tuple[str, str, str], float] = field(default_factory=dict)

    def pairs(self, m: Matrices) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = m.row_of
        found = [(at[c, u], at[c, v], x) for (c, u, v), x in self.cooc.items() if (c, u) in at and (c, v) in at and (not self.classes or c in self.classes)]
        return tuple(np.array(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))  # type: ignore[return-value]


class ImproveCoherencePhi(_Cooc):
    def term(self, m: Matrices) -> np.ndarray:
        u, v, x = self.pairs(m)
        r = np.zeros_like(m.nwt)
        np.add.at(r, u, x[:, None] * m.nwt[v])
        return r * self.mask(m)


class BitermsPhi(_Cooc):
    def term(self, m: Matrices) -> np.ndarray:
        u, v, x = self.pairs(m)
        q = m.nwt.sum(axis=0) * m.pwt[u] * m.pwt[v] * self.mask(m)[u]
        s = q.sum(axis=1, keepdims=True)
        r = np.zeros_like(m.nwt)
        np.add.at(r, u, x[:, None] * np.divide(q, s, out=np.zeros_like(q), where=s > 0))
        return r


@dataclass
class SmoothTimeInTopicsPhi(PhiRegularizer):
    def term(self, m: Matrices) -> np.ndarray:
        own = np.flatnonzero(self.mask(m).any(axis=1))
        own = own[np.argsort(m.tokens[own], kind="stable")]
        r = np.zeros_like(m.pwt)
        if len(own) > 2:
            p = m.pwt[own]
            sgn = lambda x: np.where(x > 0, 1.0, -1.0)
            r[own[1:-1]] = p[1:-1] * (sgn(p[:-2] - p[1:-1]) + sgn(p[2:] - p[1:-1]))
        return r * self.mask(m)


@dataclass
class NetPlsaPhi(PhiRegularizer):
    """vertices: token -> D; edges: (u, v) -> weight."""

    class_id: str = ""
    vertices: dict[str, float] = field(default_factory=dict)
    edges: dict[tuple[str, str], float] = field(default_factory=dict)
    symmetric: bool = False

    def term(self, m: Matrices) -> np.ndarray:
        at, r = m.row_of, np.zeros_like(m.pwt)
        n_t = m.nwt[m.classes == self.class_id].sum(axis=0)
        weights: dict[tuple[str, str], float] = defaultdict(float)
        for (u, v), w in self.edges.items():
            weights[u, v] += w
            if self.symmetric:
                weights[v, u] += w
        for (u, v), w in weights.items():
            i, j = at.get((self.class_id, u)), at.get((self.class_id, v))
            if i is not None and j is not None:
                du, dv = self.vertices.get(u, 1.0), self.vertices.get(v, 1.0)
                r[i] += n_t**2 * w * (m.pwt[j] / dv - m.pwt[i] / du) / du
        return r * self.mask(m)


def total(regularizers: list[PhiRegularizer], m: Matrices) -> np.ndarray:
    """r_wt: the sum of tau * R. If any has gamma, those with gamma are scaled by class and topic."""
    out = np.zeros_like(m.nwt)
    for reg in regularizers:
        r = reg.term(m)
        if reg.gamma is not None:
            coef = np.zeros_like(r)
            used = np.flatnonzero(reg.mask(m).any(axis=0))
            for c in np.unique(m.classes):
                rows = m.classes == c
                n_t, r_t = m.nwt[rows][:, used].sum(axis=0), np.abs(r[rows][:, used]).sum(axis=0)
                if r_t.sum() > 0:
                    own = np.divide(n_t, r_t, out=np.zeros_like(n_t), where=r_t > 0)
                    coef[np.ix_(rows, used)] = reg.gamma * own + (1 - reg.gamma) * n_t.sum() / r_t.sum()
            r = r * coef
        out += reg.tau * r
    return out
