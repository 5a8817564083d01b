"""Scores of a model that the driver holds, for TopicModel(scores=...); operators.scores has them as DataFrames."""

from __future__ import annotations

import resource
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np

from ..schema import DEFAULT_CLASS, EPS

if TYPE_CHECKING:
    from ..plans.model import Matrices


def coherence(tokens: list[str], cooc: dict[tuple[str, str], float]) -> float:
    """2 / (k (k-1)) times the sum over ordered pairs."""
    k = len(tokens)
    return 0.0 if k < 2 else 2.0 / (k * (k - 1)) * sum(cooc.get((tokens[i], tokens[j]), 0.0) for i in range(k) for j in range(i + 1, k))


@dataclass
class TopTokens:
    num_tokens: int = 10
    class_id: str = DEFAULT_CLASS
    topics: list[str] | None = None
    eps: float = EPS
    cooc: dict[tuple[str, str], float] | None = None

    def __call__(self, m: Matrices) -> dict:
        rows = np.flatnonzero(m.classes == self.class_id)
        out: dict = {"tokens": {}, "weights": {}, "coherence": {}}
        for t, name in enumerate(m.topics):
            if self.topics and name not in self.topics:
                continue
            p = m.pwt[rows, t]
            order = np.lexsort((np.arange(len(rows)), p))[::-1][: self.num_tokens]
            order = order[p[order] >= self.eps]
            out["tokens"][name], out["weights"][name] = m.tokens[rows[order]].tolist(), p[order].tolist()
            if self.cooc is not None:
                out["coherence"][name] = coherence([x for x, w in zip(out["tokens"][name], out["weights"][name]) if w > 0], self.cooc)
        out["average_coherence"] = float(np.mean(list(out["coherence"].values()))) if out["coherence"] else 0.0
        return out


@dataclass
class SparsityPhi:
    class_id: str = DEFAULT_CLASS
    topics: list[str] | None = None
    eps: float = EPS

    def __call__(self, m: Matrices) -> dict:
        own = m.pwt[m.classes == self.class_id]
        own = own if not self.topics else own[:, np.isin(m.topics, self.topics)]
        zero = int((np.abs(own) < self.eps).sum())
        return {"value": zero / max(1, own.size), "zero_tokens": zero, "total_tokens": own.size}


@dataclass
class TopicKernel:
    class_id: str = DEFAULT_CLASS
    threshold: float = 0.1
    cooc: dict[tuple[str, str], float] | None = None

    def __call__(self, m: Matrices) -> dict:
        rows = np.flatnonzero(m.classes == self.class_id)
        if not len(rows):
            raise ValueError(f"no tokens of class {self.class_id}")
        p, n_t = m.pwt[rows], m.nwt[rows].sum(axis=0)
        q = p * n_t
        s = q.sum(axis=1, keepdims=True)
        ptw = np.divide(q, s, out=np.zeros_like(q), where=s > 0)
        out: dict = {"size": {}, "purity": {}, "contrast": {}, "coherence": {}, "tokens": {}}
        for t, name in enumerate(m.topics):
            own = np.flatnonzero(ptw[:, t] >= self.threshold)
            if not len(own):
                continue
            out["tokens"][name] = m.tokens[rows[own]].tolist()
            out["size"][name], out["purity"][name], out["contrast"][name] = len(own), float(p[own, t].sum()), float(ptw[own, t].mean())
            if self.cooc is not None:
                out["coherence"][name] = coherence(out["tokens"][name], self.cooc)
        for k in ("size", "purity", "contrast", "coherence"):
            out[f"average_{k}"] = float(np.mean(list(out[k].values()))) if out[k] else None
        return out


@dataclass
class TopicMassPhi:
    class_id: str = DEFAULT_CLASS
    topics: list[str] | None = None

    def __call__(self, m: Matrices) -> dict:
        mass = m.pwt[m.classes == self.class_id].sum(axis=0)
        every = mass.sum()
        names = [t for t in m.topics if not self.topics or t in self.topics]
        own = {t: float(mass[m.topics.index(t)]) for t in names}
        return {"value": sum(own.values()) / every if every else 0.0, "topic_mass": own, "topic_ratio": {t: x / every if every else 0.0 for t, x in own.items()}}


@dataclass
class BackgroundTokensRatio:
    class_id: str = DEFAULT_CLASS
    delta: float = 0.5
    direct: bool = True
    save_tokens: bool = True
    _: object = field(default=None, repr=False)

    def __call__(self, m: Matrices) -> dict:
        p_t = m.nwt.sum(axis=0)
        p_t = p_t / max(p_t.sum(), 1e-300)
        rows = np.flatnonzero(m.classes == self.class_id)
        q = m.pwt[rows] * p_t
        s = q.sum(axis=1, keepdims=True)
        ptw = np.divide(q, s, out=np.zeros_like(q), where=s > 0)
        some = (ptw > 0) & (p_t > 0)
        ratio = np.where(some, p_t / np.where(some, ptw, 1.0), 1.0)
        kl = np.where(some, p_t * np.log(ratio) if self.direct else -ptw * np.log(ratio), 0.0).sum(axis=1)
        above = kl > self.delta
        return {"value": above.sum() / max(1, len(m.tokens)), "tokens": m.tokens[rows[above]].tolist() if self.save_tokens else []}


def peak_memory(_: Matrices) -> int:
    """Most bytes that the driver's process held."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
