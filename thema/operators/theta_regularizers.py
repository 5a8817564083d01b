"""Regularizers of Theta and of p(t|d,w): small callables that run inside the kernel."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def transform(x: np.ndarray, kind: str = "constant", a: float = 1.0, n: float = 1.0) -> np.ndarray:
    """As functions.columns.transformed, for arrays."""
    if kind == "constant":
        return np.ones_like(x)
    positive = np.where(x > 0, x, 1.0)
    return np.where(x > 0, np.log(positive) if kind == "logarithm" else a * positive**n, 0.0)


class ThetaRegularizer:
    """Base of regularizers of Theta: called with n_td (documents x topics), titles and the number of the inner pass, it
    gives r_td."""


class PtdwRegularizer:
    """Base of regularizers of occurrences: called with p(t|d,w) of a document's tokens and the number of the inner pass,
    it gives the new values."""


@dataclass
class SmoothSparseTheta(ThetaRegularizer):
    """tau * alpha_iter[i] * tau_t * multiplier * f(n_td) where f is positive. titles: the documents it applies to, with
    multipliers by document (rows) or, one row, by topic; topics: their indices, None for all."""

    tau: float
    topics: list[int] | None = None
    alpha_iter: list[float] | None = None
    titles: list[str] | None = None
    multipliers: list[list[float]] | None = None
    kind: str = "constant"
    a: float = 1.0
    n: float = 1.0

    def __call__(self, n_td: np.ndarray, titles: list[str], i: int) -> np.ndarray:
        alpha = self.alpha_iter[i] if self.alpha_iter and i < len(self.alpha_iter) else 0.0 if self.alpha_iter else 1.0
        f = transform(n_td, self.kind, self.a, self.n)
        r = np.where(f > 0, self.tau * alpha * f, 0.0)
        if self.topics is not None:
            mask = np.zeros(n_td.shape[1])
            mask[self.topics] = 1.0
            r = r * mask
        if self.titles is not None:
            at = {t: k for k, t in enumerate(self.titles)}
            m = np.zeros_like(n_td)
            for d, t in enumerate(titles):
                if t in at:
                    m[d] = 1.0 if self.multipliers is None else self.multipliers[at[t] if len(self.multipliers) > 1 else 0]
            r = r * m
        elif self.multipliers is not None:
            r = r * np.asarray(self.multipliers[0])
        return r


@dataclass
class TopicSelectionTheta(ThetaRegularizer):
    """-tau * alpha * topic_value[t] * n_td; topic_value = n / (n_t * T), refreshed from n_wt before each pass."""

    tau: float
    topic_value: np.ndarray | None = None
    alpha_iter: list[float] | None = None
    topics: list[int] | None = None

    def refresh(self, nwt: np.ndarray) -> None:
        n_t = nwt.sum(axis=0)
        self.topic_value = np.divide(n_t.sum(), n_t * len(n_t), out=np.zeros_like(n_t), where=n_t > 0)

    def __call__(self, n_td: np.ndarray, titles: list[str], i: int) -> np.ndarray:
        alpha = self.alpha_iter[i] if self.alpha_iter and i < len(self.alpha_iter) else 0.0 if self.alpha_iter else 1.0
        value = np.asarray(self.topic_value)
        if self.topics is not None:
            mask = np.zeros(len(value))
            mask[self.topics] = 1.0
            value = value * mask
        return np.where(n_td > 0, -self.tau * alpha * value * n_td, 0.0)


@dataclass
class HierarchySparsingTheta(ThetaRegularizer):
    """For the parent model's topics as documents, all together: -tau * alpha * (1 / documents - (n_td / n_d) * prop_d / n_t) where n_td > 0,
    n_t the sum over documents of prop_d * n_td / n_d. zero_prior: 0 in place of the first term."""

    tau: float
    proportions: dict[str, float] | None = None
    alpha_iter: list[float] | None = None
    zero_prior: bool = False

    def __call__(self, n_td: np.ndarray, titles: list[str], i: int) -> np.ndarray:
        alpha = self.alpha_iter[i] if self.alpha_iter and i < len(self.alpha_iter) else 0.0 if self.alpha_iter else 1.0
        prop = np.array([(self.proportions or {}).get(t, 1.0 / len(titles)) for t in titles])
        n_d = n_td.sum(axis=1, keepdims=True)
        share = np.divide(n_td, n_d, out=np.zeros_like(n_td), where=n_d > 0) * prop[:, None]
        n_t = share.sum(axis=0)
        prior = 0.0 if self.zero_prior else 1.0 / max(1, len(titles))
        posterior = np.divide(share, n_t, out=np.zeros_like(share), where=n_t > 0)
        return np.where(n_td > 0, -self.tau * alpha * (prior - posterior), 0.0)


@dataclass
class SmoothPtdw(PtdwRegularizer):
    """p(t|d,w) of neighbours: the sum over a window of positions, leaving out background tokens ("average"), or the product
    of both neighbours ("product"). background: indices of background topics."""

    tau: float
    kind: str = "average"
    window: int = 10
    threshold: float = 1.0
    background: tuple[int, ...] = ()

    def __call__(self, p: np.ndarray, i: int) -> np.ndarray:
        if self.kind == "product":
            before, after = np.ones_like(p), np.ones_like(p)
            before[1:], after[:-1] = p[:-1], p[1:]
            return p * before * after
        h = self.window // 2
        counted = p.copy()
        if self.background:
            counted[p[:, list(self.background)].sum(axis=1) > self.threshold] = 0.0
        total = np.vstack([np.zeros((1, p.shape[1])), np.cumsum(counted, axis=0)])
        at = np.arange(len(p))
        lo, hi = np.maximum(at - h, 0), np.minimum(at + h, len(p))
        return p + self.tau * (total[hi] - total[lo])


@dataclass
class TopicSegmentationPtdw(PtdwRegularizer):
    """Assigns every token wholly to the main topic of its segment. A segment ends where the windows before and behind a token
    differ in their main topics by more than threshold."""

    window: int = 10
    threshold: float = 0.5
    background: tuple[int, ...] = ()

    def __call__(self, p: np.ndarray, i: int) -> np.ndarray:
        if not len(p):
            return p
        h, n = self.window, len(p)
        weight = 1 - p[:, list(self.background)].sum(axis=1) if self.background else np.ones(n)
        total = np.vstack([np.zeros((1, p.shape[1])), np.cumsum(p * weight[:, None], axis=0)])
        mass = np.append(0.0, np.cumsum(weight))
        out = np.zeros_like(p)
        main = int(p[0].argmax())
        out[0, main] = 1.0
        for k in range(1, n):
            lo, hi = max(0, k - h), min(n, k + h)
            left, right, wl, wr = total[k] - total[lo], total[hi] - total[k], mass[k] - mass[lo], mass[hi] - mass[k]
            if wl > 0 and wr > 0:
                a, b = int(left.argmax()), int(right.argmax())
                if ((left[a] / wl - right[a] / wr) + (right[b] / wr - left[b] / wl)) / 2 > self.threshold:
                    main = b
            out[k, main] = 1.0
        return out
