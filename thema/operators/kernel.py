"""The E-step on encoded documents: NumPy over whole batches of documents, under a Phi that a task holds.

A batch is flat: idx (rows of Phi, -1 for unknown tokens), weight, and start, where each document's tokens
begin. Sums by document are segment sums; only bags of words without agents are taken one document at a time, as their rows of Phi
then stay in the processor's cache.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..schema import TINY


@dataclass
class Batch:
    """Documents in flat arrays; titles by document; weight of each document's batch."""

    idx: np.ndarray
    weight: np.ndarray
    start: np.ndarray
    titles: list[str]
    scale: np.ndarray
    tx: np.ndarray | None = None  # transaction of each token, ascending
    tx_weight: np.ndarray | None = None  # weight of each token's transaction type

    @property
    def docs(self) -> int:
        return len(self.start) - 1

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.start))


@dataclass
class Counters:
    """n_wt of a batch by touched row of Phi, Theta, and sums for the scores."""

    rows: np.ndarray
    nwt: np.ndarray
    theta: np.ndarray
    sums: dict[str, float] = field(default_factory=dict)


def segment_sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of values[start[i]:start[i+1]] along the first axis; 0 for empty segments."""
    out = np.zeros((len(start) - 1, *values.shape[1:]))
    own = np.flatnonzero(np.diff(start) > 0)
    if len(own):
        out[own] = np.add.reduceat(values, start[:-1][own], axis=0)
    return out


def normalize_rows(theta: np.ndarray) -> np.ndarray:
    """Negatives as zero, rows divided by their sums (all zeros without a positive sum), tiny values as zero."""
    theta = np.maximum(theta, 0.0)
    s = theta.sum(axis=1, keepdims=True)
    theta = np.divide(theta, s, out=np.zeros_like(theta), where=s > 0)
    theta[theta < TINY] = 0.0
    return theta


def _by_row(idx: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(idx, kind="stable")
    rows, first = np.unique(idx[order], return_index=True)
    return rows, np.add.reduceat(values[order], first, axis=0) if len(rows) else np.zeros((0, values.shape[1]))


def _inner(f: np.ndarray, weight: np.ndarray, theta: np.ndarray, passes: int) -> np.ndarray:
    """One document's Theta after passes without agents."""
    for _ in range(passes):
        z = f.dot(theta)
        if z.min() >= TINY:
            n = (weight / z).dot(f)
        else:
            n = np.divide(weight, z, out=np.zeros_like(weight), where=np.abs(z) >= TINY).dot(f)
        theta = theta * n
        s = theta.sum()
        theta = theta / s if s > 0 else np.zeros_like(theta)
        theta[theta < TINY] = 0.0
    return theta


def plain(batch: Batch, phi: np.ndarray, theta: np.ndarray, passes: int, agents: list | None = None, fresh: np.ndarray | None = None) -> Counters:
    """Bag-of-words documents. Agents add r to the new, not yet normalized Theta in every pass. A document without known
    tokens keeps its Theta. fresh: rows that Phi lacks (zeros there), which count with Phi = 1 at the end."""
    known = batch.idx >= 0
    doc, weight, f = batch.doc_of[known], batch.weight[known], phi[batch.idx[known]]
    start = np.append(0, np.cumsum(np.bincount(doc, minlength=batch.docs)))
    has = np.diff(start) > 0
    if fresh is not None:
        has &= segment_sums((~fresh[batch.idx[known]]).astype(float), start) > 0
    theta = theta.copy()

    def ratio() -> np.ndarray:
        z = np.einsum("ij,ij->i", f, theta[doc])
        return np.divide(weight, z, out=np.zeros_like(weight), where=np.abs(z) >= TINY)

    if not agents:  # documents apart: their rows of Phi stay in the processor's cache through all passes
        for d in np.flatnonzero(has):
            theta[d] = _inner(f[start[d] : start[d + 1]], weight[start[d] : start[d + 1]], theta[d], passes)
    for i in range(passes if agents else 0):
        n_td = theta * segment_sums(f * ratio()[:, None], start)
        r = sum((a(n_td, batch.titles, i) for a in agents), np.zeros_like(n_td))
        theta[has] = normalize_rows(n_td + r)[has]
    if fresh is not None:
        f[fresh[batch.idx[known]]] = 1.0
    part = f * theta[doc] * (ratio() * batch.scale[doc])[:, None]
    return Counters(*_by_row(batch.idx[known], part), theta)


def occurrences(batch: Batch, phi: np.ndarray, theta: np.ndarray, passes: int, agents: list | None = None, editors: list | None = None) -> tuple[Counters, np.ndarray]:
    """Documents as token sequences: also p(t|d,w) of every occurrence, which editors change in every pass and at the end. Unknown
    tokens take Theta for it."""
    doc, known = batch.doc_of, batch.idx >= 0
    theta = theta.copy()

    def shares(i: int) -> np.ndarray:
        p = theta[doc].copy()
        p[known] *= phi[batch.idx[known]]
        z = p.sum(axis=1, keepdims=True)
        p = np.divide(p, z, out=np.zeros_like(p), where=np.abs(z) >= TINY)
        p[~known] = theta[doc[~known]]
        for edit in editors or []:
            for d in range(batch.docs):
                own = slice(batch.start[d], batch.start[d + 1])
                p[own] = edit(p[own], i)
        return p

    for i in range(passes):
        n_td = segment_sums(shares(i) * batch.weight[:, None], batch.start)
        r = sum((a(n_td, batch.titles, i) for a in agents or []), np.zeros_like(n_td))
        theta = normalize_rows(n_td + r)
    p = shares(passes)
    part = p * (batch.weight * batch.scale[doc])[:, None]
    return Counters(*_by_row(batch.idx[known], part[known]), theta), p


def transactions(batch: Batch, phi: np.ndarray, theta: np.ndarray, passes: int, agents: list | None = None) -> tuple[Counters, np.ndarray]:
    """Documents as sets of transactions, whose tokens are observed jointly; a transaction weighs as its first token
    does, times its type. One with an unknown token is skipped. Also p(x|d) of each transaction (nan if skipped)."""
    doc = batch.doc_of
    new = np.ones(len(batch.idx), bool)
    new[1:] = (batch.tx[1:] != batch.tx[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tx = np.cumsum(new) - 1
    ok = np.ones(len(head), bool)
    ok[tx[batch.idx < 0]] = False
    joint = np.ones((len(head), phi.shape[1]))
    if len(head):
        joint = np.multiply.reduceat(phi[np.maximum(batch.idx, 0)], head, axis=0)
    weight = batch.weight[head] * (batch.tx_weight[head] if batch.tx_weight is not None else 1.0) * ok
    tx_doc = doc[head]
    start = np.searchsorted(tx_doc, np.arange(batch.docs + 1))
    theta = theta.copy()

    def shares() -> tuple[np.ndarray, np.ndarray]:
        q = joint * theta[tx_doc]
        z = q.sum(axis=1)
        return np.divide(q, z[:, None], out=np.zeros_like(q), where=np.abs(z[:, None]) >= 1e-100), z

    for i in range(passes + 1):
        n_td = segment_sums(shares()[0] * weight[:, None], start)
        r = sum((a(n_td, batch.titles, i) for a in agents or []), np.zeros_like(n_td))
        theta = normalize_rows(n_td + r)
    q, z = shares()
    part = (q * (weight * batch.scale[tx_doc])[:, None])[tx]
    known = (batch.idx >= 0) & ok[tx]
    return Counters(*_by_row(batch.idx[known], part[known]), theta), np.where(ok, z, np.nan)


def transaction_sums(batch: Batch, p: np.ndarray, theta: np.ndarray) -> dict[str, float]:
    """As likelihood_sums for transactions with their p(x|d): one weighs as the sum of its tokens' weights; the type's weight
    counts in the normalizer only. A tiny p is replaced by the transaction's share of its document; skipped ones are left out."""
    doc = batch.doc_of
    new = np.ones(len(doc), bool)
    new[1:] = (batch.tx[1:] != batch.tx[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    n_x = np.add.reduceat(batch.weight, head) if len(head) else np.zeros(0)
    share = n_x / np.maximum(segment_sums(batch.weight, batch.start)[doc[head]], 1e-300)
    ok, zero = ~np.isnan(p), np.abs(p) < TINY
    value = np.where(zero, share, np.where(ok, p, 1.0))
    weight = n_x * (batch.tx_weight[head] if batch.tx_weight is not None else 1.0)
    return {
        "raw": float((n_x * np.log(np.maximum(value, 1e-300)))[ok].sum()), "normalizer": float(weight[ok].sum()), "zero_words": float((zero & ok).sum()),
        "zero_topics": float((np.abs(theta) < 1e-37).sum()), "total_topics": float(theta.size), "items": float(batch.docs),
        "token_weight": float(batch.weight.sum()), "token_weight_in_effect": float(batch.weight[batch.idx >= 0].sum()),
    }


def likelihood_sums(batch: Batch, phi: np.ndarray, theta: np.ndarray, unigram: np.ndarray | None = None) -> dict[str, float]:
    """Sums of a batch that its cumulative scores need. unigram: the collection's share of each row of Phi."""
    doc, known = batch.doc_of, batch.idx >= 0
    p = theta[doc].sum(axis=1)
    p[known] = np.einsum("ij,ij->i", phi[batch.idx[known]], theta[doc[known]])
    n_d = segment_sums(batch.weight, batch.start)[doc]
    fallback = np.divide(batch.weight, n_d, out=np.ones_like(n_d), where=n_d > 0)
    if unigram is not None:
        u = np.where(known, unigram[np.maximum(batch.idx, 0)], 0.0)
        fallback = np.where(u > 0, u, fallback)
    zero = np.abs(p) < TINY
    counts = batch.weight > 0
    return {
        "raw": float((batch.weight * np.log(np.where(zero, fallback, np.maximum(p, 1e-300))))[counts].sum()), "normalizer": float(batch.weight.sum()), "zero_words": float((zero & counts).sum()),
        "zero_topics": float((np.abs(theta) < 1e-37).sum()), "total_topics": float(theta.size), "items": float(batch.docs),
        "token_weight": float(batch.weight.sum()), "token_weight_in_effect": float(batch.weight[known].sum()),
    }
