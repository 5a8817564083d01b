"""Reproducible start values: a pure function of class, token, seed and number of topics."""

from __future__ import annotations

import numpy as np

from ..schema import DEFAULT_CLASS

_START = 1125899906842597
_MASK = (1 << 64) - 1
_RNG = np.random.RandomState(0)  # seeded anew for each row, which is cheaper than a new one


def token_hash(class_id: str, token: str, seed: int = -1) -> int:
    """Multiplicative hash of signed UTF-8 bytes, with a separator between class and token; the
    default class isn't hashed and a seed counts only if positive."""
    h = _START
    parts = ([] if class_id == DEFAULT_CLASS else list(class_id.encode())) + [-1 - 256] + list(token.encode())
    for b in parts:
        if b == -257:
            h = (31 * h + 255) & _MASK
        else:
            h = (31 * h + (b - 256 if b > 127 else b)) & _MASK
    return (31 * h + seed) & _MASK if seed > 0 else h


def random_row(class_id: str, token: str, topics: int, seed: int = -1, zero_rate: float = 0.0) -> np.ndarray:
    """A row of topics numbers with sum 1. With zero_rate, each is zero with that probability."""
    rng = _RNG
    rng.seed(token_hash(class_id, token, seed) & 0xFFFFFFFF)
    top = np.float32(2**32 - 1)
    if zero_rate <= 1e-37:
        u = rng.randint(0, 2**32, topics, dtype=np.uint32).astype(np.float32) / top
    else:
        draws = iter(rng.randint(0, 2**32, 2 * topics, dtype=np.uint32).astype(np.float32) / top)
        u = np.array([next(draws) if next(draws) > zero_rate else np.float32(0) for _ in range(topics)], np.float32)
    s = u.sum(dtype=np.float32)
    return (u / s if s > 0 else u).astype(np.float64)


def token_hashes(classes: np.ndarray, tokens: np.ndarray, seed: int = -1) -> np.ndarray:
    """token_hash() of many tokens at once."""
    heads = {c: token_hash(c, "") for c in set(classes.tolist())}
    h = np.array([heads[c] for c in classes.tolist()], np.uint64)
    encoded = [t.encode() for t in tokens.tolist()]
    sizes = np.array([len(e) for e in encoded], np.int64)
    data = np.frombuffer(b"".join(encoded) + b"\0", np.int8).astype(np.int64).view(np.uint64)
    begin = np.append(0, np.cumsum(sizes))[:-1]
    order = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max() if len(sizes) else 0), side="left")
    for j, n in enumerate(active):
        at = order[:n]
        h[at] = h[at] * np.uint64(31) + data[begin[at] + j]
    return h * np.uint64(31) + np.uint64(seed) if seed > 0 else h


def random_rows(classes: np.ndarray, tokens: np.ndarray, topics: int, seed: int = -1, chunk: int = 1 << 15) -> np.ndarray:
    """random_row() of many tokens at once, without zeros: the generators' first states side by side."""
    if topics > 226:  # later numbers need states that were drawn before
        return np.array([random_row(c, t, topics, seed) for c, t in zip(classes, tokens)]).reshape(len(tokens), topics)
    out = np.empty((len(tokens), topics))
    start = token_hashes(classes, tokens, seed).astype(np.uint32)
    for a in range(0, len(tokens), chunk):
        x = start[a : a + chunk].copy()
        low, far = [x], []
        for i in range(1, 397 + topics):
            x = np.uint32(1812433253) * (x ^ (x >> np.uint32(30))) + np.uint32(i)
            if i <= topics:
                low.append(x)
            if i >= 397:
                far.append(x)
        for t in range(topics):
            y = (low[t] & np.uint32(0x80000000)) | (low[t + 1] & np.uint32(0x7FFFFFFF))
            y = far[t] ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), np.uint32(0x9908B0DF), np.uint32(0))
            y ^= y >> np.uint32(11)
            y ^= (y << np.uint32(7)) & np.uint32(0x9D2C5680)
            y ^= (y << np.uint32(15)) & np.uint32(0xEFC60000)
            y ^= y >> np.uint32(18)
            out[a : a + chunk, t] = y.astype(np.float32) / np.float32(2**32 - 1)
    u = out.astype(np.float32)
    s = np.array([r.sum(dtype=np.float32) for r in u], np.float32) if topics >= 8 else u.cumsum(axis=1, dtype=np.float32)[:, -1]
    return np.divide(u, s[:, None], out=u.copy(), where=s[:, None] > 0).astype(np.float64)
