"""NumPy helpers over Arrow string batches: bytes, words and word k-grams as 64-bit hashes.

Everything works on whole columns of a batch at once; a chunk is a run of rows holding about
``CHUNK`` bytes, and a longer text is a chunk of its own, never cut.
A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1


class _Kept(dict):
    """A cache that travels empty: functions that use it are sent to the workers by value."""

    def __reduce__(self):
        return _Kept, ()


_powers: dict[int, np.ndarray] = _Kept()


def trim() -> None:
    """Gives memory that was freed back to the system: workers live on between tasks, and what they hold on to adds up."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(f: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """f, a function of Arrow columns, with trim() after each call, when what it took is free."""

    @wraps(f)
    def run(*columns: pa.Array) -> pa.Array:
        out = f(*columns)
        trim()
        return out

    return run


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64; tables are kept and grow on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        out = np.ones(size, np.uint64)
        step, done = base & _M64, 1
        while done < size:
            m = min(done, size - done)
            out[done : done + m] = out[:m] * np.uint64(step)
            step, done = step * step & _M64, done + m
        if size > 4 * CHUNK:  # of one very long text: not kept
            return out[:n]
        _powers[base] = have = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], for all ranges at once."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    inverse = pow(base, -1, 1 << 64)
    return mix((total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and its len+1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


_WORD = np.zeros(256, bool)
for _b in range(256):
    _WORD[_b] = chr(_b).isalnum() if _b < 128 else True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of ASCII letters and digits and of non-ASCII bytes), and
    for each row the index of its first word (len rows+1). A word never crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = _WORD[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = w[cut]
    last = w.copy()
    last[:-1] &= ~w[1:]
    tail = offsets[1:][offsets[1:] > 0] - 1
    last[tail] = w[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Code points that are no part of words: Latin-1 signs, general punctuation, and that of East Asian scripts.
SIGNS = [(0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0x2000, 0x207F), (0x3000, 0x3004), (0x3008, 0x303F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20)]
#: Code points that are words by themselves, of scripts without blanks: Thai and Lao, kana, Han.
ALONE = [(0xE00, 0xEFF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0x20000, 0x2FFFF)]


def _pattern() -> str:
    span = lambda ranges: "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    inside, at = [], 0x80
    for a, b in sorted(SIGNS + ALONE):
        if at < a:
            inside.append((at, a - 1))
        at = b + 1
    return f"[0-9a-z{span([*inside, (at, 0x10FFFF)])}]+|[{span(ALONE)}]"


#: The words of lower-case text as a regular expression (of Java and RE2).
WORD_PATTERN = _pattern()
_SPECIAL = np.zeros(256, bool)
_SPECIAL[[0xC2, 0xE0, 0xE2, 0xE3, *range(0xE4, 0xEA), 0xEF, 0xF0]] = True


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_bounds(), for words as WORD_PATTERN has them: SIGNS end words, and characters of ALONE are words each."""
    at = np.flatnonzero(_SPECIAL[data])
    if not len(at):
        return word_bounds(data, offsets)
    padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int64)
    a, b, c, d = (padded[at + j] for j in range(4))
    size = np.where(a < 0xE0, 2, np.where(a < 0xF0, 3, 4))
    code = np.where(size == 2, (a & 31) << 6 | b & 63, np.where(size == 3, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63))
    within = lambda ranges: np.any([(code >= x) & (code <= y) for x, y in ranges], axis=0)
    signs, alone = within(SIGNS), within(ALONE)
    if not (signs.any() or alone.any()):
        return word_bounds(data, offsets)
    plain, out = data.copy(), signs | alone
    for j in range(4):
        plain[at[out & (size > j)] + j] = 32
    starts, ends, rows = word_bounds(plain, offsets)
    if alone.any():
        starts, ends = np.concatenate([starts, at[alone]]), np.concatenate([ends, at[alone] + size[alone]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
        rows = np.searchsorted(starts, offsets)
    return starts, ends, rows


def lower(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.utf8_lower(column)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (see split_words), in order, and each row's first word (len rows+1)."""
    starts, ends, rows = split_words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    return range_hash(data.astype(np.uint64) + np.uint64(1), starts, ends, _BASE), rows


def kgrams(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word k-grams that lie within one row, and each row's first k-gram (len rows+1)."""
    counts = np.maximum(np.diff(rows) - (k - 1), 0)
    first = np.zeros(len(rows), np.int64)
    np.cumsum(counts, out=first[1:])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    starts = np.arange(first[-1]) + np.repeat(rows[:-1] - first[:-1], counts)
    return range_hash(words, starts, starts + k, _GRAM), first


class HashTable:
    """Open addressing over 64-bit keys; find() looks up whole arrays."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._slot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several, the last stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
        self.at = np.where(self.slots >= 0, keys[np.maximum(self.slots, 0)] if len(keys) else 0, 0).astype(np.uint64)

    @classmethod
    def of(cls, keys: np.ndarray, slots: np.ndarray, at: np.ndarray) -> HashTable:
        """The table with these arrays, taken from another."""
        out = cls.__new__(cls)
        out.keys, out.slots, out.at, out.bits = keys, slots, at, len(slots).bit_length() - 1
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where absent."""
        at = self._slot(keys)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.at[at] != keys))
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slots[at]
            out[todo] = got
            more = (got >= 0) & (self.at[at] != keys[todo])
            todo, at = todo[more], at[more]
        return out
