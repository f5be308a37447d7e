"""Words and shingles of whole Arrow batches as 64-bit hashes, without a Python loop over words.

A word's hash is a polynomial in its bytes over a table of random codes, from prefix sums over the text buffer, so
equal words have equal hashes wherever they stand; A-Z have the codes of a-z. Texts are worked off in blocks of about
``BLOCK`` bytes, which bounds the memory; longer words take hashlib's digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from strophe.llm.common import WORKER_CACHES

BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    p = np.full(BLOCK + 1, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_TABLES: dict[str, np.ndarray] = {}
WORKER_CACHES["ngram_join"] = _TABLES.clear


def _tables() -> dict[str, np.ndarray]:
    """Made on first use, so that importing costs nothing."""
    if not _TABLES:
        code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        code[65:91] = code[97:123]
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        _TABLES.update(code=code, space=space, up=_powers(_P), down=_powers(pow(_P, -1, 1 << 64)))
    return _TABLES


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    if data is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without white space) of the rows, and where each row's words begin."""
    t = _tables()
    data, rows = text_buffer(col)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(col) + 1, np.int64)
    solid = ~t["space"][data]
    edge = np.zeros(n + 1, bool)
    edge[rows] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(first), np.uint64)
    at = 0
    while at < len(first):  # a block of whole words
        to = max(int(np.searchsorted(last, first[at] + BLOCK, "right")), at + 1)
        lo, hi = int(first[at]), int(last[to - 1])
        if hi - lo > BLOCK:  # one very long word
            low = bytes(data[lo:hi]).translate(_LOWER)
            out[at] = int.from_bytes(hashlib.blake2b(low, digest_size=8).digest(), "little")
        else:
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(t["code"][data[lo:hi]] * t["up"][: hi - lo], out=sums[1:])
            a, b = first[at:to] - lo, last[at:to] - lo
            out[at:to] = mix((sums[b] - sums[a]) * t["down"][a] + (b - a).astype(np.uint64))
        at = to
    return out, np.searchsorted(first, rows)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; of fewer words, the sequence as one."""
    w, rows = words(col)
    mult = np.uint64(0xF1357AEA2E62A9C5)
    s = np.zeros(max(len(w) - k + 1, 0), np.uint64)
    for i in range(k):
        s = s * mult + w[i : i + len(s)]
    s = mix(s)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            h = b - a
            for x in w[a:b].tolist():
                h = (h * 0xF1357AEA2E62A9C5 + x) & _MASK
            yield mix(np.array([h ^ 0x5851F42D4C957F2D], np.uint64))
        else:
            yield s[:0]
