"""Vectorised word hashing over the raw UTF-8 bytes of an Arrow string column.

Python sees a batch of texts as one byte buffer plus offsets. A word is a
maximal run of bytes outside a separator table; its 64-bit hash is a
polynomial over the bytes (a keyed table value per byte, times powers of an
odd base, modulo 2**64), finished with a bijective mixer, so the cost is a
few numpy passes per byte and no Python object per word.

Nulls count as empty texts. Batches are cut so that one slice holds about
``SLICE_BYTES``; a single longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEYS = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
#: Each byte with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE_BYTES:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def separator_table(is_separator, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(separator flag per byte, byte after lower-casing A-Z)."""
    fold = LOWER if lower else np.arange(256, dtype=np.uint8)
    return np.array([bool(is_separator(int(fold[b]))) for b in range(256)]), fold


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, row offsets into bytes)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        last = min(last, n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def span_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    n = len(folded)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_KEYS[folded] * _power(_BASE, n, "base"), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, n + 1, "inverse")[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, word offsets per row). Words never cross rows."""
    separator, fold = table
    gap = np.ones(len(raw) + 2, dtype=bool)
    gap[1:-1] = separator[raw]
    # a row border cuts words even where no separator byte stands
    begin = gap[:-2] & ~gap[1:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    begin[inner] = ~gap[1:-1][inner]
    stop = ~gap[1:-1] & gap[2:]
    stop[inner - 1] = ~gap[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return span_hashes(fold[raw], starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words of one row, row of each). A row of fewer
    words, but not none, gives one shingle of all its words."""
    n = len(hashes)
    counts = np.diff(offsets)
    rolled = np.full(max(n - k + 1, 0), k, dtype=np.uint64)
    for j in range(k):
        rolled = mix(rolled + hashes[j : n - k + 1 + j])
    row_of = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(max(n - k + 1, 0))
    whole = at + k <= offsets[1:][row_of[: len(at)]]
    rows, out = row_of[: len(at)][whole], rolled[whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        one = np.empty(len(short), dtype=np.uint64)
        for i, r in enumerate(short):
            x = np.array([counts[r]], dtype=np.uint64)
            for h in hashes[offsets[r] : offsets[r + 1]]:
                x = mix(x + h)
            one[i] = x[0]
        rows, out = np.concatenate([rows, short]), np.concatenate([out, one])
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return out, rows
