"""Vectorised word handling over Arrow text batches (numpy over the UTF-8 bytes, no per-word objects)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def table(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    keep = np.ones(256, bool)
    keep[np.frombuffer(separators, np.uint8)] = False
    return keep


#: ASCII upper case to lower case; all other bytes stay.
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Words between ASCII white space (space and \t to \r).
BETWEEN_SPACES = table(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs, equal outputs, otherwise as good as random."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    """The first ``n`` powers: 2**14 are kept, the others are their products with powers of the last."""
    if name not in _powers:
        steps = np.full((1 << 14) + 1, base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    low = _powers[name][:-1]
    if n <= len(low):
        return low[:n]
    high = np.full((n + len(low) - 1) >> 14, _powers[name][-1], np.uint64)
    high[0] = 1
    return (np.cumprod(high, dtype=np.uint64)[:, None] * low[None, :]).ravel()[:n]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(raw: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (in bytes) and row of each word; words never span rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = keep[raw]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = off[:-1][off[:-1] < len(raw)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal wherever the word stands."""
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * _power(_MULT, "up", len(raw)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_MULT_INV, "down", len(raw) + 1)[starts] + (ends - starts).astype(np.uint64))


def string_hashes(values: list[bytes]) -> np.ndarray:
    """``word_hashes`` of given words."""
    off = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
    raw = np.frombuffer(b"".join(values), np.uint8)
    return word_hashes(raw, off[:-1], off[1:])
