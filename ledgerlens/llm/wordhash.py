"""Vectorised word hashing over Arrow string columns.

Texts of a record batch are handled as one byte buffer: separators are found with one table lookup a byte, and
each word gets a 64-bit hash from differences of a running polynomial sum. No Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text makes a block of its own.
BLOCK_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER_CODE = _BYTE_CODE.copy()
_LOWER_CODE[65:91] = _BYTE_CODE[97:123]
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * BLOCK_BYTES:
            _powers[kind] = have
    return have[:n]


def _drop_code(drop: bytes) -> np.ndarray:
    code = _LOWER_CODE.copy()
    code[list(drop)] = 0
    return code


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, row offsets)`` for runs of rows; nulls count as empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES, "right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def word_hashes(raw: np.ndarray, at: np.ndarray, drop: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows in order, and the index of each row's first word (one more at the end).

    Words are runs of bytes other than the six ASCII separators, with A-Z read as a-z. Bytes in ``drop`` don't
    count for the hash; words of such bytes alone are left out.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = _SPACE[raw]
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(space, out=inside[1:-1])
    starts = inside[1:-1] & ~inside[:-2]
    edge = at[1:-1][at[1:-1] < n]
    starts[edge] |= inside[1:-1][edge]
    begin = np.flatnonzero(starts)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    code = _drop_code(drop) if drop else _LOWER_CODE
    term = code[raw]
    term[space] = 0
    if drop:
        # a kept byte's power is its place among kept bytes, so dropped bytes leave no trace
        place = np.cumsum(term != 0) - 1
        term *= _power("base", _BASE, n)[np.maximum(place, 0)]
    else:
        term *= _power("base", _BASE, n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(term, out=total[1:])
    end = np.append(begin[1:], n)
    sums = total[end] - total[begin]
    origin = begin if not drop else np.maximum(np.concatenate(([0], place + 1))[begin], 0)
    hashes = mix(sums * _power("inverse", _BASE_INVERSE, n + 1)[origin])
    if drop:
        keep = sums != 0
        hashes, begin = hashes[keep], begin[keep]
    return hashes, np.searchsorted(begin, at, "left")


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles, and the index of each row's first one.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    n_rows = len(first) - 1
    counts = np.diff(first)
    usual = np.zeros(len(words), np.uint64)
    if len(words) >= k:
        h = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            h = mix(h + np.uint64(j)) + words[j : len(words) - k + 1 + j]
        usual[: len(h)] = mix(h)
    row = np.repeat(np.arange(n_rows), counts)
    place = np.arange(len(words)) - first[:-1][row]
    use = place <= counts[row] - k
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        h = words[first[short]].copy()
        for j in range(1, k - 1):
            more = counts[short] > j
            h[more] = mix(h[more] + np.uint64(j)) + words[first[short][more] + j]
        usual[first[short]] = mix(h ^ counts[short].astype(np.uint64))
        use[first[short]] = True
    usual, row = usual[use], row[use]
    edges = np.searchsorted(row, np.arange(n_rows + 1), "left")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        usual[a:b].sort()
    fresh = np.ones(len(usual), bool)
    fresh[1:] = (usual[1:] != usual[:-1]) | (row[1:] != row[:-1])
    return usual[fresh], np.concatenate(([0], np.cumsum(fresh)))[edges]
