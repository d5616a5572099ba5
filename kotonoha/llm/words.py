"""Word hashing over whole Arrow batches with NumPy.

A batch of texts is one byte array.  Every byte gets a 64-bit value, a word's
hash is the polynomial of its bytes' values, and all words of the batch come
from one running sum.  No Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed in slices of about this many bytes, so that memory does not depend on Spark's batch size.
SLICE_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_SPACE = (_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))

#: Byte classes: 0 parts words, equal neighbours belong to one word.
SPACED = np.where(_SPACE, 0, 1).astype(np.uint8)
#: As SPACED, with runs of ASCII signs as words of their own.
SIGNS = np.where(
    _SPACE, 0,
    np.where((_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57)) | ((LOWER >= 97) & (LOWER <= 122)), 1, 2),
).astype(np.uint8)

#: As SIGNS, with signs as space: a word is the same with or without signs around it.
BARE = np.where(SIGNS == 1, 1, 0).astype(np.uint8)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("_powers", _ODD), ("_inverses", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` for runs of rows; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1)
        yield row, stop, data[at[row] : at[stop]], at[row : stop + 1] - at[row]
        row = stop


def hashed(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACED, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text where its words begin (one entry more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = classes[data]
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:])
    begins = offsets[:-1][offsets[:-1] < n]
    cut[begins] = True
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], n)
    word = kind[at] > 0
    at, ends = at[word], ends[word]
    return spans(LOWER[data] if lower else data, at, ends), np.searchsorted(at, offsets)


def spans(data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans ``at[i]:ends[i]``, none of them empty."""
    n = len(data)
    _grow(n + 1)
    total = _VALUE[data]
    total *= _powers[:n]
    np.cumsum(total, out=total)
    value = total[ends - 1]
    first = at > 0
    value[first] -= total[at[first] - 1]
    value *= _inverses[at]
    return mix(value)


def text_rows(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, word hashes, word offsets)`` of lower-cased, space-parted words."""
    for row, stop, data, offsets in slices(column):
        yield (row, stop, *hashed(data, offsets))


def shingles(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and where they begin.  A text of fewer words has one, of all its words."""
    count = np.diff(at)
    many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(many)))
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    total = padded[: len(words)] * factors[0]
    for j in range(1, k):
        total += padded[j : j + len(words)] * factors[j]
    start = np.repeat(at[:-1] - to[:-1], many) + np.arange(to[-1])
    value = total[start]
    for t in np.flatnonzero((count > 0) & (count < k)):
        n = int(count[t])
        value[to[t]] = (int((words[at[t] : at[t + 1]] * factors[:n]).sum(dtype=np.uint64)) + n * _ODD) & _MASK
    return mix(value), to


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each text sorted and without repeats, and where they begin."""
    values = values.copy()
    keep = np.ones(len(values), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        values[a:b].sort()
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    keep[at[:-1][at[:-1] < len(values)]] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def sets(column, k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(row, stop, sorted distinct shingles, begins)`` of runs of texts."""
    for row, stop, h, at in text_rows(column):
        yield (row, stop, *distinct(*shingles(h, at, k)))
