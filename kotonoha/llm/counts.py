"""Counted keys that travel through the shuffle as sorted arrays, one row per task and shard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (1 each by default)."""
    if counts is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def press(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes together, then counts."""
    import zstandard

    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.int64(len(keys)).tobytes() + np.ascontiguousarray(gaps).tobytes() + counts.astype("<u4").tobytes())


def unpress(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    content = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(content, "<i8", 1)[0])
    gaps = np.ascontiguousarray(np.frombuffer(content, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(content, "<u4", n, 8 + 8 * n).astype(np.uint64)


def shard_rows(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """One row per shard with entries; ``bounds`` are the first keys of the shards."""
    cut = np.append(np.searchsorted(keys, bounds), len(keys))
    full = [s for s in range(len(bounds)) if cut[s] < cut[s + 1]]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array([press(keys[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]]) for s in full], pa.binary())],
        names=["shard", "data"],
    )


def even(shards: int, top: int) -> list[int]:
    return [i * top // shards for i in range(shards)]


def gathered(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of counted arrays, two at a time so that memory stays near that of the result."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for blob in blobs:
        keys, counts = unpress(blob)
        while held and len(held[-1][0]) <= 2 * len(keys):
            k, c = held.pop()
            keys, counts = counted(np.concatenate((k, keys)), np.concatenate((c, counts)))
        held.append((keys, counts))
    while len(held) > 1:
        (k1, c1), (k2, c2) = held.pop(), held.pop()
        held.append(counted(np.concatenate((k1, k2)), np.concatenate((c1, c2))))
    return held[0]
