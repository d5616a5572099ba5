"""Cost-balanced packing of token sequences.

Attention inside a packed sequence stays within a document, so a piece of
``n`` ids costs ``linear * n + quadratic * n * n``.  A document's full
sequences are cut off first.  The rests of ``window`` documents at a time are
assigned in descending length to the cheapest sequence that still has room for
them whole; a rest that fits nowhere is cut over the cheapest open sequences.
There are exactly as many places as ids: full sequences, and powers of two for
what is left over, so that nothing is padded.

Each task packs the documents it reads.  No shuffle is needed, no key can be
hot, and a task holds one batch of texts and one window of rests.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kotonoha.llm import tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
#: Sequence ids of one task lie in a range of this size.
_TASK_RANGE = 1 << 40


def assign(lengths: np.ndarray, places: np.ndarray, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """``(item, first id, length, place)`` for all ids of all items; ``sum(lengths) == sum(places)``.

    Ties go to the earlier item and the earlier place.
    """
    room, cost, out = places.astype(np.int64).copy(), np.zeros(len(places)), []
    for item in np.argsort(-lengths, kind="stable"):
        at, left = 0, int(lengths[item])
        while left:
            fits = room >= left
            open_ = fits if fits.any() else room > 0
            place = int(np.where(open_, cost, np.inf).argmin())
            n = min(left, int(room[place]))
            out.append((int(item), at, n, place))
            room[place] -= n
            cost[place] += linear * n + quadratic * n * n
            at, left = at + n, left - n
    return out


def places_for(total: int, size: int) -> np.ndarray:
    """Capacities that hold ``total`` ids without padding: full sequences, then powers of two."""
    full, rest = divmod(total, size)
    return np.array([size] * full + [1 << i for i in range(size.bit_length() - 1, -1, -1) if rest >> i & 1], np.int64)


class _Packer:
    def __init__(self, size: int, window: int, linear: float, quadratic: float):
        self.size, self.window, self.linear, self.quadratic = size, window, linear, quadratic
        self.next_id = TaskContext.get().partitionId() * _TASK_RANGE
        self.rests: list[tuple] = []
        self.rows: list[tuple] = []

    def _cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def add(self, doc_id, ids: np.ndarray) -> None:
        """``ids`` are little-endian unsigned 32-bit."""
        n, size = len(ids), self.size
        full = n // size * size
        for start in range(0, full, size):
            self.rows.append((doc_id, start, size, zlib.crc32(ids[start : start + size]), n, self.next_id, 0, self._cost(size)))
            self.next_id += 1
        if full < n:
            self.rests.append((doc_id, full, n, ids[full:].copy()))
            if len(self.rests) >= self.window:
                self.flush()

    def flush(self) -> None:
        lengths = np.array([len(r[3]) for r in self.rests], np.int64)
        places = places_for(int(lengths.sum()), self.size)
        filled = np.zeros(len(places), np.int64)
        for item, at, n, place in assign(lengths, places, self.linear, self.quadratic):
            doc_id, full, total, ids = self.rests[item]
            self.rows.append((doc_id, full + at, n, zlib.crc32(ids[at : at + n]), total, self.next_id + place, int(filled[place]), self._cost(n)))
            filled[place] += n
        self.next_id += len(places)
        self.rests = []

    def taken(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
        columns = zip(*self.rows) if self.rows else [[] for _ in names]
        kinds = [pa.int64()] * 7 + [pa.float64()]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
        self.rows = []
        return batch


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    size: int = 1024,
    window: int = 4096,
    linear: float = 1.0,
    quadratic: float = 1.0 / 1024,
) -> DataFrame:
    """Pack whole texts of ``docs(doc_id, text)`` into sequences of at most ``size`` ids (a power of two).

    One row per piece: where it begins in its document's ids (``start``) and in its sequence (``offset``), its
    length, the CRC-32 of its ids, its document's number of ids with the end id, and its cost.

    - A null or empty text is one end id.  A null ``doc_id`` is packed like any other.
    - Repeated rows are packed once each.  Ties in length keep the order of reading.
    - Long texts fill sequences of their own; only their rest shares one.
    - An empty table has no pieces.  Columns other than ``doc_id`` and ``text`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens.encoder(tokenizer), _Packer(size, window, linear, quadratic)
        end = np.array([end_id], "<u4")
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for row, stop in tokens.batches(texts):
                ids, at = encoder.encode(texts.slice(row, stop - row))
                for i in range(stop - row):
                    packer.add(names[row + i], np.concatenate((ids[at[i] : at[i + 1]], end)))
                yield packer.taken()
        packer.flush()
        yield packer.taken()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
