"""Quality scores: logistic regression on hashed word n-grams.

Words are runs of letters and digits or runs of signs, case kept; a word equal
to the one before it counts as a repeat.  One- and two-word grams are hashed
to ``2 ** bits`` weights; a text is a sparse vector of length one, whose entries are
the roots of its grams' shares.  The weights are learned with
follow-the-regularised-leader updates over a bounded sample of labelled rows
and sent to all tasks (at most ``4 * 2 ** bits`` bytes).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.llm import words
from kotonoha.llm.rows import below

_REPEAT = np.uint64(0xA24BAED4963EE407)
_PAIR = np.uint64(0x9FB21C651E98DF25)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sparse(column, bits: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row, stop, indexes, values, begins)``: the vectors of a run of texts, each in order of index."""
    for row, stop, data, offsets in words.slices(column):
        h, at = words.hashed(data, offsets, words.SIGNS, lower=False)
        owner = np.repeat(np.arange(stop - row), np.diff(at))
        n = len(h)
        if not n:
            yield row, stop, np.zeros(0, np.int64), np.zeros(0), np.zeros(stop - row + 1, np.int64)
            continue
        after = np.zeros(n, bool)
        after[1:] = owner[1:] == owner[:-1]
        same = after.copy()
        same[1:] &= h[1:] == h[:-1]
        h = np.where(same, _REPEAT, h)
        pair = words.mix(h[:-1] * _PAIR + h[1:])[after[1:]]
        who = np.concatenate((owner, owner[1:][after[1:]])).astype(np.uint64)
        grams = np.concatenate((h, pair)) >> np.uint64(64 - bits)
        key = np.sort((who << np.uint64(bits)) | grams)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        who = (key >> np.uint64(bits)).astype(np.int64)
        begins = np.searchsorted(who, np.arange(stop - row + 1))
        total = np.bincount(who, count, stop - row)
        yield row, stop, (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.sqrt(count / total[who]), begins


def _score(weights: np.ndarray, bias: float, index: np.ndarray, value: np.ndarray, begins: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights[index] * value)))
    z = bias + total[begins[1:]] - total[begins[:-1]]
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Leader:
    """Follow-the-regularised-leader updates of one weight per hashed gram, and a bias that is not regularised."""

    def __init__(self, bits: int, rate: float, smooth: float, l1: float, l2: float):
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0

    def weights(self, index=slice(None)) -> np.ndarray:
        z = self.z[index]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0) / ((self.smooth + np.sqrt(self.n[index])) / self.rate + self.l2)

    def bias(self) -> float:
        return -self.bias_z * self.rate / (self.smooth + self.bias_n**0.5)

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        w, b = self.weights(index), self.bias()
        g = 1.0 / (1.0 + np.exp(-np.clip(b + w @ value, -35, 35))) - label
        step = g * value
        grown = self.n[index] + step * step
        self.z[index] += step - (np.sqrt(grown) - np.sqrt(self.n[index])) / self.rate * w
        self.n[index] = grown
        bias_n = self.bias_n + g * g
        self.bias_z += g - (bias_n**0.5 - self.bias_n**0.5) / self.rate * b
        self.bias_n = bias_n


@dataclass(frozen=True)
class QualityModel:
    bits: int
    bias: float
    weights: np.ndarray


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``(text, label)`` of at most ``most`` labelled documents: those whose id's hash is smallest.

    A document labelled twice has its lower label; of rows that repeat an id the text of smallest hash is taken, so the bound
    is one of rows.  Ids are chosen from ``labels`` alone; only their texts leave the scan.
    """
    place = F.xxhash64("doc_id")
    valid = labels.filter("doc_id is not null and quality in (0, 1)")
    near = valid.filter(below(place, most, max(1, valid.count())))
    chosen = near.groupBy("doc_id").agg(F.min("quality").alias("label")).withColumn("place", place).orderBy("place", "doc_id").limit(most)
    # at most ``most`` rows of three numbers
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return met.groupBy("place", "doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("place", "doc_id", "text", "label")


def train(
    docs: DataFrame, labels: DataFrame, most: int = 12_000, bits: int = 20, epochs: int = 4,
    rate: float = 0.5, smooth: float = 1.0, l1: float = 0.02, l2: float = 0.1,
) -> QualityModel:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; the caller leaves out the rows not to be learned from.

    The sample's bound ``most`` is why one task may hold it; a larger one costs time in proportion.  With no rows, or
    rows of one label only, the model is still defined (without any: 0.5 for each text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        leader = Leader(bits, rate, smooth, l1, l2)
        if rows is not None and rows.num_rows:
            rows = rows.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("text", "ascending")])
            labels_, vectors = rows["label"].to_numpy(), []
            for _, _, index, value, begins in sparse(rows["text"], bits):
                index, value = index.astype(np.int32), value.astype(np.float32)
                vectors += [(index[a:b], value[a:b]) for a, b in zip(begins[:-1], begins[1:])]
            for _ in range(epochs):
                for (index, value), label in zip(vectors, labels_):
                    leader.learn(index, value, float(label))
        w = leader.weights().astype("<f4")
        (full,) = np.nonzero(w)
        yield pa.RecordBatch.from_pydict({"bias": [leader.bias()], "index": [full.astype("<i4").tobytes()], "weight": [w[full].tobytes()]})

    sample = labelled_rows(docs, labels, most).repartition(1)
    learned = sample.mapInArrow(run, "bias double, index binary, weight binary").collect()
    weights = np.zeros(1 << bits, np.float32)
    for row in learned:
        weights[np.frombuffer(row["index"], "<i4")] = np.frombuffer(row["weight"], "<f4")
    return QualityModel(bits, learned[0]["bias"] if learned else 0.0, weights)


def _scorer(docs: DataFrame, model: QualityModel):
    sent = docs.sparkSession.sparkContext.broadcast(model.weights)
    bits, bias = model.bits, model.bias

    def scores(texts) -> np.ndarray:
        out = np.empty(len(texts))
        for row, stop, index, value, begins in sparse(texts, bits):
            out[row:stop] = _score(sent.value, bias, index, value, begins)
        return out

    return scores


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``docs(doc_id, text)``.

    A null or empty text has the bias's score.  Repeated rows, null ids and long texts are scored like others.
    Columns other than ``doc_id`` and ``text`` are not read.
    """
    scores = _scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or more."""
    scores, at = _scorer(docs, model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) >= least))

    return docs.mapInArrow(run, docs.schema)
