"""Benchmark passages in documents, by edit distance over words.

The CGK walk copies words to an output longer than the input and after each copy moves on, or not, by a random bit of the
word and the step.  Two texts that walk with the same bits fall into step again after an edit, so a small edit distance
becomes a small Hamming distance, and sampled positions of the outputs agree often.  The share that agrees falls with the
number of edits, though, so an item is embedded in pieces of at most ``PIECE`` words: of pieces of about one size, one has no more
than its share of the edits, whatever the item's length.  Windows of the pieces' sizes are cut from all
documents, embedded by several independent walks, and looked up in tables of sampled positions; the number of tables
follows from the wanted recall of a piece.  A looked-up pair is then aligned exactly, as a whole item.

A walk takes ``STEPS`` steps a word and moves on half a word a step, so positions come from the first four fifths of what a
window and a piece surely share.
A window is embedded only if enough of its words occur in the benchmark at all, which
every window within the allowed edits does.  Items are taken in blocks of bounded size, so that what
each task holds is bounded; nothing is shuffled before the hits, and no bucket is shared between documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.tables import written
from kotonoha.llm import words

_PAD = np.uint64(0x94D049BB133111EB)
#: Words of a piece, at most.
PIECE = 11
#: Steps of a walk a word that window and piece surely share.  More steps reach a piece's end but agree less: measured, fewer are found.
STEPS = 1.6
#: Bytes of items' text that a task holds at once: their tables take about 12 times as much.
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, distance int, item_words int, first_word long, last_word long"


def allowed(n: int, share: float) -> int:
    """Edits allowed for an item of ``n`` words."""
    return int(n * share + 1e-9)


def tables_for(recall: float, agree: float, sampled: int) -> int:
    """Tables of ``sampled`` positions that meet the recall if a share ``agree`` of the embedded positions agrees."""
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**sampled))


class SizeClass:
    """Pieces of about one size, their walks and tables."""

    def __init__(self, pieces: list[int], start, size, limit, edits: int, walks: int, tables: int, sampled: int, symbols):
        self.low = int(size[pieces].min())
        #: Windows begin at every so many words; pieces are in the tables from each of their first ``stride`` words on,
        #: so that some window and some entry begin at the same word.
        self.stride = max(1, self.low // 5)
        self.edits = edits
        #: Words that a window and its piece surely share the place of.
        self.sure = self.low - self.stride + 1
        rng = np.random.default_rng([self.low, int(size[pieces].max()), 11])
        steps = max(2, int(STEPS * self.sure))
        self.coefficients = [rng.integers(0, 1 << 63, steps, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(walks)]
        per = -(-tables // walks)
        self.samples = [[np.sort(rng.choice(steps, min(sampled, steps), replace=False)) for _ in range(per)] for _ in range(walks)]
        self.weights = rng.integers(0, 1 << 63, sampled, np.uint64) * np.uint64(2) + np.uint64(1)
        shift, pieces = np.repeat(np.arange(self.stride), len(pieces)), np.tile(np.array(pieces), self.stride)
        self.keys = []
        for keys in self.tables(symbols, start[pieces] + shift, limit[pieces] - shift):
            order = np.argsort(keys, kind="stable")
            present = np.zeros(1 << 16, bool)
            present[keys >> np.uint64(48)] = True
            self.keys.append((keys[order], pieces[order].astype(np.int32), present))

    def tables(self, symbols: np.ndarray, start: np.ndarray, limit: np.ndarray) -> Iterator[np.ndarray]:
        """The keys of each table for texts ``symbols[start : start + limit]``."""
        for coefficient, samples in zip(self.coefficients, self.samples):
            wanted = sorted({int(p) for s in samples for p in s})
            seen, at = {}, np.zeros(len(start), np.int64)
            for step in range(wanted[-1] + 1):
                symbol = np.where(at < limit, symbols[start + np.minimum(at, limit - 1)], _PAD)
                if step in wanted:
                    seen[step] = symbol
                at += ((symbol * coefficient[step]) >> np.uint64(63)).astype(np.int64)
            for sample in samples:
                total = np.zeros(len(start), np.uint64)
                for position, weight in zip(sample, self.weights):
                    total += seen[int(position)] * weight
                yield words.mix(total)

    def look_up(self, symbols: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(window, piece)`` pairs that share a key in some table."""
        windows, items = [], []
        for keys, (held, of, present) in zip(self.tables(symbols, start, limit), self.keys):
            maybe = np.flatnonzero(present[keys >> np.uint64(48)])
            a, b = np.searchsorted(held, keys[maybe]), np.searchsorted(held, keys[maybe], "right")
            n = b - a
            windows.append(np.repeat(maybe, n))
            items.append(of[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        pair = np.unique(np.stack((np.concatenate(windows), np.concatenate(items))), axis=1)
        return pair[0], pair[1]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits that turn the item into a run of the text's words, and that run's begin and end; of equal ones the first begin."""
    one, columns = 1 << 32, np.arange(len(text) + 1, dtype=np.int64)
    row = columns.copy()
    for i, symbol in enumerate(item, 1):
        best = np.empty_like(row)
        best[0] = i * one
        best[1:] = np.minimum(row[1:] + one, row[:-1] + np.where(text == symbol, 0, one))
        row = np.minimum.accumulate(best - columns * one) + columns * one
    end = int(row.argmin())
    return int(row[end]) >> 32, int(row[end]) & (one - 1), end


class Items:
    """One block of the benchmark, ready for look-ups."""

    def __init__(self, names: list, texts: list[str], share: float = 0.25, recall: float = 0.97, agree: float = 0.6, sampled: int = 4, walks: int = 4):
        self.share = share
        parts = [(h, at) for _, h, at in _words(pa.array(texts, pa.string()))]
        sizes = np.concatenate([np.diff(at) for _, at in parts]) if parts else np.zeros(0, np.int64)
        self.symbols = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        starts = np.cumsum(sizes) - sizes
        self.names, self.sizes, self.starts = names, sizes, starts
        self._known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.present = np.zeros(1 << 24, bool)
        self.present[self.symbols >> np.uint64(40)] = True
        # near equal pieces; one of them has at most its share of an item's edits
        count = np.maximum(1, -(-sizes // PIECE))
        self.owner = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        self.offset = nth * sizes[self.owner] // np.maximum(1, count[self.owner])
        size = (nth + 1) * sizes[self.owner] // np.maximum(1, count[self.owner]) - self.offset
        start = starts[self.owner] + self.offset
        limit = sizes[self.owner] - self.offset
        edits = np.array([allowed(n, share) for n in sizes.tolist()], np.int64) // count
        self.classes, low = [], 1
        while len(size) and low <= size.max():
            high = max(low, int(low * 1.25))
            pieces = np.flatnonzero((size >= low) & (size <= high))
            if len(pieces):
                most = int(edits[self.owner[pieces]].max())
                self.classes.append(SizeClass(pieces.tolist(), start, size, limit, most, walks, tables_for(recall, agree, sampled), sampled, self.symbols))
            low = high + 1

    def find(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(text, item, edits, first word, last word)`` for the texts whose words ``h[at[i] : at[i + 1]]`` are given."""
        if not len(h) or not self.classes:
            return []
        known = np.concatenate(([0], np.cumsum(self.present[h >> np.uint64(40)])))
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        to_end = at[1:][text] - np.arange(len(h))
        regions: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for c in self.classes:
            grid = -(-np.diff(at) // c.stride)
            start = np.repeat(at[:-1] - c.stride * (np.cumsum(grid) - grid), grid) + c.stride * np.arange(grid.sum())
            start = start[known[np.minimum(start + c.sure, len(h))] - known[start] >= c.sure - c.edits]
            # what is foreign in a window of the item's size is an edit or behind the item's end
            seen = known[start + np.minimum(to_end[start], c.low)] - known[start]
            start = start[seen >= c.low - c.edits - c.stride + 1]
            for i in range(0, len(start), 100_000):
                some = start[i : i + 100_000]
                window, piece = c.look_up(h, some, to_end[some])
                item, offset = self.owner[piece], self.offset[piece]
                for w, k, o in zip(some[window].tolist(), item.tolist(), offset.tolist()):
                    t, n = int(text[w]), int(self.sizes[k])
                    pad = allowed(n, self.share) + c.stride
                    regions.setdefault((t, k), []).append((max(int(at[t]), w - o - pad), min(int(at[t + 1]), w - o + n + pad)))
        return [hit for (t, k), found in regions.items() if (hit := self._verify(t, k, found, h, at))]

    def _kinds(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The different words of an item in order, and how often it has each."""
        if k not in self._known:
            self._known[k] = np.unique(self.symbols[self.starts[k] : self.starts[k] + self.sizes[k]], return_counts=True)
        return self._known[k]

    def _verify(self, t: int, k: int, found: list, h: np.ndarray, at: np.ndarray):
        item = self.symbols[self.starts[k] : self.starts[k] + self.sizes[k]]
        most, best, (kinds, times) = allowed(len(item), self.share), None, self._kinds(k)
        merged: list[list[int]] = []
        for a, b in sorted(found):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            # words of the item that the region has at all, repeats included
            near = h[a:b]
            spot = np.searchsorted(kinds, near)
            spot[spot == len(kinds)] = 0
            seen = np.zeros(len(kinds), bool)
            seen[spot[kinds[spot] == near]] = True
            if int(times[seen].sum()) < len(item) - most:
                continue
            edits, first, end = align(item, h[a:b])
            if edits <= most and end > first and (best is None or edits < best[2]):
                best = (t, k, edits, int(a - at[t]) + first, int(a - at[t]) + end - 1)
        return best


def blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """The distinct rows of ``benchmark(item_id, text)`` in blocks of about ``size`` bytes; a null text is left out."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    count, total = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(1, min(count, -(-(total or 0) // size)))
    for part in range(parts if count else 0):
        got = sorted(rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield [r["item_id"] for r in got], [r["text"] for r in got]


def _words(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, _, data, offsets in words.slices(pc.utf8_lower(column)):
        yield (row, *words.hashed(data, offsets, words.BARE))


def _hits(items: Items, column) -> Iterator[tuple[int, list]]:
    for row, h, at in _words(column):
        yield row, items.find(h, at)


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_BYTES, **settings) -> DataFrame:
    """One row for each document and item whose passage it holds: ``distance`` in words, and the passage's first and last word.

    Words are lower-cased runs of letters and digits, signs do not count.  A passage is a run of the document's words
    at most a quarter of the item's words away (``share``); of several the nearest, then the first.

    - Null and empty texts hold nothing; an item without words is in no document.
    - Repeated rows of documents give repeated rows; repeated items count once.  Null ids are carried.
    - An empty benchmark, or no documents, gives no rows.  Only ``doc_id``, ``item_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def of(names: list, texts: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(Items(names, texts, **settings))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = [(ids[row + t], items.names[k], e, int(items.sizes[k]), a, b) for row, hits in _hits(items, batch.column(1)) for t, k, e, a, b in hits]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                columns = zip(*out) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "distance", "item_words", "first_word", "last_word"]
                )

        return rows.mapInArrow(run, SCHEMA)

    found = [of(*b) for b in blocks(benchmark, block)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def keep_clean(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_BYTES, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark.

    Several blocks are taken one after the other over written rows, so that a task holds one at a time.
    """
    spark = docs.sparkSession
    for i, (names, texts) in enumerate(blocks(benchmark, block)):
        if i:
            docs = written(docs, "clean")
        sent, at = spark.sparkContext.broadcast(Items(names, texts, **settings)), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, hits in _hits(sent.value, batch.column(at)):
                    clean[[row + hit[0] for hit in hits]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
