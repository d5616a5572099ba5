"""Interpolated modified Kneser-Ney word model, counted in Spark.

Words are lower-cased (A-Z) and parted by white space; every text ends with one
end token.  The model is a table of words and a table of word pairs, each
stored as sorted arrays of 64-bit keys with counts beside them, cut into shards
by key.  Workers map the files into memory and look up sorted keys.

- A word's key is its hash; its number is its place among all sorted hashes.
- A pair's key is ``number of the first << 32 | number of the second``, so the
  pairs of a context lie together and nothing collides.
- Texts begin after a start token that is a context only.

Counting goes through the shuffle as sorted arrays, one row per task and shard,
added up before they leave the task; a frequent word or pair is one entry there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.tables import written
from kotonoha.llm import files, words
from kotonoha.llm.counts import counted, even, gathered, press, shard_rows, unpress
from kotonoha.session import scratch_dir

END = np.uint64(0xE7037ED1A0B428DB)
#: Entries that a shard should hold.
SHARD_ENTRIES = 4_000_000
#: Words in memory before a task passes its counts on.
HELD = 3_000_000
_START, _UNKNOWN = 0xFFFFFFFF, 0xFFFFFFFE


def tokens(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(row, stop, token hashes, begins)`` with the end token after each text's words."""
    for row, stop, h, at in words.text_rows(column):
        n = stop - row
        out = np.empty(len(h) + n, np.uint64)
        to = at + np.arange(n + 1)
        is_end = np.zeros(len(out), bool)
        is_end[to[1:] - 1] = True
        out[is_end] = END
        out[~is_end] = h
        yield row, stop, out, to


def pair_bounds(shards: int, n_words: int, n_tokens: int, hot: list[tuple[int, int]]) -> list[int]:
    """First keys of the shards of pairs: even ranges of contexts, with ``hot`` ones ``(number, count)`` cut by their second word."""
    bounds = {i << 32 for i in even(shards, n_words + 1)} | {_START << 32}
    for number, count in hot:
        parts = -(-count * shards // n_tokens)
        bounds |= {(number << 32) + x for x in even(parts, n_words)} | {(number + 1) << 32}
    return sorted(bounds)


class Sorted:
    """Shards of one sorted table, mapped when first asked."""

    def __init__(self, shards: list[tuple[int, int, str]]):
        """``(first key, entries, path)`` in order of key; a file holds the keys, then the counts."""
        self.shards = shards
        self.firsts = np.array([s[0] for s in shards], np.uint64)
        self.before = np.concatenate(([0], np.cumsum([s[1] for s in shards]))).astype(np.int64)
        self._open: dict[int, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _shard(self, s: int):
        if s not in self._open:
            _, n, path = self.shards[s]
            data = files.mapped(path, np.uint8)
            self._open[s] = data[: 8 * n].view("<u8"), [data[8 * n + 8 * n * j : 16 * n + 8 * n * j].view("<u8") for j in range(len(data) // (8 * n) - 1)]
        return self._open[s]

    def find(self, keys: np.ndarray, columns: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """For sorted distinct ``keys``: places (-1 if absent), and a row of values for each of the first ``columns`` (0 if absent)."""
        place, value = np.full(len(keys), -1, np.int64), np.zeros((columns, len(keys)), np.int64)
        if not self.shards:
            return place, value
        cut = np.append(np.searchsorted(keys, self.firsts), len(keys))
        cut[0] = 0
        for s in np.flatnonzero(np.diff(cut)):
            mine = keys[cut[s] : cut[s + 1]]
            held, stored = self._shard(int(s))
            at = np.searchsorted(held, mine)
            at[at == len(held)] = 0
            hit = held[at] == mine
            part = np.flatnonzero(hit) + cut[s]
            place[part] = at[hit] + self.before[s]
            for j in range(columns):
                value[j, part] = stored[j][at[hit]]
        return place, value


@dataclass
class Model:
    """Tables of words (hash: count, and number of contexts before it), contexts and pairs, with the discounts."""

    words: Sorted
    #: By number: total count, and how many followers were seen once, twice and more often.
    contexts: Sorted
    pairs: Sorted
    #: The same four numbers of contexts whose pairs may lie in several shards.
    hot: dict[int, np.ndarray]
    n_tokens: int
    n_words: int
    n_pairs: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    #: Mass that the words' discounts free for words never seen.
    word_backoff: float


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and above, from how many entries have counts 1 to 4.

    Where a small table leaves one undefined or outside ``[0, count]`` it is moved to the nearest bound.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(float(i + 1), max(0.0, d)) for i, d in enumerate(raw))


def _totals(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def _count(docs: DataFrame, keys_of, first_keys: list[int]) -> DataFrame:
    """``(shard, data)`` rows of what ``keys_of`` finds in the texts, added up per task as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, held, size = np.array(first_keys, np.uint64), [], 0
        for batch in batches:
            for keys in keys_of(batch.column(0)):
                held.append(keys)
                size += len(keys)
                if size >= HELD:
                    yield shard_rows(*counted(np.concatenate(held)), bounds)
                    held, size = [], 0
        if size:
            yield shard_rows(*counted(np.concatenate(held)), bounds)

    return docs.select("text").mapInArrow(run, "shard int, data binary")


def _write(folder: str, stem: str, keys: np.ndarray, *columns: np.ndarray) -> str:
    path = files.new_name(folder, stem, ".u64")
    files.write_parts(path, [np.ascontiguousarray(c, "<u8") for c in (keys, *columns) if len(keys)])
    return path


def _listed(rows: list) -> list[tuple[int, int, str]]:
    return [(int(r["first"]) & 0xFFFFFFFFFFFFFFFF, r["n"], r["path"]) for r in sorted(rows, key=lambda r: r["shard"])]


def _one(values: list, kind: pa.DataType = pa.int64()) -> pa.Array:
    """A column of one row that holds a list."""
    return pa.array([values], pa.list_(kind))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def train(docs: DataFrame, folder: str | None = None, shard_entries: int = SHARD_ENTRIES) -> Model:
    """Count ``docs(text)`` and write the model's files to ``folder``, a shared one (a fresh one by default).

    The driver holds the lists of files and a few sums.  All words and pairs are kept.  Null and empty texts are one end token.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "language-model")
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    about = size[0] // 6 + size[1]
    word_shards = max(1, math.ceil(about / 5 / shard_entries))
    pair_shards = max(1, math.ceil(about * 2 / 3 / shard_entries))

    def word_keys(column):
        return (h for _, _, h, _ in tokens(column))

    def add_words(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts = gathered(table["data"].to_pylist())
        hot = np.flatnonzero(counts > size[0] // 6 // (4 * pair_shards) + 1000)
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "first": [_signed(int(keys[0]))], "n": [len(keys)],
            "path": [_write(folder, "words", keys, counts)], "total": [int(counts.sum())],
            "hot": _one(hot.tolist()), "hot_counts": _one(counts[hot].astype(np.int64).tolist()),
        })

    listed = "shard int, first long, n long, path string, total long"
    found = _count(docs, word_keys, even(word_shards, 1 << 64)).groupBy("shard").applyInArrow(add_words, listed + ", hot array<long>, hot_counts array<long>")
    found = sorted(written(found, "words").collect(), key=lambda r: r["shard"])
    vocabulary = Sorted(_listed(found))
    n_words, n_tokens = sum(r["n"] for r in found), sum(r["total"] for r in found)
    if n_words >= _UNKNOWN:
        raise ValueError("2^32 - 2 different words or more do not fit the keys of pairs")
    # at most a few words a shard can be this frequent
    hot = [(int(before) + n, c) for r, before in zip(found, vocabulary.before) for n, c in zip(r["hot"], r["hot_counts"])]
    hot_numbers = np.array(sorted(n for n, _ in hot) + [_START], np.uint64)

    def pair_keys(column):
        for _, _, h, at in tokens(column):
            yield pairs_of(vocabulary, h, at)[1]

    def add_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts = gathered(table["data"].to_pylist())
        first = keys >> np.uint64(32)
        begin = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        stats = np.stack([np.add.reduceat(x.astype(np.uint64), begin) for x in (counts, counts == 1, counts == 2, counts > 2)])
        seconds, before = counted(np.sort(keys & np.uint64(0xFFFFFFFF)))
        cut = np.flatnonzero(np.isin(first[begin], hot_numbers))
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int32()), "first": [_signed(int(keys[0]))], "n": [len(keys)],
            "path": [_write(folder, "pairs", keys, counts)], "total": [int(counts.sum())], "of_count": _one(_totals(counts)),
            "contexts_path": [_write(folder, "contexts", first[begin], *stats)], "contexts_n": [len(begin)], "contexts_first": [int(first[0])],
            "hot": _one([[int(first[begin[i]]), *stats[:, i].astype(np.int64).tolist()] for i in cut], pa.list_(pa.int64())), "before": [press(seconds, before)],
        })

    kinds = ", of_count array<long>, contexts_path string, contexts_n long, contexts_first long, hot array<array<long>>, before binary"
    pairs = _count(docs, pair_keys, pair_bounds(pair_shards, n_words, max(1, n_tokens), hot))
    paired = written(pairs.groupBy("shard").applyInArrow(add_pairs, listed + kinds), "pairs")
    rows = paired.drop("before").collect()
    of_count = np.sum([r["of_count"] for r in rows] or [[0] * 4], axis=0).tolist()
    of_hot: dict[int, np.ndarray] = {}
    for r in rows:
        for number, *stats in r["hot"]:
            of_hot[number] = of_hot.get(number, 0) + np.array(stats, np.int64)

    def cut_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = vocabulary.before[:-1].astype(np.uint64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield shard_rows(*unpress(data), bounds)

    def add_before(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """A word's number of different words before it, beside its count."""
        s = key[0].as_py()
        numbers, before = gathered(table["data"].to_pylist())
        keys, (counts, *_) = vocabulary._shard(s)
        full = np.zeros(len(keys), np.uint64)
        full[(numbers - np.uint64(vocabulary.before[s])).astype(np.int64)] = before
        return pa.table({
            "shard": pa.array([s], pa.int32()), "first": [_signed(int(keys[0]))], "n": [len(keys)],
            "path": [_write(folder, "vocabulary", keys, counts, full)], "total": [int(full.sum())], "of_count": _one(_totals(full)),
            "over_two": [int((full > 2).sum())],
        })

    cut = paired.select("before").mapInArrow(cut_before, "shard int, data binary").groupBy("shard")
    ended = written(cut.applyInArrow(add_before, listed + ", of_count array<long>, over_two long"), "vocabulary").collect()
    word_counts = np.sum([r["of_count"] for r in ended] or [[0] * 4], axis=0).tolist()
    n_pairs = sum(r["n"] for r in rows)
    d = discounts(*word_counts)
    freed = d[0] * word_counts[0] + d[1] * word_counts[1] + d[2] * sum(r["over_two"] for r in ended)
    contexts = [{"shard": r["shard"], "first": r["contexts_first"], "n": r["contexts_n"], "path": r["contexts_path"]} for r in rows]
    return Model(
        Sorted(_listed(ended)), Sorted(_listed(contexts)), Sorted(_listed(rows)), of_hot,
        n_tokens, n_words, n_pairs, discounts(*of_count), d, freed / n_pairs if n_pairs else 1.0,
    )


def pairs_of(vocabulary: Sorted, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens (-1 if unknown), and keys of each token with the one before it (start of text: the start token)."""
    unique, inverse = np.unique(h, return_inverse=True)
    number = vocabulary.find(unique)[0][inverse]
    return number, _keys(number, at)


def _keys(number: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.empty(len(number), np.int64)
    before[1:] = number[:-1]
    before[before < 0] = _UNKNOWN
    before[at[:-1]] = _START
    return (before.astype(np.uint64) << np.uint64(32)) | (number.astype(np.uint64) & np.uint64(0xFFFFFFFF))


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts."""
    return np.where(counts > 0, counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0.0)


def log10_probabilities(model: Model, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token given the one before it; and each token's count."""
    unique, inverse = np.unique(h, return_inverse=True)
    place, (count, before) = model.words.find(unique, 2)
    number, count, before = place[inverse], count[inverse], before[inverse]
    lower = _less(before, model.word_discounts) / max(1, model.n_pairs) + model.word_backoff / (model.n_words + 1)
    keys, back = np.unique(_keys(number, at), return_inverse=True)
    seen = model.pairs.find(keys, 1)[1][0]
    contexts, of = np.unique(keys >> np.uint64(32), return_inverse=True)
    stats = model.contexts.find(contexts, 4)[1]
    for i in np.flatnonzero(np.isin(contexts, np.array(list(model.hot), np.uint64))):
        stats[:, i] = model.hot[int(contexts[i])]
    total = np.maximum(stats[0], 1)
    share = np.where(stats[0] > 0, np.tensordot(np.array(model.discounts), stats[1:], 1) / total, 1.0)
    p = (_less(seen, model.discounts) / total[of])[back] + share[of][back] * lower
    return np.log10(p), count


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: numbers of tokens and known ones, the words' own log10 score and the model's.

    ``base_score`` adds 0.5 to each word's count; ``score`` is the model's log10 probability of the text, and
    ``perplexity`` is per token.  A null or empty text is one end token.  Repeated rows, null ids and long texts
    are scored like others.  With nothing learned each token is the one unknown word of the vocabulary.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = model.n_tokens + 0.5 * (model.n_words + 1)
        for batch in batches:
            for row, stop, h, at in tokens(batch.column(1)):
                p, count = log10_probabilities(model, h, at)
                n = np.diff(at)
                sums = [np.add.reduceat(x, at[:-1]) for x in ((count > 0).astype(np.int64), np.log10((count + 0.5) / floor), p)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), pa.array(10.0 ** (-sums[2] / n))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
                )

    kinds = "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double"
    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, kinds)
    return scored.withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
