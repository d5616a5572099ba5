"""Nearest neighbours by largest inner product, through stable projections.

Vectors get one more coordinate so that all have the largest length ``M``; then
``|q - x|^2 = |q|^2 + M^2 - 2 q.x`` and the largest inner product is the nearest
point.  ``dimensions`` Gaussian projections keep distances up to a chi-square
factor.  The projected points are cut into cells by a kd-tree over a bounded
sample, every cell is one file with a kd-tree of small leaves, and a query visits
cells and leaves by their distance in the projection, computing true inner
products.  It stops once a point of its current k-th distance would lie nearer than the
next leaf with probability ``certainty``; each true neighbour is missed with at most the rest.

All vectors are indexed.  Equal vectors are one point that keeps its ``k + 1``
smallest ids: no other can be among the ``k`` nearest of any query.  Tasks
hold one chunk of queries and map the files they visit; drivers hold the list of files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions.tables import written
from kotonoha.llm import files
from kotonoha.session import scratch_dir


def chi_square_bound(m: int, certainty: float) -> float:
    """The value below which a chi-square variable of even ``m`` degrees lies with this probability."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if below < certainty else (low, x)
    return high


def projection(n: int, m: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, n, m]).standard_normal((n + 1, m))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, longest * longest - np.einsum("ij,ij->i", x, x)))
    return np.column_stack((x, rest))


def kd_splits(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of the ``2 ** depth - 1`` nodes of a tree of halves, widest axis first, node ``i`` above ``2i + 1`` and ``2i + 2``."""
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = {0: points}
    for node in range(len(axis)):
        mine = parts.pop(node)
        if len(mine):
            axis[node] = np.argmax(mine.max(0) - mine.min(0))
            value[node] = np.median(mine[:, axis[node]])
        right = mine[:, axis[node]] >= value[node]
        parts[2 * node + 1], parts[2 * node + 2] = mine[~right], mine[right]
    return axis, value


def leaf_order(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row order of a kd-tree whose leaves hold at most ``size`` points, and where the leaves begin."""
    order, begins, stack = np.arange(len(points)), [], [(0, len(points))]
    while stack:
        a, b = stack.pop()
        if b - a <= size:
            begins.append(a)
            continue
        rows = order[a:b]
        mine = points[rows]
        column = mine[:, np.argmax(mine.max(0) - mine.min(0))]
        half = (b - a) // 2
        order[a:b] = rows[np.argpartition(column, half)]
        stack += [(a, a + half), (a + half, b)]
    return order, np.array(sorted(begins), np.int64)


def cells_of(points: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] >= value[node])
    return node - len(axis)


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame, length: int | None = None) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part: an id, no null or non-finite component, not all zero, and of ``length``,
    by default the most frequent one (of equally frequent ones the largest)."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    )
    if length is not None:
        return whole.filter(F.size("v") == length)
    lengths = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return whole.filter(F.size("v") == (lengths[0]["n"] if lengths else 0))


class Index:
    """The list of cell files, each with its box in the projection."""

    def __init__(self, rows: list, longest: float, project: np.ndarray):
        self.rows = [(r["path"], r["n"], r["leaves"], r["ids"]) for r in rows]
        m = project.shape[1]
        self.low = np.array([r["low"] for r in rows]).reshape(-1, m)
        self.high = np.array([r["high"] for r in rows]).reshape(-1, m)
        self.longest, self.project = longest, project
        self._open: dict[int, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def cell(self, c: int) -> tuple[np.ndarray, ...]:
        """Vectors in leaf order, begins of their ids, ids, and leaves' begins, lows and highs."""
        if c not in self._open:
            path, n, leaves, ids = self.rows[c]
            d, m = self.project.shape
            at, parts = 0, []
            data = files.mapped(path, np.uint8)
            for count, kind in ((n * (d - 1), "<f8"), (n + 1, "<i8"), (ids, "<i8"), (leaves + 1, "<i8"), (leaves * m, "<f8"), (leaves * m, "<f8")):
                parts.append(data[at : at + 8 * count].view(kind))
                at += 8 * count
            parts[0] = parts[0].reshape(n, d - 1)
            parts[4], parts[5] = parts[4].reshape(leaves, m), parts[5].reshape(leaves, m)
            self._open[c] = tuple(parts)
        return self._open[c]


def build(vectors: DataFrame, k: int, dimensions: int = 8, cell_rows: int = 65_536, leaf_rows: int = 64, most_sample: int = 131_072, folder: str | None = None) -> Index:
    """Index every usable row of ``vectors(vec_id, embedding)``.

    The cells come from at most ``most_sample`` points, those whose hash is smallest; what they hold is all points.
    """
    spark = vectors.sparkSession
    folder = folder or scratch_dir(spark, "neighbours")
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = usable(vectors).select("vec_id", "v").withColumn("place", place).filter(F.col("place") <= k + 1)
    points = written(points.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "points")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = points.agg(F.count("*").alias("n"), F.max(F.sqrt(squares)).alias("longest"), F.max(F.size("v")).alias("d")).first()
    if not facts["n"]:
        return Index([], 0.0, np.zeros((1, dimensions)))
    longest, project = facts["longest"], projection(facts["d"], dimensions)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = lifted(matrix(batch.column(0)), longest) @ project
            yield pa.RecordBatch.from_arrays([pa.array(list(p), pa.list_(pa.float64()))], names=["p"])

    depth = max(0, math.ceil(math.log2(max(1, facts["n"] / cell_rows))))
    depth = min(depth, int(math.log2(most_sample)) - 3)
    splits = (np.zeros(0, np.int64), np.zeros(0))
    if depth:
        sample = points.select("v", F.xxhash64("v").alias("place")).orderBy("place").limit(most_sample).select("v").mapInArrow(projected, "p array<double>").collect()
        splits = kd_splits(np.array([r["p"] for r in sample]), depth)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells_of(lifted(matrix(batch.column(0)), longest) @ project, *splits)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], names=["cell", "v", "ids"])

    def store(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = matrix(table["v"].combine_chunks() if table["v"].num_chunks != 1 else table["v"].chunk(0))
        p = lifted(x, longest) @ project
        order, begins = leaf_order(p, leaf_rows)
        ids = [table["ids"][int(i)].as_py() for i in order]
        low, high = np.minimum.reduceat(p[order], begins), np.maximum.reduceat(p[order], begins)
        path, flat = files.new_name(folder, "cell", ".f64"), np.array([i for l in ids for i in l], "<i8")
        to = np.concatenate(([0], np.cumsum([len(l) for l in ids]))).astype("<i8")
        files.write_parts(path, [np.ascontiguousarray(x[order], "<f8"), to, flat, np.append(begins, len(x)).astype("<i8"), np.ascontiguousarray(low, "<f8"), np.ascontiguousarray(high, "<f8")])
        box = pa.list_(pa.float64())
        return pa.table({
            "path": [path], "n": pa.array([len(x)]), "leaves": pa.array([len(begins)]), "ids": pa.array([len(flat)]),
            "low": pa.array([low.min(0).tolist()], box), "high": pa.array([high.max(0).tolist()], box),
        })

    cells = points.select("v", "ids").mapInArrow(dealt, "cell long, v array<double>, ids array<long>")
    listed = cells.groupBy("cell").applyInArrow(store, "path string, n long, leaves long, ids long, low array<double>, high array<double>")
    return Index(written(listed, "cells").collect(), longest, project)


def _apart(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point from boxes."""
    d = np.maximum(0.0, np.maximum(low - p, p - high))
    return np.einsum("ij,ij->i", d, d)


class _Nearest:
    """The best points met so far: inner products and ids."""

    def __init__(self, own: int, k: int):
        self.own, self.k = own, k
        self.score, self.vec = np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, at: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.bound()) if len(self.score) >= self.k else np.arange(len(scores))
        if len(good) > 4 * self.k:
            # a point has an id besides the query's, but for the query's own
            least = np.partition(scores[good], len(good) - self.k - 1)[len(good) - self.k - 1]
            good = good[scores[good] >= least]
        if not len(good):
            return
        n = (at[rows[good] + 1] - at[rows[good]])
        vec = np.concatenate([ids[at[r] : at[r + 1]] for r in rows[good]])
        score = np.repeat(scores[good], n)
        other = vec != self.own
        score, vec = np.append(self.score, score[other]), np.append(self.vec, vec[other])
        order = np.lexsort((vec, -score))[: self.k]
        self.score, self.vec = score[order], vec[order]

    def bound(self) -> float:
        return self.score[-1] if len(self.score) >= self.k else -np.inf


def search_one(index: Index, own: int, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    p = np.append(q, 0.0) @ index.project
    base, found = q @ q + index.longest**2, _Nearest(own, k)

    def over(apart: float) -> bool:
        return len(found.score) >= k and apart >= factor * max(0.0, base - 2 * found.bound())

    cells = _apart(p, index.low, index.high)
    for c in np.argsort(cells, kind="stable"):
        if over(cells[c]):
            break
        x, at, ids, begins, low, high = index.cell(int(c))
        leaves = _apart(p, low, high)
        order = np.argsort(leaves, kind="stable")
        i, step = 0, 8
        while i < len(order) and not over(leaves[order[i]]):
            some = order[i : i + step]
            rows = np.concatenate([np.arange(begins[j], begins[j + 1]) for j in some])
            found.add(x[rows] @ q, at, rows, ids)
            i, step = i + step, min(2 * step, 256)
    return found.vec, found.score


def search(queries: DataFrame, index: Index, k: int = 20, certainty: float = 0.95, chunk: int = 256) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the nearest found for each usable row of ``queries(vec_id, embedding)``.

    - Ties go to the smaller ``vec_id``.  Fewer candidates than ``k`` give fewer rows, an empty index none.
    - Vectors that are null, all zero, or hold null or non-finite components take no part, nor do rows without an id.
    - Queries of another length than the index's vectors take no part, however many they are.
    - Repeated rows are searched once; an id with several vectors has a list for each of them.
    - Columns other than ``vec_id`` and ``embedding`` are not read.
    """
    spark = queries.sparkSession
    kinds = "query_id long, rank int, vec_id long, score double"
    if not index.rows:
        return spark.createDataFrame([], kinds)
    sent, factor = spark.sparkContext.broadcast(index), chi_square_bound(index.project.shape[1], certainty)
    d = index.project.shape[0] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own, q in zip(batch.column(0).to_pylist(), matrix(batch.column(1))):
                vec, score = search_one(sent.value, own, q, k, factor)
                out.append((np.full(len(vec), own), np.arange(1, len(vec) + 1, dtype=np.int32), vec, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "rank", "vec_id", "score"])

    asked = usable(queries, d).distinct()
    asked = written(asked, "queries")
    parts = max(1, math.ceil(asked.count() / chunk))
    return asked.repartition(parts, "vec_id").mapInArrow(run, kinds)
