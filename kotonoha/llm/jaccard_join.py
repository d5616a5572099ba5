"""Exact Jaccard join of shingle sets in metric space.

Jaccard distance is a metric.  Sets link within ``r`` (0.25 of distance).

1. Equal sets are one set.
2. A set of which more than a quarter belongs to no other set links with
   nothing; most are found so by counting a part of all shingles.
3. Of the rest, sets that share a shingle of the first quarter, in one order for
   all sets with frequent shingles last, meet: every link does.  The smallest
   set of those that share a shingle is a pivot, and all that share shingles whose pivot it is are its region.
4. Inside a region, sets not yet within ``r`` of a pivot become pivots themselves, so that
   each set has a cell.  Two linked sets of different cells are, by the triangle inequality, each within ``2r``
   of the other's pivot: those are a cell's boundary, and are compared with the
   region if their cell and that one are not yet connected.
5. A region too large for a task is cut by some of its sets first.  A set within ``r`` of a pivot has the nearest as its home; the
   others are the rest.  A cell is its home sets and, as its boundary, what is within ``2r`` of its pivot: the rest, and
   sets whose home is a later pivot, so a pair of two homes meets in one cell.  Cells and the rest are regions again as long
   as they shrink to half; one that does not is compared by pairs of blocks, which is the most that is ever written.

Shingles travel as sorted arrays per task and shard, texts to their regions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kotonoha.functions.tables import written
from kotonoha.llm import words
from kotonoha.llm.components import components
from kotonoha.llm.counts import counted, even, gathered, shard_rows
from kotonoha.llm.rows import below

WORDS = 5
#: Links have ``100 * shared >= PERCENT * united``.
PERCENT = 75
#: Shingles in a shard.
SHARD_ENTRIES = 3_000_000
#: Size of a region that a task joins, in sets of up to so many bytes of text; longer ones count as several.
REGION_SETS, SET_BYTES = 4096, 6000
#: Pivots by which a large region is cut.
PIVOTS = 8
#: Frequent shingles moved to the end of the order: at most so many, each in more than so many sets.  They change the time only.
MOST_FREQUENT, FREQUENT = 1 << 18, 48


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many of its ``n`` shingles a set shares with any set it links with."""
    return -(-n * PERCENT // 100)


def set_hash(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set.  Sets are told apart by it: among 10^9 different sets all hashes differ with probability 0.97."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.mix(values + np.uint64(1)))))
    return words.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def set_table(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and the hash of the set, for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, values, at in words.sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), pa.array(np.diff(at)), pa.array(set_hash(values, at))], names=["doc_id", "n_shingles", "set"]
                )

    return _rows(docs).mapInArrow(run, "doc_id long, n_shingles long, set long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _press(token: np.ndarray, owner: np.ndarray, owners: np.ndarray) -> bytes:
    import zstandard

    used, place = np.unique(owner, return_inverse=True)
    gaps = np.diff(token, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    kind = "<u2" if len(used) <= 1 << 16 else "<u4"
    head = np.array([len(token), len(used), int(kind[-1])], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(
        head.tobytes() + owners[used].astype("<i8").tobytes() + np.ascontiguousarray(gaps).tobytes() + place.astype(kind).tobytes()
    )


def _unpress(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    content = zstandard.ZstdDecompressor().decompress(data)
    n, m, width = np.frombuffer(content, "<i8", 3).tolist()
    owners = np.frombuffer(content, "<i8", m, 24)
    gaps = np.ascontiguousarray(np.frombuffer(content, np.uint8, 8 * n, 24 + 8 * m).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), owners[np.frombuffer(content, f"<u{width}", n, 24 + 8 * m + 8 * n)]


def _postings(texts: DataFrame, pick: Callable, shards: int, part: float = 1.0, held_entries: int = 1_000_000) -> DataFrame:
    """``(shard, data)``: shingles of ``texts(text)`` with their sets' hashes, cut by ranges of shingles in the first ``part`` of all.

    ``pick(values, at, names)`` gives shingles and the rows they are of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([i * int(part * (1 << 64)) // shards for i in range(shards)], np.uint64)
        held: list[tuple] = []

        def passed() -> pa.RecordBatch:
            names, back = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
            base = np.concatenate(([0], np.cumsum([len(h[2]) for h in held])))
            token = np.concatenate([h[0] for h in held])
            owner = back[np.concatenate([h[1] + b for h, b in zip(held, base)])]
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            cut = np.append(np.searchsorted(token, bounds), len(token))
            full = [s for s in range(shards) if cut[s] < cut[s + 1]]
            data = [_press(token[cut[s] : cut[s + 1]], owner[cut[s] : cut[s + 1]], names) for s in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])

        for batch in batches:
            for _, _, values, at in words.sets(batch.column(0)):
                names = set_hash(values, at)
                token, owner = pick(values, at, names)
                if len(token):
                    held.append((token, owner, names))
                if sum(len(h[0]) for h in held) >= held_entries:
                    yield passed()
                    held = []
        if held:
            yield passed()

    return texts.select("text").mapInArrow(run, "shard int, data binary")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All distinct (shingle, set) of a shard in order of shingle, and each shingle's begin and number of sets."""
    parts = [_unpress(d) for d in table["data"].to_pylist()]
    token, owner = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((owner, token)) if len(parts) > 1 else np.arange(len(token))
    token, owner = token[order], owner[order]
    keep = np.ones(len(token), bool)
    keep[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[keep], owner[keep]
    begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    return token, owner, begin, np.diff(np.append(begin, len(token)))


def alone(texts: DataFrame, shards: int, part: float) -> tuple[DataFrame, DataFrame]:
    """``(set, single)``: how many of a set's shingles in the first ``part`` of all no other set has; and ``(shingle, n)``:
    frequent shingles with their number of sets.

    A shard's numbers go back to the sets as sorted arrays, cut by ranges of sets, and are added up there.
    """
    top = _top(part)

    def pick(values, at, names):
        owner = np.repeat(np.arange(len(names)), np.diff(at))
        # of copies in a batch one is enough
        first = np.zeros(len(names), bool)
        first[np.unique(names, return_index=True)[1]] = True
        keep = (values <= top) & first[owner]
        return values[keep], owner[keep]

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        token, owner, begin, n = _merged(table)
        single = shard_rows(*counted(np.sort(owner[begin[n == 1]].view(np.uint64))), bounds)
        often = n > FREQUENT
        return pa.concat_tables([
            pa.table({"range": single.column(0), "data": single.column(1), "shingle": pa.nulls(single.num_rows, pa.int64()), "n": pa.nulls(single.num_rows, pa.int64())}),
            pa.table({
                "range": pa.nulls(int(often.sum()), pa.int32()), "data": pa.nulls(int(often.sum()), pa.binary()),
                "shingle": token[begin[often]].view(np.int64), "n": n[often].astype(np.int64),
            }),
        ])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, single = gathered(table["data"].to_pylist())
        return pa.table({"set": names.view(np.int64), "single": single.astype(np.int64)})

    shards = max(1, math.ceil(shards * part))
    bounds = np.array(even(shards, 1 << 64), np.uint64)
    blobs = _postings(texts, pick, shards, part)
    found = written(blobs.groupBy("shard").applyInArrow(count, "range int, data binary, shingle long, n long"), "alone")
    single = found.filter("data is not null").select("range", "data").groupBy("range").applyInArrow(add, "set long, single long")
    return single, found.filter("data is null").select("shingle", "n")


def _top(part: float) -> np.uint64:
    return np.uint64(int(part * (1 << 64)) - 1)


def meetings(texts: DataFrame, frequent: np.ndarray, shards: int, part: float) -> DataFrame:
    """``(node, pivot)``: the sets of ``texts(text)`` that share a first shingle, with the set of smallest hash of those."""
    sent, top = texts.sparkSession.sparkContext.broadcast(np.sort(frequent)), _top(part)

    def pick(values, at, names):
        often = sent.value
        spot = np.searchsorted(often, values)
        spot[spot == len(often)] = 0
        hot = (often[spot] == values) if len(often) else np.zeros(len(values), bool)
        # counted and not frequent, not counted, frequent
        rank = np.where(hot, 2, np.where(values <= top, 0, 1)).astype(np.uint8)
        size = np.diff(at)
        owner = np.repeat(np.arange(len(size)), size)
        # values are in order already, and stay so among equals
        order = np.argsort(owner * 4 + rank, kind="stable")
        first = np.arange(len(values)) - at[:-1][owner] < (size - least_shared(size) + 1)[owner]
        return values[order][first], owner[first]

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        token, owner, begin, n = _merged(table)
        pivot = np.repeat(owner[begin], n)
        pair = np.unique(np.stack((owner, pivot))[:, np.repeat(n, n) > 1], axis=1)
        return pa.table({"node": pair[0], "pivot": pair[1]})

    return _postings(texts, pick, shards).groupBy("shard").applyInArrow(meet, "node long, pivot long").distinct()


class Region:
    """Sets with an index from shingles to sets."""

    def __init__(self, values: np.ndarray, at: np.ndarray):
        self.values, self.at, self.size = values, at, np.diff(at)
        owner = np.repeat(np.arange(len(self.size)), self.size)
        order = np.argsort(values, kind="stable")
        self.token, self.owner = values[order], owner[order]
        self.parent = np.arange(len(self.size))

    def shared(self, i: int) -> np.ndarray:
        """Shingles that each set shares with set ``i``."""
        mine = self.values[self.at[i] : self.at[i + 1]]
        a, b = np.searchsorted(self.token, mine), np.searchsorted(self.token, mine, "right")
        n = b - a
        hits = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[hits], minlength=len(self.size))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return int(i)

    def link(self, i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = self.root(i), self.root(j)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def join(self) -> np.ndarray:
        """The component of each set, as the smallest index in it."""
        n = len(self.size)
        placed, edge = np.zeros(n, bool), []
        for i in range(n):
            if placed[i]:
                continue
            both = self.shared(i)
            united = self.size[i] + self.size - both
            near = 100 * both >= PERCENT * united
            near[i] = True
            placed |= near
            self.link(i, np.flatnonzero(near))
            # within twice the distance: the boundary of this cell
            wide = np.flatnonzero((100 * both >= (2 * PERCENT - 100) * united) & (both > 0))
            edge.append((i, wide))
        done = np.zeros(n, bool)
        done[[i for i, _ in edge]] = True
        for i, wide in edge:
            for j in wide[~done[wide]].tolist():
                if self.root(j) == self.root(i):
                    continue
                both = self.shared(j)
                self.link(j, np.flatnonzero(100 * both >= PERCENT * (self.size[j] + self.size - both)))
                done[j] = True
        return np.array([self.root(i) for i in range(n)])


def _join_regions(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links enough to connect what is connected inside each region of ``table(region, node, text)``."""
    table = table.sort_by([("region", "ascending"), ("node", "ascending")])
    node, region = table["node"].to_numpy(), table["region"].combine_chunks().dictionary_encode()
    region = (region.combine_chunks() if isinstance(region, pa.ChunkedArray) else region).indices.to_numpy()
    parts = list(words.sets(table["text"]))
    values = np.concatenate([p[2] for p in parts])
    at = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[3]) for p in parts]))))
    begin = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
    a, b = [], []
    for i, j in zip(begin.tolist(), np.append(begin[1:], len(region)).tolist()):
        root = Region(values[at[i] : at[j]], at[i : j + 1] - at[i]).join()
        far = np.flatnonzero(root != np.arange(j - i))
        a.append(node[i + far])
        b.append(node[i + root[far]])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _cut_regions(members: DataFrame, texts: DataFrame, round_: int, pivots: int = PIVOTS) -> DataFrame:
    """How the sets of large regions ``members(region, node)`` lie to some of their sets: ``region, node, cell, pivot, home, near``.

    One row per set with its home (``cell`` is the pivot's place, or -1 for the rest), one for each cell whose boundary it
    is in, and ``near`` ones for every pivot that it links with.
    """
    place = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(round_)), "node"))
    # a few sets of smallest hash: what is ranked is cut by hash first
    counts = members.groupBy("region").agg(F.count("*").alias("total"))
    few = members.join(counts, "region").filter(below(F.xxhash64("node", F.lit(round_)), pivots, F.col("total"), 16))
    chosen = few.select("region", "node", place.alias("place")).filter(F.col("place") <= pivots).join(texts, "node")
    chosen = written(chosen.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("place", "node", "text"))).alias("pivots")), "pivots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            regions = np.array(batch.column(0).to_pylist())
            for region in np.unique(regions):
                mine = np.flatnonzero(regions == region)
                given = batch.column(3)[int(mine[0])].as_py()
                rows = batch.take(pa.array(mine))
                sets = [s for _, _, v, at in words.sets(pa.array([g["text"] for g in given])) for s in np.split(v, at[1:-1])]
                for row, stop, values, at in words.sets(rows.column(2)):
                    size, nodes = np.diff(at), rows.column(1).slice(row, stop - row).to_pylist()
                    both = np.array([np.diff(np.concatenate(([0], np.cumsum(np.isin(values, s))))[at]) for s in sets])
                    united = size + np.array([[len(s)] for s in sets]) - both
                    near, wide = 100 * both >= PERCENT * united, (100 * both >= (2 * PERCENT - 100) * united) & (both > 0)
                    home = np.where(near.any(0), np.argmax(np.where(near, both / united, -1), 0), -1)
                    for i, node in enumerate(nodes):
                        out.append((region, node, int(home[i]), given[home[i]]["node"] if home[i] >= 0 else None, True, False))
                        out += [(region, node, int(p), given[p]["node"], False, True) for p in np.flatnonzero(near[:, i]) if given[p]["node"] != node]
                        bound = np.flatnonzero(wide[:, i] & ((home[i] < 0) | (np.arange(len(given)) < home[i])))
                        out += [(region, node, int(p), given[p]["node"], False, False) for p in bound]
            columns = zip(*out) if out else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["region", "node", "cell", "pivot", "home", "near"])

    rows = members.select("region", "node").join(texts, "node").join(chosen, "region").select("region", "node", "text", "pivots")
    return rows.mapInArrow(run, "region string, node long, cell long, pivot long, home boolean, near boolean")


def _open(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    """The rows of ``members`` in regions that are not connected yet."""
    labels = components(_all(links))
    named = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = named.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("region")
    return members.join(written(open_, "open"), "region", "left_semi")


def _block_pairs(members: DataFrame, most: int) -> DataFrame:
    """``members(region, node, home, n, home_n, rows, homes)`` dealt to pairs of blocks of at most about ``most / 2``.

    Sets at home meet all others of the region; sets of the boundary meet those at home only.
    """
    count = lambda n: F.greatest(F.lit(2), F.ceil(F.col(n) * 2.5 / most)).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.col(n)).cast("int")
    dealt = members.withColumns({"blocks": count("n"), "home_blocks": F.greatest(F.lit(1), F.ceil(F.col("home_n") * 2.5 / most)).cast("int")})
    dealt = dealt.withColumns({"own": place("blocks"), "own_home": place("home_blocks")})
    name = lambda a, b, sign: F.concat_ws("/", "region", F.concat_ws(sign, a.cast("string"), b.cast("string")))
    whole = dealt.filter("homes = rows").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("other <> own")
    whole = whole.select(name(F.least("own", "other"), F.greatest("own", "other"), "-").alias("region"), "node")
    cells = dealt.filter("homes < rows")
    guests = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1)))
    hosts = cells.filter("home").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    guests, hosts = guests.select(name(F.col("other"), F.col("own"), "+").alias("region"), "node"), hosts.select(name(F.col("own_home"), F.col("other"), "+").alias("region"), "node")
    return whole.union(guests.union(hosts).distinct())


def region_links(members: DataFrame, texts: DataFrame, most: int = REGION_SETS) -> list[DataFrame]:
    """Tables of links ``(a, b)`` that connect what is connected in any region of ``members(region, node)``."""
    weights = texts.select("node", F.greatest(F.lit(1.0), F.octet_length("text") / SET_BYTES).alias("weight"))
    links, round_ = [], 0
    members = members.withColumn("last", F.lit(False))
    while True:
        heavy = written(members.join(weights, "node"), "weighed")
        # written, so that the rows of a large region can be split between tasks
        sizes = written(heavy.groupBy("region").agg(F.count("*").alias("rows"), F.sum("weight").alias("n")), "sizes")
        sized = written(heavy.drop("weight").join(sizes, "region"), "members")
        fits = (F.col("rows") > 1) & (F.col("last") | (F.col("n") <= most) | (F.col("rows") == 2))
        fit = sized.filter(fits)
        # small regions share a task: about ``most`` sets beside one region's
        tasks = max(1, math.ceil((fit.agg(F.sum(F.col("n") / F.col("rows"))).first()[0] or 0) / most))
        small = F.concat(F.lit("#"), F.pmod(F.xxhash64("region"), F.lit(tasks)).cast("string"))
        task = F.when(F.col("n") * 8 > most, F.col("region")).otherwise(small)
        fit = fit.select("region", "node", task.alias("task")).join(texts, "node").groupBy("task")
        links.append(written(fit.applyInArrow(_join_regions, "a long, b long"), "links"))
        large = written(sized.filter(~fits & (F.col("rows") > 1)).select("region", "node", "n"), "large")
        if large.isEmpty():
            return links
        apart = written(_cut_regions(large.select("region", "node"), texts, round_), "apart")
        links.append(apart.filter("near").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        # a pivot has met its whole region, and leaves that one only
        pivots = apart.filter("pivot is not null").select("region", F.col("pivot").alias("node")).distinct()
        cells = apart.filter("not near").select("region", "node", "cell", "home").join(pivots, ["region", "node"], "left_anti")
        cells = cells.join(weights, "node").join(large.select("region", "n").distinct(), "region")
        cells = written(cells.withColumn("part", F.concat_ws("/", "region", "cell")), "cells")
        # a cell without home sets has nothing left to compare; in the rest all are at home
        at_home = F.coalesce(F.sum(F.when(F.col("home"), F.col("weight"))), F.lit(0.0))
        parts = cells.groupBy("part").agg(
            F.sum("weight").alias("size"), at_home.alias("home_n"), F.count_if("home").alias("homes"), F.count("*").alias("rows"), F.max("n").alias("of"))
        parts = written(parts.filter("homes > 0"), "parts")
        fits = F.col("size") <= F.greatest(F.col("of") / 2, F.lit(float(most)))
        kept = cells.join(parts, "part").select(F.col("part").alias("region"), "node", "home", F.col("size").alias("n"), "home_n", "homes", "rows", fits.alias("shrinks"))
        kept = written(_open(kept, links), "kept")
        cut = kept.filter("shrinks").select("region", "node", F.lit(False).alias("last"))
        pairs = written(_block_pairs(kept.filter("not shrinks"), most).withColumn("last", F.lit(True)), "blocks")
        members = written(cut.union(_open(pairs, links).select("region", "node", "last")), "members")
        round_ += 1


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def join(docs: DataFrame, part: float = 0.5, shard_entries: int = SHARD_ENTRIES, most: int = REGION_SETS) -> DataFrame:
    """One row for every row of ``docs(doc_id, text)``: ``doc_id``, ``n_shingles``, ``component_id``, ``class_id``, ``class_size``.

    ``component_id`` is the smallest id reached by links, ``class_id`` the smallest id of the equal sets.

    - A set is the distinct five-word shingles of the whole text, words lower-cased (A-Z) and parted by white space; fewer words
      are one shingle.  A null or empty text has none and links with nothing: it is its own component.
    - Rows of one ``doc_id`` are one document with respect to links.  A row without an id links with nothing and has null ids.
    - Copies are in one class and not compared.  An empty table gives no rows.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    rows = _rows(docs).filter("doc_id is not null and text is not null")
    sets = written(set_table(docs), "sets")
    valid = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = written(valid.groupBy("set").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min("n_shingles").alias("n")), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    single, often = alone(rows, max(1, math.ceil(total[0] / shard_entries)), part)
    # bounded by MOST_FREQUENT, whatever the input
    frequent = often.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).select("shingle").collect()
    spare = F.expr(f"n - (n * {PERCENT} + 99) div 100")
    left = classes.join(single, "set", "left").filter(F.coalesce("single", F.lit(0)) <= spare)
    texts = written(_texts_of(rows, left.select(F.col("set").alias("node"), F.col("class_id").alias("doc_id"))), "texts")
    shards = max(1, math.ceil(texts.count() * total[0] / max(1, total[1]) / 3 / shard_entries))
    met = meetings(texts, np.array([r["shingle"] for r in frequent], np.int64).view(np.uint64), shards, part)
    members = met.select(F.col("pivot").cast("string").alias("region"), "node")
    # rows of one id with different sets
    several = valid.groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("b")).filter("a <> b")
    several = several.join(valid, "doc_id").select("a", F.col("set").alias("b"))
    labels = components(_all([*region_links(members, texts, most), several])).withColumnRenamed("node", "set")
    named = valid.join(labels, "set", "left").withColumn("component", F.coalesce("component", "set"))
    named = named.select("doc_id", "n_shingles", "set", "component")
    # written, so that the rows of a large component can be split between tasks
    smallest = written(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    linked = named.join(smallest, "component").join(classes.drop("n"), "set")
    out = ["doc_id", "n_shingles", "component_id", "class_id", "class_size"]
    lonely = sets.filter("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return linked.select(*out).union(lonely.select(*out))


def _texts_of(rows: DataFrame, left: DataFrame) -> DataFrame:
    """``(node, text)``: a text for each set in ``left(node, doc_id)``, from a document that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, values, at in words.sets(batch.column(1)):
                part = batch.slice(row, stop - row)
                yield part.filter(pa.array(set_hash(values, at) == part.column(0).to_numpy()))

    return rows.join(left, "doc_id").select("node", "text").mapInArrow(run, "node long, text string")
