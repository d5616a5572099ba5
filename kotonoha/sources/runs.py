"""Tables that grow batch by batch and stay cheap to read.

A store is a list of runs.  A batch adds a run; runs that are not more than ``RATIO`` times as large as what is added after them
are merged with it.  Runs so grow geometrically: there are about as many as the logarithm of the rows, and a row is
rewritten about as often.

Every batch writes a manifest, the list of runs as of that batch, after its runs are in place.  It starts from the manifest before
it, whatever came later, so a batch that is replayed after a failure gives the same store again.  Readers take the last
manifest, or that of an earlier batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions.tables import small_table

RATIO = 2
_MANIFEST = "place int, path string, n long, first_batch long, last_batch long"


@dataclass(frozen=True)
class Run:
    path: str
    rows: int
    first_batch: int
    last_batch: int


class RunStore:
    """``merge`` brings the rows of several runs down to those that count, and may be applied to any of its own results.

    ``partitions`` are columns that runs are stored by; ``order`` sorts rows inside files, so that readers of few keys skip most of them.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], partitions: Sequence[str] = (), order: Sequence[str] = (),
    ):
        self.spark, self.path, self.schema, self.merge = spark, path, schema, merge
        self.partitions, self.order = list(partitions), list(order)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def batches(self) -> list[int]:
        """Batches whose manifest is complete."""
        found = sorted(int(n.partition("=")[2]) for n in self._names(f"{self.path}/manifest") if n.startswith("batch="))
        return [b for b in found if "_SUCCESS" in self._names(f"{self.path}/manifest/batch={b}")]

    def runs(self, batch: int | None = None) -> list[Run]:
        """The runs as of ``batch`` (the last one by default), oldest first."""
        upto = [b for b in self.batches() if batch is None or b <= batch]
        if not upto:
            return []
        # a few rows: as many as there are runs
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/batch={upto[-1]}").collect()
        return [Run(r["path"], r["n"], r["first_batch"], r["last_batch"]) for r in sorted(rows, key=lambda r: r["place"])]

    def _read(self, runs: Sequence[Run]) -> DataFrame:
        frames = [self.spark.read.schema(self.schema).parquet(r.path) for r in runs]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], self.schema)

    def stored(self, batch: int | None = None) -> DataFrame:
        """All rows of the runs, not merged yet; filters reach the files."""
        return self._read(self.runs(batch))

    def read(self, batch: int | None = None) -> DataFrame:
        return self.merge(self.stored(batch))

    def _write(self, rows: DataFrame, path: str) -> int:
        columns = [f.split()[0] for f in self.schema.split(", ")]
        rows = rows.select(*columns)
        if self.partitions or self.order:
            rows = rows.repartitionByRange(*self.partitions, *self.order).sortWithinPartitions(*self.partitions, *self.order)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*self.partitions) if self.partitions else writer).parquet(path)
        return self.spark.read.schema(self.schema).parquet(path).count()

    def add(self, batch: int, rows: DataFrame) -> DataFrame:
        """Add ``rows`` as those of ``batch``; returns them as stored."""
        own = f"{self.path}/runs/{batch}-new"
        n = self._write(self.merge(rows), own)
        runs, new = self.runs(batch - 1), Run(own, n, batch, batch)
        joined = []
        size = n
        while runs and runs[-1].rows <= RATIO * size:
            joined.insert(0, runs.pop())
            size += joined[0].rows
        last = new
        if joined:
            path = f"{self.path}/runs/{batch}-merged"
            last = Run(path, self._write(self.merge(self._read([*joined, new])), path), joined[0].first_batch, batch)
        listed = [(i, r.path, r.rows, r.first_batch, r.last_batch) for i, r in enumerate([*runs, last])]
        small_table(self.spark, listed, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        return self._read([new])

    def remove_unused(self, keep: int = 2) -> list[str]:
        """Delete the runs and manifests that none of the last ``keep`` batches needs; a replay needs one batch before its own."""
        kept = self.batches()[-keep:]
        named = {r.path.rsplit("/", 1)[1] for b in kept for r in self.runs(b)} | {f"{b}-new" for b in kept}
        gone = [f"runs/{n}" for n in self._names(f"{self.path}/runs") if n not in named]
        gone += [f"manifest/{n}" for n in self._names(f"{self.path}/manifest") if n.startswith("batch=") and kept and int(n.partition("=")[2]) < kept[0]]
        for name in gone:
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)
        return gone


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal ``keys``, the one that is largest by ``order``."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    last = F.max(F.struct(*order, *rest)).alias("_l")
    return rows.groupBy(*keys).agg(last).select(*keys, "_l.*")
