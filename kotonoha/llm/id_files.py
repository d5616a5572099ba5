"""Token ids in files that are read by document.

A file is a row of independent zstandard frames.  Each frame but the last holds
the ids of consecutive documents as little-endian unsigned 32-bit integers; the
last holds the index: the number of documents, then per document its id, a flag
for a null id and its number of ids.  A skippable frame at the end is the seek
table of the public seekable format: per frame its compressed size, its
decompressed size and a checksum (the low 32 bits of XXH64 of the content),
then the number of frames, a descriptor and a magic number.  Any zstandard
decoder reads the file from the front; ``read_documents`` reads the table and
the index and decompresses only the frames that hold the documents asked for.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kotonoha.functions.tables import written
from kotonoha.llm import files, tokens
from kotonoha.session import scratch_dir

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

#: Content of one frame, at least.
FRAME_BYTES = 1 << 20


class CorruptFrame(ValueError):
    """A frame's content does not have the checksum of the seek table."""


def frames(documents: Iterable[tuple[int | None, bytes]], level: int = 3, frame_bytes: int = FRAME_BYTES) -> Iterator[bytes]:
    """The bytes of a file, frame by frame, for documents ``(doc_id, ids)``."""
    import xxhash
    import zstandard

    press = zstandard.ZstdCompressor(level=level)
    table: list[bytes] = []
    names: list[int | None] = []
    sizes: list[int] = []

    def frame(content: bytes) -> bytes:
        pressed = press.compress(content)
        table.append(struct.pack("<III", len(pressed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        return pressed

    part, size = [], 0
    for doc_id, ids in documents:
        names.append(doc_id)
        sizes.append(len(ids) // 4)
        part.append(ids)
        size += len(ids)
        if size >= frame_bytes:
            yield frame(b"".join(part))
            part, size = [], 0
    if size:
        yield frame(b"".join(part))
    yield frame(
        struct.pack("<Q", len(names))
        + np.array([n or 0 for n in names], "<i8").tobytes()
        + np.array([n is None for n in names], "u1").tobytes()
        + np.array(sizes, "<u4").tobytes()
    )
    body = b"".join(table) + struct.pack("<IBI", len(table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
    yield struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_documents(uri: str, wanted: set | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """``(doc_id, ids before it in the file, ids)`` in the file's order; only the ``wanted`` documents, if given."""
    import xxhash
    import zstandard

    fs, path = files.open_fs(uri)
    with fs.open_input_file(path) as f:
        length = f.size()
        f.seek(length - 9)
        count, descriptor, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC or descriptor != WITH_CHECKSUMS:
            raise CorruptFrame(f"no seek table at the end of {uri}")
        f.seek(length - 9 - 12 * count)
        table = np.frombuffer(f.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        begins = np.concatenate(([0], np.cumsum(table[:, 0])))
        unpress = zstandard.ZstdDecompressor()

        def content(k: int) -> bytes:
            f.seek(int(begins[k]))
            got = unpress.decompress(f.read(int(table[k, 0])), max_output_size=max(1, int(table[k, 1])))
            if xxhash.xxh64_intdigest(got) & 0xFFFFFFFF != table[k, 2]:
                raise CorruptFrame(f"frame {k} of {uri}")
            return got

        index = content(count - 1)
        (n,) = struct.unpack_from("<Q", index)
        names = np.frombuffer(index, "<i8", n, 8)
        missing = np.frombuffer(index, "u1", n, 8 + 8 * n)
        sizes = np.frombuffer(index, "<u4", n, 8 + 9 * n).astype(np.int64)
        before = np.concatenate(([0], np.cumsum(sizes)))
        frame_begin = np.concatenate(([0], np.cumsum(table[: count - 1, 1] // 4)))
        open_, ids = -1, None
        for i in range(n):
            doc_id = None if missing[i] else int(names[i])
            if wanted is not None and doc_id not in wanted:
                continue
            if not sizes[i]:
                yield doc_id, int(before[i]), np.zeros(0, "<u4")
                continue
            k = int(np.searchsorted(frame_begin, before[i], "right")) - 1
            if k != open_:
                open_, ids = k, np.frombuffer(content(k), "<u4")
            at = before[i] - frame_begin[k]
            yield doc_id, int(before[i]), ids[at : at + sizes[i]]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in ascending order of ``doc_id``; returns the committed list of files.

    One row per file: ``path``, ``n_docs``, ``n_tokens``, ``n_bytes``, and ``before``, the ids in the files before it.

    Documents are dealt by ranges of ``(doc_id, hash of the text)``, so that copies of one id do not meet in one task.
    Null ids come first.  A null or empty text has the end id only.  Repeated rows are written once each.  An
    empty table gives no files.  Columns other than ``doc_id`` and ``text`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        seen = {"docs": 0, "ids": 0}

        def documents(first):
            for batch in ([first], batches):
                for b in batch:
                    names, texts = b.column(0).to_pylist(), b.column(1)
                    for row, stop in tokens.batches(texts):
                        ids, at = encoder.encode(texts.slice(row, stop - row))
                        for i in range(stop - row):
                            got = ids[at[i] : at[i + 1]].astype("<u4").tobytes() + end
                            seen["docs"] += 1
                            seen["ids"] += len(got) // 4
                            yield names[row + i], got

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        path = files.new_name(folder, f"ids-{part:06d}", ".zst")
        size = files.write_parts(path, frames(documents(first)))
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [seen["docs"]], "n_tokens": [seen["ids"]], "n_bytes": [size]})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    dealt = rows.withColumn("text_hash", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").drop("text_hash")
    listed = written(dealt.mapInArrow(run, "part long, path string, n_docs long, n_tokens long, n_bytes long"), "id-files")
    # one row per file
    return listed.withColumn("before", F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens"))


def read_ids(listed: DataFrame) -> DataFrame:
    """Every document of the listed files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, at, ids in read_documents(path):
                    rows.append((doc_id, before + at, len(ids), zlib.crc32(ids)))
                    if len(rows) == 50_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    # a task reads one file
    spread = listed.select("path", "before").repartitionByRange(max(1, listed.count()), "before")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


def store_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write, then read the files back; ``folder`` is a shared folder, a fresh one under ``spark.checkpoint.dir`` by default."""
    folder = folder or scratch_dir(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, tokenizer, end_id, folder))
