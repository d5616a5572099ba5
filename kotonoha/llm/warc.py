"""WARC archives: written and read by tasks, one gzip member per record.

Rows with equal payloads of some length are one response and revisits of it.  A revisit record has the header of the HTTP
message only; the digest and length of the whole payload stand in its fields, as in any archive.

The reader goes through a file from front to back.  It decompresses member by member in small steps, frames a record by
its content length, hands on its block in pieces, and verifies the block's and the payload's digests, the length of the
block, and that a member ends where its record ends.  It holds a record's header and one piece at a time.

Files are written under names that no other attempt uses, and count if the returned list names them.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.tables import written
from kotonoha.llm import files
from kotonoha.session import scratch_dir

#: Payloads from so many bytes on are written once.
REVISIT_BYTES = 100
#: A file is closed after the record with which it has so many bytes.
FILE_BYTES = 1 << 30
PIECE = 1 << 18
#: Fixed value of the format: the profile of revisits by digest.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_IDS = uuid.UUID(int=0)


class CorruptRecord(ValueError):
    """A record that is cut short, framed wrongly, or without the digest it states."""


def record(fields: list[tuple[str, str]], block: list[bytes], level: int = 6) -> bytes:
    """A record as one gzip member; the block's length and digest are added to its fields."""
    inner = hashlib.sha256()
    for part in block:
        inner.update(part)
    fields = [*fields, ("WARC-Block-Digest", "sha256:" + inner.hexdigest()), ("Content-Length", str(sum(map(len, block))))]
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields) + "\r\n"
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([press.compress(head.encode()), *[press.compress(part) for part in block], press.compress(b"\r\n\r\n"), press.flush()])


def field_text(value: str | None) -> str:
    """A value that fits a header line: white space and control characters are written as escapes."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", value or "")


class _Record:
    """One record of an open file; ``pieces`` gives its block, and must be used up before the next record."""

    def __init__(self, fields: dict[str, str], pieces: Iterator[bytes]):
        self.fields, self.pieces = fields, pieces


def _header(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip(" \t")
        elif line:
            name, sign, value = line.partition(":")
            if not sign:
                raise CorruptRecord(f"a header line without a colon: {line[:80]!r}")
            name = name.strip(" \t").lower()
            out[name] = value.strip(" \t")
    return out


def records(stream, piece: int = PIECE) -> Iterator[_Record]:
    """The records of a file opened for reading, in order."""
    raw = b""

    def members() -> Iterator[Iterator[bytes]]:
        nonlocal raw
        while True:
            if not raw:
                raw = stream.read(piece)
            if not raw:
                return
            yield inflate()

    def inflate() -> Iterator[bytes]:
        nonlocal raw
        unpress = zlib.decompressobj(31)
        while not unpress.eof:
            if not raw:
                raw = stream.read(piece)
                if not raw:
                    raise CorruptRecord("a member is cut short")
            try:
                out = unpress.decompress(raw, piece)
            except zlib.error as wrong:
                raise CorruptRecord(str(wrong)) from wrong
            raw = unpress.unused_data if unpress.eof else unpress.unconsumed_tail
            if out:
                yield out

    for member in members():
        head, scanned = b"", 0
        while (end := head.find(b"\r\n\r\n", max(0, scanned - 3))) < 0:
            scanned = len(head)
            more = next(member, None)
            if more is None:
                raise CorruptRecord("a member without a whole header")
            head += more
        version, _, lines = head[:end].partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise CorruptRecord(f"no record begins with {version[:20]!r}")
        fields = _header(lines)
        stated = fields.get("content-length", "")
        if not re.fullmatch(r"[0-9]+", stated):
            raise CorruptRecord(f"content length {stated!r}")
        own = _Record(fields, _block(head[end + 4 :], member, int(stated)))
        yield own
        for _ in own.pieces:
            pass


def _block(first: bytes, member: Iterator[bytes], length: int) -> Iterator[bytes]:
    left, rest = length, first
    while left > len(rest):
        if rest:
            yield rest
            left -= len(rest)
        rest = next(member, None)
        if rest is None:
            raise CorruptRecord(f"a block has {length - left} of {length} bytes")
    if left:
        yield rest[:left]
    rest = rest[left:]
    for more in member:
        rest += more
        if len(rest) > 4:
            break
    if rest != b"\r\n\r\n":
        raise CorruptRecord(f"a record of {length} bytes is not followed by its end")


def _hasher(stated: str | None):
    """A hash and the digest it must have; none for an algorithm that is not known."""
    kind, _, value = (stated or "").partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "sha512", "md5") or not value:
        return None, None
    own = hashlib.new(kind)
    value = value.strip()
    if re.fullmatch(rf"[0-9a-fA-F]{{{own.digest_size * 2}}}", value):
        return own, bytes.fromhex(value)
    try:
        return own, base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError as wrong:
        raise CorruptRecord(f"digest {stated!r}") from wrong


class Payload:
    """Takes a record's block in pieces; gives what follows the HTTP header, if it has one, and verifies both digests."""

    def __init__(self, fields: dict[str, str]):
        self.fields, self.http = fields, None
        self.message = fields.get("content-type", "").replace(" ", "").lower().startswith("application/http")
        self.block, self.block_digest = _hasher(fields.get("warc-block-digest"))
        self.inner, self.inner_digest = _hasher(fields.get("warc-payload-digest"))
        self.revisit = fields.get("warc-type", "").lower() == "revisit"
        self.size, self.sha256, self.head = 0, hashlib.sha256(), b""

    def feed(self, piece: bytes) -> bytes:
        if self.block:
            self.block.update(piece)
        if self.message and self.http is None:
            self.head += piece
            end = self.head.find(b"\r\n\r\n")
            if end < 0:
                return b""
            piece, first = self.head[end + 4 :], self.head[:end]
            self.http, self.head = _header(first.partition(b"\r\n")[2]), b""
        self.size += len(piece)
        self.sha256.update(piece)
        if self.inner:
            self.inner.update(piece)
        return piece

    def close(self) -> None:
        if self.message and self.http is None:
            raise CorruptRecord("an HTTP message without a whole header")
        if self.block and self.block.digest() != self.block_digest:
            raise CorruptRecord(f"block digest of {self.fields.get('warc-record-id')}")
        # a revisit states the digest of a payload that it leaves out
        if self.inner and not self.revisit and self.inner.digest() != self.inner_digest:
            raise CorruptRecord(f"payload digest of {self.fields.get('warc-record-id')}")


def chosen(pages: DataFrame, key: str, payload: str, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with ``digest``, ``refers_to`` (the ``key`` of the response with the same payload) and ``revisit``.

    Of rows that share the smallest key as well, one is the response, whichever comes first as stored: such rows differ in
    neither key nor payload.  A null key is larger than any other; revisits of a null key refer to null.
    """
    rows = pages.withColumns({"digest": F.sha2(F.coalesce(F.col(payload).cast("binary"), F.lit(b"")), 256), "long": F.coalesce(F.octet_length(payload), F.lit(0)) >= least})
    # counted before the join, so a payload of many rows is one row of a digest
    same = rows.filter("long").groupBy("digest").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    same = written(same.drop("copies"), "warc-same")
    if same.isEmpty():
        return rows.withColumns({"refers_to": F.lit(None).cast(pages.schema[key].dataType), "revisit": F.lit(False)}).drop("long")
    found = rows.join(same.withColumn("shared", F.lit(True)), "digest", "left")
    shared, smallest = F.coalesce("shared", F.lit(False)) & F.col("long"), F.col(key).eqNullSafe(F.col("first_key"))
    found = found.withColumns({"candidate": shared & smallest, "revisit": shared & ~smallest})
    tied = written(found.filter("candidate").groupBy("digest").count().filter("count > 1").select("digest"), "warc-tied")
    if not tied.isEmpty():
        # one row of each tie: the rows are written, so that they have numbers that stay
        many = written(found.filter("candidate").join(tied, "digest", "left_semi").withColumn("number", F.monotonically_increasing_id()), "warc-ties")
        one = many.groupBy("digest").agg(F.min("number").alias("number")).withColumn("is_first", F.lit(True))
        many = many.join(one, ["digest", "number"], "left").withColumn("revisit", F.col("is_first").isNull()).drop("number", "is_first")
        others = found.filter("not candidate").unionByName(found.filter("candidate").join(tied, "digest", "left_anti"))
        found = others.unionByName(many.select(*others.columns))
    return found.withColumn("refers_to", F.when(F.col("revisit"), F.col("first_key"))).drop("long", "shared", "first_key", "candidate")


def write(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: datetime.datetime | None = None,
    least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, level: int = 6,
) -> DataFrame:
    """Write ``pages`` as archives in ``folder``; returns the committed list of files: ``path``, ``records``, ``bytes``.

    A record per row.  A null payload is an empty one, a null url an empty address, and null keys leave their field out.
    Empty partitions write no file, so an empty table gives no list.  Very long payloads pass through in one piece each.
    Other columns are not read.
    """
    at = (date or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int, int]] = []

        def members(rows, count):
            size = 0
            info = b"software: kotonoha\r\nformat: WARC File Format 1.1\r\n"
            first = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", at), ("Content-Type", "application/warc-fields")]
            member = record(first, [info], level)
            while True:
                size += len(member)
                yield member
                if count[0] and size >= file_bytes or (row := next(rows, None)) is None:
                    return
                count[0] += 1
                member = _page(row)

        def _page(row) -> bytes:
            own, address, body, digest, refers, revisit = row
            name = uuid.uuid5(_IDS, f"{own} {digest} {revisit}").urn
            fields = [
                ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", at),
                ("WARC-Target-URI", field_text(address)), ("Content-Type", "application/http;msgtype=response"),
                ("WARC-Payload-Digest", "sha256:" + digest),
            ]
            if own is not None:
                fields.append(("Page-Key", quote(own, safe="")))
            if revisit:
                first = uuid.uuid5(_IDS, f"{refers} {digest} False").urn
                fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{first}>")]
                if refers is not None:
                    fields.append(("Refers-To-Key", quote(refers, safe="")))
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
            return record(fields, [head] if revisit else [head, body], level)

        def rows():
            for b in batches:
                columns = [b.column(i) for i in range(6)]
                for i in range(b.num_rows):
                    yield tuple(c[i].as_py() for c in columns)

        stream = rows()
        ahead = next(stream, None)
        while ahead is not None:
            path = files.new_name(folder, "pages", ".warc.gz")
            count = [0]
            size = files.write_parts(path, members(itertools.chain([ahead], stream), count))
            done.append((path, count[0], size))
            ahead = next(stream, None)
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]})

    rows = chosen(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload")), "key", "payload", least)
    rows = rows.select(
        F.col("key").cast("string"), "url", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"), "digest",
        F.col("refers_to").cast("string"), "revisit",
    )
    return written(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


RECORD = "path string, record_id string, record_type string, uri string, date string, page_key string, refers_to_key string, payload_bytes long, payload_digest string"


def read(listed: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record but ``warcinfo`` of the files that ``listed(path)`` names, in the order of each file; a file is read by one task.

    ``payload_bytes`` and ``payload_digest`` (SHA-256 in hex) are those of the payload that is read; of a revisit, which has
    none, those it states: the length in the header of the HTTP message, and the digest if it is a SHA-256.  With
    ``payloads`` there is a column ``payload`` too, null for revisits.  A broken record raises ``CorruptRecord``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                fs, name = files.open_fs(path)
                with fs.open_input_stream(name, compression=None) as stream:
                    for own in records(stream):
                        fields = own.fields
                        kind = fields.get("warc-type", "").lower()
                        if kind == "warcinfo":
                            continue
                        inner, body = Payload(fields), []
                        for piece in own.pieces:
                            part = inner.feed(piece)
                            if payloads and part:
                                body.append(part)
                        inner.close()
                        size, digest = inner.size, inner.sha256.hexdigest()
                        if inner.revisit:
                            stated = (inner.http or {}).get("content-length", "")
                            size = int(stated) if re.fullmatch(r"[0-9]+", stated) else None
                            digest = inner.inner_digest.hex() if inner.inner and inner.inner.name == "sha256" else None
                        row = (
                            path, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"),
                            *[None if (k := fields.get(f)) is None else unquote(k) for f in ("page-key", "refers-to-key")], size, digest,
                        )
                        rows.append((*row, None if inner.revisit else b"".join(body)) if payloads else row)
                        held += inner.size if payloads else 0
                        if len(rows) == 10_000 or held > 16 << 20:
                            yield _batch(rows, payloads)
                            rows, held = [], 0
                yield _batch(rows, payloads)

    paths = listed.select("path")
    spread = paths.repartitionByRange(max(1, paths.count()), "path")
    return spread.mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    names = [f.split()[0] for f in RECORD.split(", ")] + (["payload"] if payloads else [])
    kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in names]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def archive(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write and read back; ``folder`` is a shared folder, a fresh one under ``spark.checkpoint.dir`` by default."""
    return read(write(pages, folder or scratch_dir(pages.sparkSession, "warc"), **options))

