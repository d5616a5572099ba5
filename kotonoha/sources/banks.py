"""Dictionary bank documents and their rows.

A document row is ``(archive, title, kind, bank_ord, position, text)``.
"""

from __future__ import annotations

import io
import json
import os
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions.tables import small_table, written
from kotonoha.operators import ordered
from kotonoha.sources import plain_rows

DOCUMENTS = "archive string, title string, kind string, bank_ord long, name string, text string"
KINDS = {"term_bank_": "term", "kanji_bank_": "kanji", "term_meta_bank_": "term_meta", "tag_bank_": "tag"}
ROWS_PER_BANK = 1 << 32


def bank_kind(name: Column) -> Column:
    kind = F.lit(None).cast("string")
    for prefix, label in KINDS.items():
        kind = F.when(name.startswith(prefix) & name.endswith(".json"), label).otherwise(kind)
    return kind


def bank_number(name: Column) -> Column:
    """The number after the last underscore, 0 where there is none."""
    return F.coalesce(F.regexp_extract(name, "(?:^|_)([0-9]+)\\.json$", 1).try_cast("bigint"), F.lit(0))


#: Compressed bytes of an archive that a task reads, about.
RANGE_BYTES = 8 << 20
_MEMBERS = "archive string, title string, position long, name string, offset long, packed long, size long, method int, crc long"


def _random_access(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of archives by their central directories, which stand at the ends of the files."""
    for pdf in batches:
        for path in pdf["path"]:
            with _random_access(path) as source, zipfile.ZipFile(source) as archive:
                title = os.path.splitext(os.path.basename(path))[0]
                index = next((m for m in archive.infolist() if m.filename == "index.json"), None)
                title = (_declared_title(archive.read(index)) if index else None) or title
                rows = [
                    (path, title, position, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC)
                    for position, m in enumerate(archive.infolist())
                ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEMBERS.split(", ")])


def member_text(source, offset: int, packed: int, method: int, crc: int) -> str:
    """A member of an open archive, read from where its own header begins."""
    source.seek(offset)
    head = source.read(30)
    if head[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile(f"no member at {offset}")
    names, extra = struct.unpack_from("<HH", head, 26)
    source.seek(offset + 30 + names + extra)
    content = source.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        content = zlib.decompress(content, -15)
    elif method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"compression {method}")
    if zlib.crc32(content) != crc:
        raise zipfile.BadZipFile(f"checksum of the member at {offset}")
    return content.decode("utf-8")


#: Characters of members that a task holds at a time, about.
HELD_CHARS = 1 << 20


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of listed members, whose other columns stay."""
    source, current = None, None
    names = [c.split()[0] for c in DOCUMENTS.split(", ")]
    try:
        for pdf in batches:
            held, size = [], 0
            for row in pdf.itertuples(index=False):
                if row.archive != current:
                    if source is not None:
                        source.close()
                    source, current = _random_access(row.archive), row.archive
                held.append((row.archive, row.title, row.kind, row.bank_ord, row.name, member_text(source, row.offset, row.packed, row.method, row.crc)))
                size += len(held[-1][-1])
                if size >= HELD_CHARS:
                    yield pd.DataFrame(held, columns=names)
                    held, size = [], 0
            if held:
                yield pd.DataFrame(held, columns=names)
    finally:
        if source is not None:
            source.close()


def _open_archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole archives, for stores that only Spark can open."""
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                title = os.path.splitext(os.path.basename(path))[0]
                if "index.json" in archive.namelist():
                    title = _declared_title(archive.read("index.json")) or title
                for position, member in enumerate(archive.infolist()):
                    if member.filename.endswith(".json") and member.filename != "index.json":
                        text = archive.read(member).decode("utf-8")
                        yield pd.DataFrame({"archive": [path], "position": [position], "name": [member.filename], "text": [text], "title": [title]})


def _declared_title(content: bytes) -> str | None:
    try:
        index = json.loads(content)
    except ValueError:
        return None
    title = index.get("title") if isinstance(index, dict) else None
    return title if isinstance(title, str) else None


def _children(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The archives and folders in each folder, by the names that Spark gives them; hidden ones are left out."""
    from pyarrow import fs

    for pdf in batches:
        for path in pdf["path"]:
            system, base = fs.FileSystem.from_uri(path)
            found = [
                (path.rstrip("/") + f.path[len(base.rstrip("/")) :], f.type == fs.FileType.Directory)
                for f in system.get_file_info(fs.FileSelector(base)) if f.base_name[:1] not in ("_", ".")
            ]
            yield pd.DataFrame([f for f in found if f[1] or f[0].endswith(".zip")], columns=["path", "folder"])


#: Folders below a folder of archives, at most.
MAX_DEPTH = 64


def _archive_paths(spark: SparkSession, path: str) -> DataFrame:
    """The archives in a folder and its sub-folders.  Tasks list them, so the driver's memory does not grow with their number."""
    qualified = spark._jvm.org.apache.hadoop.fs.Path(path)
    qualified = qualified.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(qualified).toString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, files = small_table(spark, [(qualified,)], "path string"), None
    for depth in range(MAX_DEPTH):
        found = written(folders.mapInPandas(_children, "path string, folder boolean"), "listed-archives")
        here = found.filter("not folder").select("path")
        files = here if files is None else files.unionByName(here)
        folders = found.filter("folder").select("path")
        if folders.isEmpty():
            return files.repartition(parts)
        folders = folders.repartition(parts)
    raise RuntimeError(f"folders of archives are nested more than {MAX_DEPTH} deep")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """The members of every archive under ``path``, by their central directories; nothing else is read."""
    return _archive_paths(spark, path).mapInPandas(_directories, _MEMBERS)


def _split_by_range(members: DataFrame, range_bytes: int) -> DataFrame:
    """Members dealt to tasks by ranges of their archives' bytes, in order of place."""
    dealt = members.withColumn("range", F.floor(F.col("offset") / F.lit(range_bytes)))
    # small archives share a task, a large one has as many as it has ranges
    total = dealt.agg(F.sum("packed")).first()[0] or 0
    return dealt.repartition(max(1, -(-total // range_bytes)), "archive", "range").sortWithinPartitions("archive", "offset")


def read_bank_documents(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The bank documents of every archive under ``path``.

    Directories are read first; then the members of an archive are read by as many tasks as it has ranges of bytes, one
    member at a time.  Entry banks are numbered across kinds, archive order breaking ties, tag banks after them.
    """
    numbered = lambda d: d.withColumn("kind", bank_kind(F.col("name"))).filter("kind is not null").withColumn("number", bank_number(F.col("name")))
    if _opened_by_workers(path):
        # numbered by their directory entries: texts are read once, and where they are wanted
        listed = written(archive_members(spark, path), "archive-members")
        return _split_by_range(_with_ord(numbered(listed)), range_bytes).mapInPandas(_members, DOCUMENTS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")
    members = files.mapInPandas(_open_archives, "archive string, position long, name string, text string, title string")
    return number_banks(numbered(members))


def _opened_by_workers(path: str) -> bool:
    """Whether a store can be opened at any byte by Python workers; others are read whole through Spark."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    except Exception:  # an unknown scheme, or one without its client library
        return False
    return True


def _with_ord(documents: DataFrame) -> DataFrame:
    late = (F.col("kind") == "tag").cast("int")
    bucket = F.struct(late.alias("late"), F.floor(F.col("number") / 1024).alias("n"))
    order = [late, F.col("number"), F.col("position")]
    return ordered.ranked(documents, ["archive"], bucket, order, "bank_ord")


def number_banks(documents: DataFrame) -> DataFrame:
    """Order the banks of each archive: entry banks before tag banks, by
    number, then by place in the archive."""
    return _with_ord(documents).select("archive", "title", "kind", "bank_ord", "name", "text")


# -- rows --------------------------------------------------------------------------


def _document_rows(documents: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind of bank: ``cells``, the columns of a row that was read at once, or its ``source`` text and a variant.

    Documents are read once in Python (``plain_rows.py``).  Those that it would not spell as Spark does keep their text; of these,
    ``source`` keeps key order and number spelling, and the variant is only used to tell types.
    """
    fields = plain_rows.FIELDS[kind]
    d = documents.filter(F.col("kind") == kind).select("archive", "bank_ord", "text")
    archive, number = (d.schema[c].dataType.simpleString() for c in ("archive", "bank_ord"))
    d = d.mapInArrow(plain_rows.reader(kind), f"archive {archive}, bank_ord {number}, row int, cells struct<{fields}>, text string")
    d = d.select("archive", "bank_ord", "row", "cells", F.posexplode_outer(F.from_json("text", "array<string>")).alias("_at", "source"))
    d = d.withColumn("row", F.coalesce("row", "_at")).drop("_at")
    # each step is generated, so that filters on what it makes do not work it out again
    once = lambda df, **made: df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))
    d = once(d, v=F.try_parse_json("source"), items=F.from_json("source", "array<string>"))
    kinds = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda p: F.schema_of_variant(p))
    return once(d, kinds=kinds).filter("cells is not null or kinds is not null")


def _cell(name: str, worked_out: Column) -> Column:
    """A column of a row that was read at once; for others it is worked out."""
    return F.when(F.col("cells").isNotNull(), F.col(f"cells.{name}")).otherwise(worked_out)


def _kept(rows: DataFrame, wanted: Column) -> DataFrame:
    return rows.filter(F.col("cells").isNotNull() | wanted)


def _kind_of(variant: Column, path: str) -> Column:
    """``STRING``, ``BIGINT``, ``ARRAY``, ``OBJECT``, ... or NULL where absent."""
    shape = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.regexp_extract(shape, "^([A-Z]+)", 1)


def _is(i: int, kind: str) -> Column:
    return F.coalesce(F.get("kinds", F.lit(i)).startswith(kind), F.lit(False))


def _item(i: int) -> Column:
    return F.get("items", F.lit(i))


def _flat(i: int) -> Column:
    """A string, or the strings of an array joined by a space."""
    parts = F.try_variant_get(F.col("v"), f"$[{i}]", "array<variant>")
    strings = F.filter(parts, lambda p: F.schema_of_variant(p) == "STRING")
    joined = F.array_join(F.transform(strings, lambda p: F.variant_get(p, "$", "string")), " ")
    return F.coalesce(F.when(_is(i, "ARRAY"), joined).otherwise(_item(i)), F.lit(""))


def _integer(i: int) -> Column:
    """A whole number; one that does not fit 32 bits wraps, as it does in the format's own readers."""
    value = F.coalesce(_item(i).try_cast("bigint"), F.lit(0))
    wrapped = F.pmod(F.pmod(value, F.lit(1 << 32)) + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.when(_is(i, "BIGINT"), wrapped.cast("int")).otherwise(0)


def _text(i: int) -> Column:
    return F.when(_is(i, "STRING"), _item(i)).otherwise("")


def _json(i: int) -> Column:
    """The item as JSON text; absent is the empty string."""
    quoted = F.to_json(F.array(_item(i)))
    quoted = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    value = F.when(_is(i, "STRING"), quoted).otherwise(F.coalesce(_item(i), F.lit("null")))
    return F.when(F.size("items") > i, value).otherwise("")


def _entries(rows: DataFrame, **columns: Column) -> DataFrame:
    blank = {c: F.lit(None).cast("string") for c in ("onyomi", "kunyomi", "jlpt")}
    cols = {"popularity": F.lit(0), **blank, **{n: _cell(n, c) for n, c in columns.items()}}
    row_id = F.col("bank_ord") * F.lit(ROWS_PER_BANK) + F.col("row")
    names = ("kanji", "reading", "definitions", "rules", "popularity", "onyomi", "kunyomi", "jlpt")
    return rows.select("archive", "bank_ord", row_id.alias("id"), *[cols[n].alias(n) for n in names])


def ingest_term_banks(documents: DataFrame) -> DataFrame:
    """Term bank rows; rows with fewer than five items or without string
    headword and reading are skipped."""
    rows = _kept(_document_rows(documents, "term"), (F.size("items") >= 5) & _is(0, "STRING") & _is(1, "STRING"))
    second = _flat(7)
    rules = F.concat(_flat(2), F.lit(" | "), _flat(3), F.when(second != "", F.concat(F.lit(" | "), second)).otherwise(""))
    return _entries(rows, kanji=_item(0), reading=_item(1), definitions=_json(5), rules=rules, popularity=_integer(4))


def ingest_kanji_banks(documents: DataFrame) -> DataFrame:
    """Kanji bank rows of at least four items."""
    rows = _kept(_document_rows(documents, "kanji"), F.size("items") >= 4)
    level = F.when(_kind_of(F.col("v"), "$[5].jlpt") == "STRING", F.try_variant_get(F.col("v"), "$[5].jlpt", "string"))
    empty = F.lit("")
    return _entries(
        rows, kanji=_flat(0), reading=_flat(1), definitions=_json(4), rules=F.concat(F.lit("grade:"), _flat(3)),
        onyomi=F.nullif(_flat(1), empty), kunyomi=F.nullif(_flat(2), empty), jlpt=F.nullif(level, empty),
    )


def ingest_term_meta_banks(documents: DataFrame) -> DataFrame:
    """Pitch rows with a term and a reading; the payload is kept as text."""
    reading = F.try_variant_get(F.col("v"), "$[2].reading", "string")
    wanted = (F.size("items") >= 3) & (_text(1) == "pitch") & (_text(0) != "") & (_kind_of(F.col("v"), "$[2].reading") == "STRING")
    return _entries(
        _kept(_document_rows(documents, "term_meta"), wanted & (reading != "")), kanji=_item(0), reading=reading, definitions=_item(2), rules=F.lit("")
    )


def ingest_tag_banks(documents: DataFrame) -> DataFrame:
    """Tag rows of at least five items."""
    rows = _kept(_document_rows(documents, "tag"), F.size("items") >= 5)
    cols = {"name": _text(0), "category": _text(1), "order_val": _integer(2), "notes": _text(3), "popularity": _integer(4)}
    return rows.select("archive", "bank_ord", "row", *[_cell(n, c).alias(n) for n, c in cols.items()])


def ingest_banks(documents: DataFrame) -> DataFrame:
    """All entry rows of S02 - S04."""
    return ingest_term_banks(documents).unionByName(ingest_kanji_banks(documents)).unionByName(ingest_term_meta_banks(documents))


def malformed_documents(documents: DataFrame) -> DataFrame:
    """Documents that are not a JSON array; the rest can be ingested."""
    # of a text that is JSON the first character tells whether it is an array
    is_array = F.col("text").rlike("^[ \\t\\r\\n]*\\[")
    return documents.filter(F.try_parse_json("text").isNull() | ~is_array).select("archive", "kind", "bank_ord", "name")


def import_report(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries per bank with running totals in bank order."""
    banks = documents.filter("kind <> 'tag'").select("archive", "bank_ord", "name", "kind")
    counts = entries.groupBy("archive", "bank_ord").agg(F.count(F.lit(1)).alias("n_entries"))
    d = banks.join(counts, ["archive", "bank_ord"], "left").na.fill({"n_entries": 0})
    total = banks.groupBy("archive").agg(F.count(F.lit(1)).alias("banks_total"))
    d = ordered.prefix_sums(
        d, ["archive"], "bank_ord", {"entries_imported": F.col("n_entries"), "banks_done": F.lit(1).cast("long")}, inclusive=True
    )
    return d.join(total, "archive").select(
        "archive", "bank_ord", "kind", "n_entries", "entries_imported", "banks_done", "banks_total"
    )
