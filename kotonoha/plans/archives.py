"""Zip archives made of bank documents, for reading them back."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd


def zipped(batches):
    """One archive per ``(title, name, text)`` row."""
    for pdf in batches:
        out = []
        for title, name, text in zip(pdf["title"], pdf["name"], pdf["text"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as archive:
                archive.writestr(name, text)
                archive.writestr("index.json", '{"title": "' + title + '"}')
                archive.writestr("tag_bank_1.json", "[]")
            out.append((name, buffer.getvalue()))
        yield pd.DataFrame(out, columns=["name", "content"])


#: Folders that many small archives are dealt to, so that none holds all of them.
FOLDERS = 1024


def landing(path: str):
    """Write ``(name, content)`` rows as files in folders of the shared folder ``path``."""

    def write(batches):
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        made = set()
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                folder = f"{base}/{zlib.crc32(name.encode()) % FOLDERS:03x}"
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                with target.open_output_stream(f"{folder}/{name}.zip") as out:
                    out.write(content)
            yield pdf[["name"]]

    return write


def _packed(content: bytes) -> bytes:
    deflate = zlib.compressobj(wbits=-15)
    return deflate.compress(content) + deflate.flush()


def deflated(batches):
    """``(title, name, text)`` rows as members ready for an archive."""
    for pdf in batches:
        content = [text.encode("utf-8") for text in pdf["text"]]
        yield pd.DataFrame({
            "title": pdf["title"], "name": pdf["name"], "packed": [_packed(c) for c in content], "size": [len(c) for c in content],
            "crc": [zlib.crc32(c) for c in content],
        })


MEMBERS = "title string, name string, packed binary, size long, crc long"


def _append(archive: zipfile.ZipFile, name: str, packed: bytes, size: int, crc: int) -> None:
    """A member that is deflated already."""
    info = zipfile.ZipInfo(name)
    info.compress_type, info.compress_size, info.file_size, info.CRC = zipfile.ZIP_DEFLATED, len(packed), size, crc
    info.header_offset = archive.fp.tell()
    archive.fp.write(info.FileHeader(False))
    archive.fp.write(packed)
    archive.filelist.append(info)
    archive.NameToInfo[name] = info
    archive.start_dir, archive._didModify = archive.fp.tell(), True


def landing_members(path: str):
    """Write members, which come by title and in order, as one archive a title; a task holds one batch of them."""

    def write(batches):
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        target.create_dir(base, recursive=True)
        title, out, archive = None, None, None

        def close():
            for name, text in (("index.json", '{"title": "' + title + '"}'), ("notes.txt", "not a bank")):
                _append(archive, name, _packed(text.encode("utf-8")), len(text.encode("utf-8")), zlib.crc32(text.encode("utf-8")))
            archive.close()
            out.close()

        for pdf in batches:
            done = []
            for row in pdf.itertuples(index=False):
                if row.title != title:
                    if archive is not None:
                        close()
                        done.append(title)
                    title, out = row.title, target.open_output_stream(f"{base}/{row.title}.zip")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                _append(archive, row.name, row.packed, row.size, row.crc)
            yield pd.DataFrame({"name": pd.Series(done, dtype=object)})
        if archive is not None:
            close()
            yield pd.DataFrame({"name": [title]})

    return write
