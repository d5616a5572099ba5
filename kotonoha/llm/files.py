"""Files of own format in the shared folder, written and read by tasks.

A task writes under a name that no other attempt uses and reports it in its
rows.  Only names that a committed table holds count, so a repeated or lost
task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def new_name(folder: str, stem: str, suffix: str) -> str:
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def write_parts(uri: str, parts) -> int:
    """Write byte parts one after the other; returns the length."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    size = 0
    with fs.open_output_stream(path, compression=None) as out:
        for part in parts:
            view = memoryview(part).cast("B")
            out.write(view)
            size += len(view)
    return size


def mapped(uri: str, dtype) -> np.ndarray:
    """The file as a read-only memory-mapped array.

    A file of a store without local paths is copied first; the copy's name is removed as soon as it is mapped.
    """
    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    own, name = tempfile.mkstemp()
    os.close(own)
    try:
        with fs.open_input_stream(path) as source, open(name, "wb") as target:
            while block := source.read(1 << 22):
                target.write(block)
        return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.zeros(0, dtype)
    finally:
        os.unlink(name)
