"""Rows of bank documents read in one pass.

Spark's own JSON functions read a row three times and name the type of each of its items.  A document is read here
once, if it is plain: strict JSON whose numbers, strings and keys have one spelling.  The text of any other is handed back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa

_ENTRY = {"term": "kanji reading definitions rules popularity", "kanji": "kanji reading definitions rules onyomi kunyomi jlpt",
          "term_meta": "kanji reading definitions rules", "tag": "name category order_val notes popularity"}
_INTS = {"popularity", "order_val"}
FIELDS = {kind: ", ".join(f"{n}: {'int' if n in _INTS else 'string'}" for n in names.split()) for kind, names in _ENTRY.items()}
#: Rows of a batch that a task hands on.
OUT_ROWS = 20_000


class _NotPlain(Exception):
    pass


def _object(pairs: list) -> dict:
    made = dict(pairs)
    if len(made) < len(pairs):
        raise _NotPlain
    return made


class _Number(float):
    """A number with a point, by its shortest spelling."""


def _fraction(text: str) -> float:
    if not re.fullmatch(r"-?[0-9]{1,6}\.[0-9]{1,6}", text):
        raise _NotPlain
    made = _Number(text)
    if made and not 1e-3 <= abs(made):
        raise _NotPlain
    return made


def _whole(text: str) -> int:
    if len(text) > 18 or text == "-0":
        raise _NotPlain
    return int(text)


def _constant(text: str) -> None:
    raise _NotPlain


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_float=_fraction, parse_int=_whole, parse_constant=_constant)
_ENCODE = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
#: Escapes are spelled anew, and so are supplementary characters, in some places.
_UNUSUAL = re.compile("[\\\\\U00010000-\U0010ffff]")


def _spelled(item) -> str | None:
    """An item as text: strings as they are, others as JSON, none for null."""
    return item if type(item) is str else None if item is None else _ENCODE(item)


def _flat(row: list, i: int) -> str:
    if i >= len(row):
        return ""
    item = row[i]
    if type(item) is str:
        return item
    if type(item) is list:
        return " ".join(x for x in item if type(x) is str)
    return "" if item is None else _ENCODE(item)


def _text(row: list, i: int) -> str:
    return row[i] if i < len(row) and type(row[i]) is str else ""


def _integer(row: list, i: int) -> int:
    value = row[i] if i < len(row) and type(row[i]) is int else 0
    return (value + (1 << 31)) % (1 << 32) - (1 << 31)


def _json(row: list, i: int) -> str:
    return _ENCODE(row[i]) if i < len(row) else ""


def _term(row: list) -> tuple | None:
    if len(row) < 5 or type(row[0]) is not str or type(row[1]) is not str:
        return None
    second = _flat(row, 7)
    rules = f"{_flat(row, 2)} | {_flat(row, 3)}" + (f" | {second}" if second else "")
    return row[0], row[1], _json(row, 5), rules, _integer(row, 4)


def _kanji(row: list) -> tuple | None:
    if len(row) < 4:
        return None
    reading, more = _flat(row, 1), row[5] if len(row) > 5 else None
    level = more.get("jlpt") if type(more) is dict else None
    return _flat(row, 0), reading, _json(row, 4), "grade:" + _flat(row, 3), reading or None, _flat(row, 2) or None, (level or None) if type(level) is str else None


def _term_meta(row: list) -> tuple | None:
    if len(row) < 3 or _text(row, 1) != "pitch" or not _text(row, 0) or type(row[2]) is not dict:
        return None
    reading = row[2].get("reading")
    return (row[0], reading, _spelled(row[2]), "") if type(reading) is str and reading else None


def _tag(row: list) -> tuple | None:
    return (_text(row, 0), _text(row, 1), _integer(row, 2), _text(row, 3), _integer(row, 4)) if len(row) >= 5 else None


_ROW: dict[str, Callable[[list], tuple | None]] = {"term": _term, "kanji": _kanji, "term_meta": _term_meta, "tag": _tag}


def rows_of(text: str, kind: str) -> list[tuple[int, tuple]] | None:
    """``(row, cells)`` of a document's rows that count, or none if it is not plain."""
    if _UNUSUAL.search(text) or not text.startswith("["):
        return None
    try:
        rows, end = _DECODER.raw_decode(text)
    except (ValueError, RecursionError, _NotPlain):
        return None
    # a string is read again as a row
    if text[end:].strip(" \t\r\n") or any(type(r) is str for r in rows):
        return None
    made = _ROW[kind]
    return [(i, cells) for i, r in enumerate(rows) if type(r) is list and (cells := made(r)) is not None]


def reader(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents ``(archive, bank_ord, text)`` as rows ``(archive, bank_ord, row, cells, text)``; ``text`` where it was not plain."""
    names = _ENTRY[kind].split()
    types = [pa.int32() if n in _INTS else pa.string() for n in names]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            archives, numbers, texts = b.column("archive"), b.column("bank_ord"), b.column("text")
            of, at, cells, left = [], [], [], []

            def made() -> pa.RecordBatch:
                columns = list(zip(*(c or (None,) * len(names) for c in cells)))
                struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names, mask=pa.array([c is None for c in cells]))
                own = pa.array(of, pa.int64())
                out = pa.record_batch([archives.take(own), numbers.take(own), pa.array(at, pa.int32()), struct, pa.array(left, pa.string())], ["archive", "bank_ord", "row", "cells", "text"])
                for column in (of, at, cells, left):
                    column.clear()
                return out

            for i in range(len(texts)):
                text = texts[i].as_py()
                if text is None:
                    continue
                rows = rows_of(text, kind)
                if rows is None:
                    rows, rest = [(None, None)], text
                else:
                    rest = None
                for place, row in rows:
                    of.append(i)
                    at.append(place)
                    cells.append(row)
                    left.append(rest)
                if len(of) >= OUT_ROWS:
                    yield made()
            if of:
                yield made()

    return scan
