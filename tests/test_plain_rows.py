"""Plain documents are read in one pass, with the same rows as by Spark's JSON functions."""

import json
import random

import pyarrow as pa
from kotonoha.sources import banks, plain_rows

KINDS = {"term": banks.ingest_term_banks, "kanji": banks.ingest_kanji_banks, "term_meta": banks.ingest_term_meta_banks, "tag": banks.ingest_tag_banks}
ODD = [
    "[}", "", None, "{}", '"a"', "[1,2", '[["a","b","c","d","e"]] x', '["[1,2,3,4,5]"]', '[["a","b",["\\u00e9","\\n"],"\\"q\\"",1]]', "[['a','b','c','d',5]]",
    '[["a","b",1e3,12345678901234567890,1.00000000000000001,-0,-0.0,0.0001]]', '[["a","b",{"x":1,"x":2},"c",5]]', '[["a","b",NaN,"c",5]]', '  [["a","b","c","d",4] ]\n',
    '[\n["a","b",\t"c","d",4],\n["e", "f", {"g": [1, 2.50]}, [true, null, "h"], 7, {"jlpt": "N1"}, 0, ["i", 1, "j"]]]', '[["a\tb","b","c","d",4]]', "[]", "[[]]",
]


def _document(rng):
    def item(depth=0):
        kind = rng.randrange(9 if depth < 2 else 6)
        if kind < 3:
            return rng.choice(["", "か", "pitch", "x y", "𠮟'", "a/b< >\x7f"])
        if kind < 6:
            return rng.choice([0, -7, 3_000_000_000, 2.5, 120.25, -0.5, True, False, None])
        if kind < 7:
            return {rng.choice(["jlpt", "reading", "b"]): item(depth + 1), "z": item(depth + 1)}
        return [item(depth + 1) for _ in range(rng.randrange(4))]

    rows = [[item() for _ in range(rng.randrange(9))] if rng.random() < 0.9 else rng.choice([None, 3, {"a": [1]}, True]) for _ in range(rng.randrange(12))]
    rows = [["か", rng.choice(["r", "pitch"]), *r[2:]] if isinstance(r, list) and rng.random() < 0.5 else r for r in rows]
    rows.append(["か", "pitch", {"reading": "r", "z": item()}, 1, 2])
    return json.dumps(rows, ensure_ascii=False)


def test_rows_equal_those_of_sparks_own_functions(spark, monkeypatch):
    rng = random.Random(8)
    texts = [*ODD, *(_document(rng) for _ in range(150))]
    for kind, ingest in KINDS.items():
        docs = spark.createDataFrame([(f"a{i % 3}", kind, i, t) for i, t in enumerate(texts)], "archive string, kind string, bank_ord long, text string")
        got = sorted(map(repr, ingest(docs).collect()))
        with monkeypatch.context() as m:
            m.setattr(plain_rows, "reader", _unread(kind))
            want = sorted(map(repr, ingest(docs).collect()))
        assert len(got) > (100 if kind != "term_meta" else 3)
        assert got == want, kind


def _unread(kind):
    """A reader that hands every document back."""
    cells = pa.struct([(f.split(":")[0], pa.int32() if f.endswith("int") else pa.string()) for f in plain_rows.FIELDS[kind].split(", ")])

    def scan(batches):
        for b in batches:
            nothing = [pa.nulls(len(b), t) for t in (pa.int32(), cells)]
            yield pa.record_batch([b.column("archive"), b.column("bank_ord"), *nothing, b.column("text")], ["archive", "bank_ord", "row", "cells", "text"])

    return lambda _: scan


def test_most_documents_are_plain():
    assert plain_rows.rows_of('[["a","r",["n",3],"v5",4,{"b":1.50,"a":["x"]}],{"not":"a row"}]', "term") == [(0, ("a", "r", '{"b":1.5,"a":["x"]}', "n | v5", 4))]
    assert plain_rows.rows_of('["[1]"]', "tag") is None and plain_rows.rows_of('[["\\u3000"]]', "tag") is None
