import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from helpers import DOCS, odd_docs
from kotonoha.llm import id_files, packing, tokens
from tokenizers import Tokenizer


def plain_ids(docs, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [(r["doc_id"], np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4")) for r in docs.collect()]


def test_pieces_hold_each_id_once(spark):
    docs = odd_docs(spark)
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=4).collect()
    ids = plain_ids(docs, "byte_bpe_50k.json", 0)
    assert sum(r["length"] for r in rows) == sum(len(i) for _, i in ids)
    by_id = {n: i for n, i in ids if n is not None}
    for r in rows:
        if r["doc_id"] is not None:
            own = by_id[r["doc_id"]]
            assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]])
    covered = defaultdict(list)
    for r in rows:
        covered[r["doc_id"]].append((r["start"], r["length"]))
    for n, own in by_id.items():
        copies = sum(1 for m, _ in ids if m == n)
        assert sum(length for _, length in covered[n]) == copies * len(own)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_the_unchanged_tokenizer(name):
    import pyarrow as pa

    end, begin = "<|endoftext|>", "<|startoftext|>"
    texts = [
        f"end of file {end} next", end, end + end, f"a  {end}  b", f"a\n\n{end}\n b", f"x.{end}'s", f"it'{end}s", f"é{end}\u0338é",
        "<|endof", "text|> cut by rows", f"<|{end}|>", end.upper(), f"{begin} One {end}", f"<|endoftext{end}", "", None, " ", "no literal", f"  {end}",
    ]
    ids, at = tokens.Encoder(public_tokenizers.path(name)).encode(pa.array(texts))
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 400, 2000)
    places = packing.places_for(int(lengths.sum()), 1024)
    cost = np.zeros(len(places))
    got = defaultdict(int)
    for item, at, n, place in packing.assign(lengths, places, 1.0, 1 / 1024):
        cost[place] += n + n * n / 1024
        got[item] += n
    assert all(got[i] == n for i, n in enumerate(lengths))
    full = cost[places == 1024]
    assert full.std() / full.mean() < 0.1


def test_pack_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_files_give_back_what_was_written(spark, tmp_path):
    docs = odd_docs(spark)
    rows = id_files.store_ids(docs, public_tokenizers.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/ids").orderBy("start").collect()
    plain = sorted(plain_ids(docs, "word_bpe_49k.json", 2), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in rows] == [n for n, _ in plain]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((n or -1, len(i), zlib.crc32(i)) for n, i in plain)
    empty = id_files.store_ids(spark.createDataFrame([], DOCS), public_tokenizers.path("word_bpe_49k.json"), 2, f"file://{tmp_path}/none")
    assert empty.count() == 0


def test_only_frames_asked_for_are_read(tmp_path):
    documents = [(i, np.full(10, i, "<u4").tobytes()) for i in range(100)]
    path = tmp_path / "x.zst"
    parts = list(id_files.frames(documents, frame_bytes=200))
    path.write_bytes(b"".join(parts))
    got = list(id_files.read_documents(str(path), {17, 42}))
    assert [(n, at, ids.tolist()) for n, at, ids in got] == [(17, 170, [17] * 10), (42, 420, [42] * 10)]
    # a broken frame is seen when it is read, and does not disturb others
    data = bytearray(path.read_bytes())
    data[len(parts[0]) - 1] ^= 0xFF
    path.write_bytes(bytes(data))
    assert [n for n, _, _ in id_files.read_documents(str(path), {42})] == [42]
    with pytest.raises(Exception):
        list(id_files.read_documents(str(path), {0}))


def test_any_decoder_reads_the_frames(tmp_path):
    import io

    import zstandard

    data = b"".join(id_files.frames([(1, b"abcd"), (None, b"efgh"), (2, b"")]))
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as reader:
        assert reader.read().startswith(b"abcdefgh")
