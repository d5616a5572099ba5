import gzip
import hashlib
import io
import random
import re

import pytest
from kotonoha.llm import merkle, warc
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string, digest string, key string, shared boolean, number long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "k", True, 3) for r in rows], PAGES)


def plain_records(rows):
    """The response of equal payloads of 100 bytes or more is the row of smallest id; of equal ids any one."""
    first, out = {}, []
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for own, _, html in rows:
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        revisit = len(body) >= 100 and digest in first
        out.append((own, len(body), digest, "revisit" if revisit else "response", first[digest] if revisit else None))
        first.setdefault(digest, own)
    return sorted(out, key=repr)


def odd_pages():
    rng = random.Random(3)
    same, other = "<p>" + "é" * 60, "b" * 99
    rows = [(7, "http://a/ b\r\nX: y", same), (3, "http://a/é", same), (3, "http://a/2", same), (None, None, same), (9, "u" * 200_000, same)]
    rows += [(11, "http://s", other), (10, "http://s", other), (12, None, None), (13, "", ""), (None, "n", "c" * 100), (None, "n", "c" * 100)]
    rows += [(20, "http://l", "".join(rng.choice("abcdef \n") for _ in range(3_000_000))), (21, "http://z", "x" * 5_000_000), (22, "", "x" * 5_000_000)]
    rows += [(100 + i, f"http://h/{i}", f"page {i} " * 30) for i in range(40)] * 2
    return rows


def test_archives_give_back_what_was_written(spark, tmp_path):
    rows = odd_pages()
    df = pages(spark, rows).repartition(3)
    listed = warc.write(df, f"file://{tmp_path}/w", file_bytes=20_000)
    files = listed.collect()
    assert sum(r["records"] for r in files) == len(rows) and len(files) > 3
    got = warc.read(listed, payloads=True).collect()
    out = sorted(
        [(None if (k := r["page_key"]) is None else int(k), r["payload_bytes"], r["payload_digest"], r["record_type"],
          None if (k := r["refers_to_key"]) is None else int(k)) for r in got], key=repr)
    assert out == plain_records(rows)
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["payload"] is None
    assert {r["uri"] for r in got} >= {"http://a/%20b%0D%0AX:%20y", "http://a/é", "", "u" * 200_000}


def test_archives_of_nothing(spark, tmp_path):
    assert warc.archive(pages(spark, []), f"file://{tmp_path}/w").count() == 0


def test_keys_may_be_any_text(spark, tmp_path):
    keys = ["a b", "100%", "é\r\nX: 1", "", None]
    df = spark.createDataFrame([(k, "http://a", f"{k}" * 3) for k in keys], "page_id string, url string, html string")
    got = warc.archive(df, f"file://{tmp_path}/w").collect()
    assert sorted(map(repr, (r["page_key"] for r in got))) == sorted(map(repr, keys))


def test_each_record_is_a_member_that_any_reader_finds(spark, tmp_path):
    listed = warc.write(pages(spark, odd_pages()[:6]), f"file://{tmp_path}/w").collect()
    import zlib

    members = 0
    for r in listed:
        with open(r["path"].removeprefix("file://"), "rb") as f:
            data = f.read()
        whole, rest, own = gzip.decompress(data), data, 0
        assert whole.endswith(b"\r\n\r\n") and r["bytes"] == len(data)
        while rest:
            one = zlib.decompressobj(31)
            text = one.decompress(rest)
            rest, own = one.unused_data, own + 1
            head, _, block = text.partition(b"\r\n\r\n")
            assert text.startswith(b"WARC/1.1\r\n") and int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block) - 4
        assert own == r["records"] + 1 == whole.count(b"WARC/1.1\r\n")
        members += r["records"]
    assert members == 6


def read_all(data, piece=7):
    out = []
    for r in warc.records(io.BytesIO(data), piece):
        payload = warc.Payload(r.fields)
        body = b"".join(payload.feed(p) for p in r.pieces)
        payload.close()
        out.append((r.fields, body))
    return out


def one(body=b"hello", **fields):
    named = [("WARC-Type", "resource"), *[(k.replace("_", "-"), v) for k, v in fields.items()]]
    return warc.record(named, [body])


def test_records_of_other_writers():
    import base64
    import zlib

    sha1 = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    head = f"WARC/1.0\r\nwarc-type:response\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:{sha1}\r\nX: a\r\n  b\r\n"
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    data = gzip.compress(f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    for piece in (1, 2, 3, 50, 100_000):
        (fields, body), (_, other) = read_all(data + one(b""), piece)
        assert body == b"body" and fields["x"] == "a b" and other == b""
    # digests of unknown algorithms are left alone
    assert read_all(one(WARC_Payload_Digest="blake:00"))[0][1] == b"hello"
    # records that are not used up are passed over
    assert [r.fields["warc-type"] for r in warc.records(io.BytesIO(one(b"x" * 100_000) + one()))] == ["resource", "resource"]
    assert zlib.crc32(b"") == 0 and read_all(b"") == []


@pytest.mark.parametrize("data", [
    one()[:-9], one() + b"junk", one(WARC_Payload_Digest="sha256:" + "0" * 64), one(WARC_Payload_Digest="sha1:!!"),
    gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhell"), gzip.compress(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nmore"),
    gzip.compress(b"WARC/1.1\r\nContent-Length: 4\r\n\r\nhello\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nContent-Length: -1\r\n\r\n\r\n\r\n"),
    gzip.compress(b"HTTP/1.1 200\r\n\r\n"), gzip.compress(b"WARC/1.1\r\nno colon\r\n\r\n"), gzip.compress(b"WARC/1.1\r\n"),
    one(b"no header", Content_Type="application/http"),
])
def test_broken_records_are_seen(data):
    with pytest.raises(warc.CorruptRecord):
        read_all(data, 11)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([H(*low[i : i + fanout]) for i in range(0, len(low), fanout)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for low in levels[:-1]:
            run = low[i // fanout * fanout :][:fanout]
            path.append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


@pytest.mark.parametrize("fanout,levels", [(2, 3), (3, 2), (2, 12)])
def test_manifest_is_that_of_a_plain_tree(spark, fanout, levels):
    sizes = {"a": 1, None: 2, "b": 37, "é": 64, "z": 65, "": 3, "=": 1}
    rows = [(i, g, f"t{i}", "x", 1, "h") for g, n in sizes.items() for i in range(n)]
    rows += [(5, "b", "other", "x", 1, "h"), (5, "b", "other", "x", 1, "h"), (None, "b", None, "x", 1, "h"), (None, "b", "w" * 300_000, "x", 1, "h")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, path string, slot long, top string")
    got = merkle.verified(merkle.manifest(df, ["doc_id", "lang", "text"], "lang", "doc_id", {"lang": F.col("lang")}, fanout, levels)).collect()
    groups = {}
    for r in rows:
        leaf = H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:3]])
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([leaf for *_, leaf in sorted(groups[g])], fanout) for g in order}
    root, above = plain_tree([trees[g][0] for g in order], fanout)
    want = []
    for g, up in zip(order, above):
        for (known, number, leaf), path in zip(sorted(groups[g]), trees[g][1]):
            want.append((g, number if known else None, leaf, trees[g][0], root, path + up))
    assert sorted([(r["lang"], r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in got], key=repr) == sorted(want, key=repr)
    assert all(r["verified"] for r in got)


def test_a_changed_row_is_seen(spark):
    df = spark.createDataFrame([(i, "a", f"t{i}") for i in range(9)], "doc_id long, lang string, text string")
    changed = merkle.leaf([F.col("doc_id"), F.col("lang"), F.when(F.col("doc_id") == 4, "other").otherwise(F.col("text"))])
    got = merkle.verified(merkle.manifest(df, df.columns, "lang", "doc_id", {"start": changed}), "start").collect()
    assert [r["doc_id"] for r in got if not r["verified"]] == [4]
    # one row: its leaf is the root, and nothing is beside it
    one = merkle.manifest(df.limit(1), df.columns, "lang", "doc_id").withColumn("proof", merkle.proof_digest(F.col("path"))).collect()[0]
    assert one["leaf"] == one["subroot"] == one["root"] and one["path"] == [] and one["proof"] == H("")
    assert merkle.manifest(df.limit(0), df.columns, "lang", "doc_id").count() == 0
