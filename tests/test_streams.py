import json
import math
import random

import pytest
from kotonoha.operators import lookup, ngram
from kotonoha.sources import runs, store
from kotonoha.streaming import jobs
from pyspark.sql import functions as F

LINES = "page_id long, line_idx long, version long, text string, is_vertical boolean"


class Batches:
    """Hands rows to a job batch by batch, as a stream does, and can repeat one."""

    def __init__(self, monkeypatch):
        self.each = None
        monkeypatch.setattr(jobs, "_run", lambda stream, each, checkpoint, once: setattr(self, "each", each))


def plain_stream(lines):
    out = []
    for page in sorted({p for p, _ in lines}):
        at = 0
        for i in sorted(i for p, i in lines if p == page):
            for k, c in enumerate(lines[page, i]):
                out.append((page, at + k, i, k, c))
            at += len(lines[page, i])
    return out


def test_many_batches_of_lines(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    hand = Batches(monkeypatch)
    jobs.stream_line_results(None, str(tmp_path), "", buckets=2)
    newest, sizes = {}, []
    for batch in range(15):
        rows = []
        for _ in range(12):
            page, line, version = rng.randrange(8), rng.randrange(6), rng.randrange(5)
            rows.append((page, line, version, rng.choice(["", "か", "かき", "ab c"]) + str(batch), True))
        if batch == 5:
            rows = [(99, 0, 1, "", False)]  # a page without text
        for p, i, v, t, _ in rows:
            newest[p, i] = max(newest.get((p, i), (-1, -1, "")), (v, batch, t))
        df = spark.createDataFrame(rows, LINES)
        hand.each(df, batch)
        if batch % 7 == 3:  # a replay, also after its manifest was written
            hand.each(df, batch)
        sizes.append((sum(r.rows for r in jobs._line_store(spark, str(tmp_path)).runs()), len(jobs._page_store(spark, str(tmp_path)).runs())))
    lines = {k: v[2] for k, v in newest.items()}
    assert {(r["page_id"], r["line_idx"]): r["text"] for r in jobs.current_lines(spark, str(tmp_path)).collect()} == lines
    chars = sorted(map(tuple, jobs.current_chars(spark, str(tmp_path)).collect()))
    assert chars == plain_stream({k: t for k, t in lines.items() if t})
    # what is stored stays near the current lines, and the runs few
    assert max(n for n, _ in sizes) <= 4 * len(lines) and max(k for _, k in sizes) <= 6
    gone = jobs._line_store(spark, str(tmp_path)).remove_unused()
    assert gone and {(r["page_id"], r["line_idx"]): r["text"] for r in jobs.current_lines(spark, str(tmp_path)).collect()} == lines


def test_a_replay_does_not_see_later_batches(spark, tmp_path):
    own = runs.RunStore(spark, str(tmp_path), "k long, v long", lambda d: d.groupBy("k").agg(F.sum("v").alias("v")))
    for b in range(3):
        own.add(b, spark.createDataFrame([(1, b + 1)], "k long, v long"))
    own.add(1, spark.createDataFrame([(1, 2)], "k long, v long"))
    assert own.read(1).collect()[0]["v"] == 3
    own.add(2, spark.createDataFrame([(1, 3)], "k long, v long"))
    assert own.read().collect()[0]["v"] == 6
    assert own.read(-1).count() == 0


def test_fifty_batches_are_few_runs(spark, tmp_path):
    own = runs.RunStore(spark, str(tmp_path), "k long, n long", lambda d: d.groupBy("k").agg(F.sum("n").alias("n")))
    written = []
    for b in range(50):
        own.add(b, spark.range(b * 10, b * 10 + 10).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")))
        listed = own.runs()
        written.append(sum(r.rows for r in listed if r.last_batch == b))
        assert len(listed) <= 1 + math.log2((b + 1) * 10)
        assert all(a.rows > runs.RATIO * b_.rows for a, b_ in zip(listed, listed[1:]))
    assert own.read().count() == 500 and own.read(19).count() == 200
    # rewritten about as often as the logarithm of the batches
    assert sum(written) <= 500 * (2 + math.log2(50))


def test_counts_of_batches_are_those_of_the_whole(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("かきくけ𠮷") for _ in range(rng.randrange(40))) for _ in range(60)]
    hand = Batches(monkeypatch)
    jobs.stream_ngrams(None, str(tmp_path), "")
    for b in range(12):
        df = spark.createDataFrame([(t,) for t in texts[b * 5 : b * 5 + 5]], "text string")
        hand.each(df, b)
        if b in (4, 11):
            hand.each(df, b)
    whole = ngram.build_ngrams(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert sorted(map(tuple, jobs.published_ngrams(spark, str(tmp_path)).collect())) == sorted(map(tuple, whole.collect()))
    assert len(jobs._count_store(spark, str(tmp_path)).runs()) <= 4


BANKS = "archive string, title string, kind string, bank_ord long, name string, text string, banks long"


def bank(archive, number, words, total, kind="term"):
    rows = [[w, "r", "n", "v1", 1, ["x"]] for w in words] if kind == "term" else [[w, "cat", 1, "note", 1] for w in words]
    return (archive, archive.upper(), kind, number, f"{kind}_bank_{number}.json", json.dumps(rows, ensure_ascii=False), total)


def test_a_dictionary_appears_when_its_last_bank_has_landed(spark, tmp_path, monkeypatch):
    hand = Batches(monkeypatch)
    library = f"{tmp_path}/library"
    jobs.stream_banks(None, f"{tmp_path}/store", "", library=library)
    a = [bank("a", i, [f"w{i}", f"v{i}"], 4) for i in range(3)] + [bank("a", 3, ["t"], 4, "tag")]
    b = [bank("b", 0, ["z"], 2), ("b", "B", "term", 1, "term_bank_1.json", "{broken", 2)]

    def listing():
        meta = store.read_meta(spark, library)
        return sorted((r["name"], r["n_entries"]) for r in store.dictionary_listing(meta, store.read_entries(spark, library)).collect()) if meta.count() else []

    def land(batch, rows):
        hand.each(spark.createDataFrame(rows, BANKS), batch)
        return listing()

    assert land(0, [a[2], b[0]]) == []
    assert land(1, [a[3], a[2], a[2]]) == []  # twice
    assert land(2, [a[0]]) == []
    assert land(3, [a[1], b[1]]) == [("A", 6), ("B", 1)]  # a broken bank is landed too, and quarantined
    ids = {r["name"]: r["id"] for r in store.read_meta(spark, library).collect()}
    assert land(3, [a[1], b[1]]) == [("A", 6), ("B", 1)]  # a replay
    assert land(4, [a[0], b[0]]) == [("A", 6), ("B", 1)]  # the same texts again
    assert {r["name"]: r["id"] for r in store.read_meta(spark, library).collect()} == ids
    assert land(5, [bank("a", 1, ["new"], 4)]) == [("A", 5), ("B", 1)]  # a changed bank replaces the earlier one
    assert spark.read.parquet(f"{library}/tags").count() >= 1


@pytest.mark.parametrize("rows", [[], [(1, 0, 1, None, None)]])
def test_batches_without_text(spark, tmp_path, monkeypatch, rows):
    hand = Batches(monkeypatch)
    jobs.stream_line_results(None, str(tmp_path), "")
    hand.each(spark.createDataFrame(rows, LINES), 0)
    assert jobs.current_chars(spark, str(tmp_path)).count() == 0 and jobs.current_lines(spark, str(tmp_path)).count() == len(rows)
    assert lookup.line_offsets(jobs.current_lines(spark, str(tmp_path))).count() == 0
