"""Requests travel as numbers; no line is repeated for its positions."""

import random

import pytest

from kotonoha.operators import lookup

LINES = "page_id long, line_idx long, text string"


def test_matched_text_of_every_position(spark):
    rng = random.Random(9)
    rows = [(p, i, "".join(rng.choice("かき　𠮟") for _ in range(rng.choice([0, 1, 3, 400, 1500])))) for p in range(5) for i in range(12)]
    rows += [(9, 0, "　　"), (9, 1, ""), (9, 2, "　"), (9, 3, "か　"), (9, 4, "　"), (9, 5, "き"), (10, 0, "　")]
    pages = {p: "".join(t for q, _, t in sorted(rows) if q == p) for p, _, _ in rows}
    asked = [(p, g, rng.choice([0, 1, 2, 5, 8, None])) for p, t in pages.items() for g in range(-1, len(t) + 2)] * 2
    got = lookup.matched_surface(spark.createDataFrame(rows, LINES), spark.createDataFrame(asked, "page_id long, gidx long, term_len int"), 8)
    want = [(p, g, n, None if n is None else pages[p][g:].replace("　", "")[:n]) for p, g, n in asked if 0 <= g < len(pages[p])]
    assert got.dtypes == [("page_id", "bigint"), ("gidx", "bigint"), ("term_len", "int"), ("matched", "string")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    # what is shuffled with the requests has no text
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan


def test_longer_requests_fail(spark):
    lines = spark.createDataFrame([(1, 0, "かきく")], LINES)
    with pytest.raises(Exception, match="term_len exceeds width"):
        lookup.matched_surface(lines, spark.createDataFrame([(1, 0, 9)], "page_id long, gidx long, term_len int"), 8).collect()
