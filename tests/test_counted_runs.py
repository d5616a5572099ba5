"""Windows are cut and coded once per distinct run of a page, never per position."""

import random
from collections import Counter

from pyspark.sql import functions as F

from kotonoha.operators import lookup, results

SCHEMA = "page_id long, line_idx long, text string"


def _lines():
    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("かきく、　") for _ in range(n))
    rows = [(p, i, made(rng.randint(0, 30))) for p in range(12) for i in range(7)]
    return rows + [(20, 0, "かき" * 100 + "　く" * 50), (20, 1, ""), (20, 2, "かき、"), (21, 0, "、　"), (22, 0, "か　"), (22, 1, "　　"), (22, 2, "き")]


def test_windows_of_runs_are_those_of_positions(spark):
    rows = _lines()
    runs = lookup.live_runs(spark.createDataFrame(rows, SCHEMA), "かきく", 4)
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan.split("MapInArrow")[0]
    each = lookup.run_windows(runs.select("run", "more").distinct(), 4)
    got = runs.join(each, ["run", "more"]).groupBy("page_id", "query").agg(F.sum("n").alias("n")).collect()
    want = Counter()
    for page in {p for p, _, _ in rows}:
        text = "".join(t for p, _, t in sorted(rows) if p == page)
        for at in range(len(text)):
            query = text[at : at + 4].partition("、")[0].replace("　", "")
            if text[at] != "　" and query:
                want[page, query] += 1
    assert {(r.page_id, r.query): r.n for r in got} == want


def test_prefixes_and_longest_matches_are_found_in_order(spark):
    rng = random.Random(6)
    texts = sorted({"".join(rng.choice("abか") for _ in range(rng.randint(1, 8))) for _ in range(300)})
    hits = set(rng.sample(sorted({t[:n] for t in texts for n in range(1, 9)}), 60)) | {"a", "bか", "zz"}
    queries = spark.createDataFrame([(t,) for t in texts], "query string")
    prefixes = sorted(r.surface for r in lookup.distinct_prefixes(queries, 8).collect())
    assert prefixes == sorted({t[:n] for t in texts for n in range(1, len(t) + 1)})
    found = results.longest_matches(queries, spark.createDataFrame([(h,) for h in hits] * 2, "surface string"))
    best = {t: max((t[:n] for n in range(1, 9) if t[:n] in hits), key=len, default=None) for t in texts}
    assert {r.query: (r.surface, r.max_len) for r in found.collect()} == {t: (s, len(s)) for t, s in best.items() if s}


def test_coverage_is_that_of_positions(spark):
    entry = "id bigint, kanji string, reading string, rules string, dictionary_id bigint, onyomi string, kunyomi string"
    entries = spark.createDataFrame([(1, "かき", "く", "v5", 1, None, None), (2, "きく", "きくか", "v1", 1, None, None), (3, "か", "ききき", "n", 2, None, None)], entry)
    meta = spark.createDataFrame([(1, 0, True), (2, 1, True)], "id bigint, priority int, enabled boolean")
    rules = spark.createDataFrame([(0, 0, "くか", "", ["v5"], "past"), (1, 0, "き", "く", ["v1"], "te")], "group_ord int, rule_ord int, suffix_in string, suffix_out string, types array<string>, reason string")
    lines = spark.createDataFrame(_lines(), SCHEMA)
    want = lookup.page_coverage(lines, lookup.match_positions(lines, entries, meta, rules, 6))
    got = results.page_coverage(lines, entries, meta, rules, 6)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
