"""Pairs are measured where a component's items meet, and cut to the best there."""

import random
from math import log

import pyarrow as pa

from kotonoha.operators import similarity

ITEMS = {f"亜{chr(0x4e00 + i)}": sorted(random.Random(i).sample(range(12), 1 + i % 5)) for i in range(60)}


def plain(least=0.7):
    df = {c: sum(c in p for p in ITEMS.values()) for c in range(12)}
    idf = {c: log(len(ITEMS) / n) for c, n in df.items() if n}
    mass = {i: sum(idf[c] for c in p) for i, p in ITEMS.items()}
    both = {(a, b): set(p) & set(q) for a, p in ITEMS.items() for b, q in ITEMS.items() if a != b and set(p) & set(q)}
    found = {k: (round(sum(idf[c] for c in v) / mass[k[0]], 6), len(v) == len(ITEMS[k[0]])) for k, v in both.items()}
    return {k: v for k, v in found.items() if v[0] >= least}


def rows(df):
    return {(r.src, r.dst): (round(r.fraction, 6), r.shares_all) for r in df.collect()}


def components(spark):
    return spark.createDataFrame([(i, f"c{c:02}") for i, p in ITEMS.items() for c in p], "item string, component string")


def test_pairs_are_no_join(spark):
    c = components(spark)
    near = similarity.neighbours(c, similarity.component_idf(c))
    assert rows(near) == plain()
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_salted_carriers(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HOT_COMPONENT", 4)
    c = components(spark)
    assert rows(similarity.neighbours(c, similarity.component_idf(c))) == plain()


def test_best_and_asked_for(spark):
    c = components(spark)
    every = plain()
    sources = sorted({a for a, _ in every})
    asked = [(a, b) for a in sources for b in sorted(ITEMS)[::7] if a != b]
    also = spark.createDataFrame(asked, "src string, dst string")
    got = rows(similarity.nearest(c, similarity.component_idf(c), 2, also))
    best = {k for s in sources for k in sorted((k for k in every if k[0] == s), key=lambda k: (-every[k][0], k[1]))[:2]}
    assert got == {k: every[k] for k in every if k in best or k in set(asked)}


def test_blocks_of_pairs(monkeypatch):
    # carriers over several batches, sources one by one, results in pieces
    monkeypatch.setattr(similarity, "CELLS", 3)
    monkeypatch.setattr(similarity, "OUT_ROWS", 2)
    n, nothing = 7, [None] * 7
    carrier = pa.RecordBatch.from_pydict({
        "a": [5] * n, "salt": [0] * n, "kind": [0] * n, "name": [f"d{i}" for i in range(n)], "c": [[3, 5, 10 + i % 2] for i in range(n)],
        "v": pa.array(nothing, pa.list_(pa.float64())), "place": pa.array(nothing, pa.int32()),
        "need": pa.array(nothing, pa.float64()), "mass": pa.array(nothing, pa.float64()),
    })
    first = {"a": [5, 5], "salt": [0, 0], "kind": [1, 1], "name": ["s", "t"], "c": [[5, 10], [3, 5]], "v": [[2.0, 1.0], [4.0, 2.0]], "place": [0, 1]}
    source = pa.RecordBatch.from_pydict({**first, "need": [2.5, 1.0], "mass": [3.0, 6.0]})
    got = [r for b in similarity._met_by_component([carrier.slice(0, 4), carrier.slice(4), source]) for r in b.to_pylist()]
    # t shares a heavier component with all of them, so it meets them there
    assert got == [{"src": "s", "dst": f"d{i}", "weight": 3.0, "mass": 3.0, "shares_all": True} for i in range(0, n, 2)]
