import random
import zipfile

import numpy as np
import pytest
from kotonoha.operators import geometry, ordered, similarity
from kotonoha.sources import banks, store
from pyspark.sql import functions as F


def plain_strong(edges):
    """Nodes that reach each other, by search from every node."""
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
        ahead.setdefault(b, set())

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in ahead[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    all_ = {a: reach(a) for a in ahead}
    return {a: min(b for b in all_[a] if a in all_[b]) for a in ahead}


def test_strong_components_of_pages_of_any_size(spark):
    rng = random.Random(4)
    graphs = {
        1: [(rng.randrange(40), rng.randrange(40)) for _ in range(55)],
        2: [(i, (i + 1) % 30) for i in range(30)],  # one ring
        3: [(i, i + 1) for i in range(30)],  # a path
        4: [(5, 5), (5, 6), (6, 5), (7, 6), (8, 9)],
        5: [(rng.randrange(60), rng.randrange(60)) for _ in range(120)],
    }
    edges = spark.createDataFrame([(p, a, b) for p, es in graphs.items() for a, b in es], "page_id long, src long, dst long")
    want = sorted((p, n, c) for p, es in graphs.items() for n, c in plain_strong(es).items())
    for most in (0, 40, 1000):
        assert sorted(map(tuple, geometry.strong_components(edges, most).collect())) == want
    assert geometry.strong_components(edges.limit(0), 0).count() == 0


@pytest.mark.parametrize("slots,most", [(4, 3), (1024, 65_536)])
def test_quantiles_of_a_large_group(spark, slots, most):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=900), "b": np.concatenate((rng.normal(size=500) * 1e-9, [1e9])), "c": np.ones(50), "d": np.array([3.5]), "e": rng.integers(0, 5, 400).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("f", None)]
    qs = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p90": 0.9, "high": 1.0}
    got = ordered.group_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", qs, slots, most).collect()
    assert sorted(r["g"] for r in got) == sorted(groups)
    for r in got:
        assert np.allclose([r[n] for n in qs], np.quantile(groups[r["g"]], list(qs.values())), rtol=1e-12, atol=0)


def test_an_archive_of_many_banks_is_read_by_ranges(spark, tmp_path):
    rng = random.Random(2)
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for i in range(80):
            z.writestr(f"term_bank_{i}.json", f'[["{"".join(rng.choice("abcdef") for _ in range(3000))}",{i}]]', zipfile.ZIP_DEFLATED if i % 3 else zipfile.ZIP_STORED)
        z.writestr("index.json", '{"title": "Big"}')
        z.writestr("tag_bank_1.json", "[]")
        z.writestr("readme.txt", "x")
    with zipfile.ZipFile(tmp_path / "plain.zip", "w") as z:
        z.writestr("kanji_bank_2.json", "[1]")
    members = banks.archive_members(spark, str(tmp_path))
    assert members.count() == 84
    tasks = banks._split_by_range(members, 8192).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 10
    got = banks.read_bank_documents(spark, str(tmp_path), range_bytes=8192).collect()
    with zipfile.ZipFile(tmp_path / "big.zip") as z:
        assert all(r["text"] == z.read(r["name"]).decode() for r in got if r["title"] == "Big")
    assert sorted((r["title"], r["kind"], r["bank_ord"]) for r in got) == sorted([("Big", "term", i) for i in range(80)] + [("Big", "tag", 80), ("plain", "kanji", 0)])
    # a broken member is seen
    data = bytearray((tmp_path / "big.zip").read_bytes())
    data[60] ^= 0xFF
    (tmp_path / "big.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        banks.read_bank_documents(spark, str(tmp_path)).collect()


def test_corrections_rewrite_their_parts_only(spark, tmp_path):
    path = str(tmp_path / "lines")
    lines = spark.createDataFrame([(p, i, f"t{p}x{i}") for p in range(40) for i in range(2)] + [(40, 0, ""), (41, 0, None)], "page_id long, line_idx long, text string")
    store.export_line_dataset(lines, path)
    files = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "lines").rglob("*.parquet")}
    fix = [(3, 1, 0, "甲", 1), (3, 1, 0, "乙", 2), (3, 1, 99, "x", 1), (77, 0, 0, "x", 1), (41, 0, 0, "x", 1), (40, 0, 0, "y", 1)]
    corrections = spark.createDataFrame(fix, "page_id long, line_idx long, idx long, ch string, version long")
    for _ in range(2):
        touched = store.correct_line_dataset(spark, path, corrections)
        got = {(r["page_id"], r["line_idx"]): r["text"] for r in spark.read.parquet(path).collect()}
        want = {(r["page_id"], r["line_idx"]): r["text"] for r in lines.collect()}
        assert got == {**want, (3, 1): "乙3x1"}
    assert 0 < len(touched) <= 4
    now = {f.name for f in (tmp_path / "lines").rglob("*.parquet")}
    assert len(set(files) - now) <= len(touched) and set(files) & now
    assert store.correct_line_dataset(spark, path, corrections.limit(0)) == []


def test_neighbours_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    parts = {chr(0x4E00 + i): {f"p{int(rng.paretovariate(0.7)) % 25}" for _ in range(rng.randrange(1, 7))} for i in range(120)}
    components = spark.createDataFrame([(i, p) for i, ps in parts.items() for p in ps], "item string, component string")
    idf = similarity.component_idf(components)
    weight = {r["component"]: r["idf"] for r in idf.collect()}
    for least in (0.0, 0.4, 0.7):
        want = set()
        for a, pa in parts.items():
            mass = sum(weight[p] for p in pa)
            for b, pb in parts.items():
                both = sum(weight[p] for p in pa & pb)
                if a != b and pa & pb and mass > 0 and round(both / mass, 9) >= least:
                    want.add((a, b, round(both / mass, 6), pa <= pb))
        got = {(r["src"], r["dst"], round(r["fraction"], 6), r["shares_all"]) for r in similarity.neighbours(components, idf, least).collect()}
        assert got == want


@pytest.mark.parametrize("size", [3, 10, 512])
def test_candidate_counts_of_large_pages(spark, size):
    rng = random.Random(8)
    rows = [(1, i, rng.randrange(300), rng.randrange(300), 4, 4) for i in range(120)] + [(2, i, 10 * (i % 9), 10 * (i // 9), 6, 6) for i in range(81)]
    rows += [(3, i, 50, 50, 4, 4) for i in range(12)] + [(4, i, 5 * i, 5 * i, 4, 4) for i in range(40)] + [(5, 0, 1, 1, 2, 2)]
    boxes = spark.createDataFrame(rows, "page_id long, box_idx long, x int, y int, w int, h int")
    points = {}
    for r in geometry.box_positions(boxes).collect():
        points.setdefault(r["page_id"], []).append((r["box_idx"], r["px"], r["py"]))
    want = {}
    for page, ps in points.items():
        for a, ax, ay in ps:
            for b, bx, by in ps:
                for d, ahead, aside in (("N", ay - by, abs(ax - bx)), ("S", by - ay, abs(ax - bx)), ("E", bx - ax, abs(ay - by)), ("W", ax - bx, abs(ay - by))):
                    if a != b and ahead > 0 and aside <= ahead:
                        for phase in (geometry.FAR, geometry.LOCAL):
                            if phase == geometry.FAR or ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5 <= 0.05:
                                want[phase, page, a, d] = want.get((phase, page, a, d), 0) + 1
    for phase in (geometry.FAR, geometry.LOCAL):
        got = {(phase, r["page_id"], r["src"], r["dir"]): r["n"] for r in geometry.candidate_counts(boxes, phase, size).collect()}
        assert got == {k: n for k, n in want.items() if k[0] == phase}
