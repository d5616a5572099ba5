"""Neighbours of ordinary pages, compared page by page, and of pages of all sizes together."""

import random

import pytest
from kotonoha.operators import geometry
from kotonoha.plans import all_queries

BOXES = "page_id long, box_idx long, x int, y int, w int, h int"


def plain_neighbours(rows, phase):
    """In the order of operations of the SQL."""
    pages = {}
    for page, i, x, y, w, h in rows:
        pages.setdefault(page, []).append((i, x, y, w, h))
    out = []
    for page, boxes in pages.items():
        mx, my = max(x + w for _, x, _, w, _ in boxes), max(y + h for _, _, y, _, h in boxes)
        at = {i: ((x + w / 2.0) / mx, (y + h / 2.0) / my) for i, x, y, w, h in boxes}
        for a, (px, py) in at.items():
            for d in "NSEW":
                found = []
                for b, (jx, jy) in at.items():
                    aside = abs(px - jx) if d in "NS" else abs(py - jy)
                    ahead = {"N": py - jy, "S": jy - py, "E": jx - px, "W": px - jx}[d]
                    if a != b and phase == geometry.FAR and ahead > 0 and aside <= ahead:
                        found.append((ahead + 1.5 * aside, b))
                    if a != b and phase == geometry.WRAP and ahead < 0 and aside <= ahead + 1:
                        found.append((ahead + 1 + 1.5 * min(aside, 1 - aside), b))
                out += [(page, a, d, r + 1, b) for r, (_, b) in enumerate(sorted(found)[:5])]
    return sorted(out)


@pytest.mark.parametrize("phase", [geometry.FAR, geometry.WRAP])
@pytest.mark.parametrize("per_cell", [256, 12])
def test_neighbours_of_pages_of_all_sizes(spark, monkeypatch, phase, per_cell):
    rng = random.Random(3)
    rows = [(p, i, 7 * rng.randrange(12), 7 * rng.randrange(12), 7, 7) for p in range(30) for i in range(rng.choice((1, 4, 9, 30)))]
    monkeypatch.setattr(geometry, "PER_CELL", per_cell)
    got = geometry.directional_neighbours(spark.createDataFrame(rows, BOXES), phase)
    assert sorted(map(tuple, got.select("page_id", "src", "dir", "rank", "dst").collect())) == plain_neighbours(rows, phase)


@pytest.mark.parametrize("phase", [geometry.FAR, geometry.LOCAL, geometry.WRAP])
def test_counts_do_not_depend_on_how_pages_are_met(spark, monkeypatch, phase):
    rng = random.Random(6)
    rows = [(p, i, rng.randrange(300), rng.randrange(300), 4, 4) for p in range(3) for i in range((8, 60, 120)[p])]
    counts = lambda: sorted(map(tuple, geometry.candidate_counts(spark.createDataFrame(rows, BOXES), phase, 10).collect()))
    want = counts()
    monkeypatch.setattr(geometry, "PER_CELL", 9)
    assert counts() == want and want


def test_pages_are_shuffled_once(spark, sf_dir):
    # pairs and directions of an ordinary page need no shuffle of their own
    plan = all_queries.QUERIES["g07_directional_neighbours"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") <= 2  # both sides of the pairs, the same
