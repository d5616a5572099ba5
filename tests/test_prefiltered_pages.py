"""Ordinary pages are filtered where they are, with the results of the grid."""

import random

from kotonoha.operators import geometry


def test_pages_are_filtered_alike_and_not_dealt_anew(spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for page in range(12):
        for i in range(3 if page < 6 else 30):
            w, h = rng.choice([(8, 200), (14, 180), (300, 20), (60, 60), (500, 600), (5, 5)])
            rows.append((page, i, rng.randint(0, 900) / 1.0, rng.randint(0, 1300) / 1.0, float(w + rng.randint(0, 9)), float(h + rng.randint(0, 40)), rng.choice([0.0, 0.0, 91.0, -3.0])))
    raw = spark.createDataFrame(rows, "page_id long, idx long, cx double, cy double, w double, h double, angle_deg double").repartition(3, "page_id")
    frames = raw.selectExpr("page_id", "idx", "cx", "cy", "w + 12 as w", "h + 12 as h", "angle_deg")
    pages = raw.select("page_id").distinct().selectExpr("page_id", "1000 as img_w", "1400 as img_h")
    near = geometry.prefilter_frames(frames, raw, pages)
    got = sorted(map(tuple, near.collect()))
    keys = [line for line in near._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in line and "idx" in line.split("hashpartitioning")[1]]
    assert not keys
    # half of the pages through the grid
    monkeypatch.setattr(geometry, "PER_CELL", 10)
    mixed = sorted(map(tuple, geometry.prefilter_frames(frames, raw, pages).collect()))
    assert got == mixed and 0 < len(got) < len(rows)
