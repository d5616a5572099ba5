import random

import pytest
from pyspark.sql import functions as F

from kotonoha.operators import evidence, geometry, ordered


def test_blocked_helpers_match_plain_windows(spark):
    from pyspark.sql import Window

    rng = random.Random(3)
    rows = [(0 if rng.random() < 0.5 else k % 4, k, rng.randint(0, 9)) for k in range(600)]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    w = Window.partitionBy("g").orderBy("i")
    want = sorted(map(tuple, df.select(
        "g", "i", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lag("v").over(w)).collect()), key=repr)
    d = ordered.prefix_sums(df, ["g"], "i", {"s": F.col("v")}, size=16)
    d = ordered.previous_values(d, ["g"], "i", {"p": "v"}, size=16)
    assert sorted(map(tuple, d.select("g", "i", "s", "p").collect()), key=repr) == want
    best = ordered.prefix_max(df, ["g"], "i", F.col("v"), "m", size=16)
    want = sorted(map(tuple, df.select("g", "i", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1))).collect()), key=repr)
    assert sorted(map(tuple, best.select("g", "i", "m").collect()), key=repr) == want
    med = {r.g: (r.median, r.upper_median) for r in ordered.group_medians(df, ["g"], "v", slots=4).collect()}
    for g in med:
        v = sorted(x for a, _, x in rows if a == g)
        assert med[g] == ((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, v[len(v) // 2])


LINE = "line_id int, n int, is_vertical boolean, crop_w int, crop_h int, seq_len int"


def gaps(spark, centres, vertical):
    lines = spark.createDataFrame([(1, len(centres), vertical, 0, 0, 0)], LINE)
    boxes = spark.createDataFrame([], "line_id int, idx int, x int, y int, w int, h int")
    cols = spark.createDataFrame([(1, i, float(c)) for i, c in enumerate(centres)], "line_id int, idx int, col double")
    steps = spark.createDataFrame([], "line_id int, t int, rank int, cls int, ch string, score double")
    return [(r.insert_at, round(r.ratio, 4)) for r in evidence.detect_gaps(lines, boxes, cols, steps).collect()]


def test_gap_threshold_is_inclusive_and_by_orientation(spark):
    line = [0, 10, 20, 36, 46, 56]
    assert gaps(spark, line, True) == [(3, 1.6)] and gaps(spark, line, False) == []
    assert gaps(spark, [5, 5, 5], True) == []


def test_collapse_rules(spark):
    text = "かか　か  きき"
    steps = spark.createDataFrame([(1, t, 0, 0, ch, 9.0) for t, ch in enumerate(text)], "line_id int, t int, rank int, cls int, ch string, score double")
    lines = spark.createDataFrame([(1, False)], "line_id int, is_vertical boolean")
    out = evidence.line_text(evidence.redecode(steps, lines)).first().text
    assert out == "かか  き"
    runs = evidence.run_statistics(steps, spark.createDataFrame([(1, 4)], "line_id int, n int")).orderBy("run").collect()
    assert [(r.run_start, r.run_end) for r in runs] == [(0, 1), (3, 3), (4, 5), (6, 7)]


def test_size_windows(spark):
    chars = [(1, i, c) for i, c in enumerate("かれはいっとう。")] + [(2, i, c) for i, c in enumerate("シーツをあらう。")]
    f = evidence.size_pair_features(spark.createDataFrame(chars, "line_id int, idx int, ch string"), ["line_id"])
    got = {(r.line_id, r.idx): list(r.window) for r in f.collect()}
    utf = lambda s: [b for c in s for b in list(c.encode()) + [0]]
    assert got[(1, 4)] == [0] * 4 + utf("かれはい") + utf("とう") + [0] * 12
    assert got[(2, 2)] == [0] * 12 + utf("シー") + utf("をあらう") + [0] * 4


def test_stitching(spark):
    alts = lambda ch: [(ch, 5.0), ("x", 1.0)]
    item = lambda text, at: [(c, float(i), at + 10.0 * i, alts(c)) for i, c in enumerate(text)]
    rows = [(1, 0, 0.0, 10.0, item("あいうえ", 0.0)), (1, 1, 20.0, 10.0, item("うえおか", 20.0)), (1, 2, 100.0, 10.0, item("  き", 100.0)), (2, 0, 0.0, 10.0, item("さ", 0.0))]
    df = spark.createDataFrame(rows, "line_id long, chunk long, offset_px double, step_px double, items array<struct<ch:string,col:double,centre:double,alts:array<struct<ch:string,score:double>>>>")
    out = evidence.stitch_lines(df)
    text = {r.line_id: r.text for r in evidence.line_text(out).collect()}
    assert text == {1: "あいうえおか き", 2: "さ"}
    assert [r.col for r in out.filter("line_id = 1").orderBy("char_idx").collect()][:6] == [0, 1, 2, 3, 4, 5]


def plain_agreement(a, b):
    """How far two ranked lists agree: on the first, across the first three, or not."""
    if not a or not b:
        return 0.0
    if a[0][0] == b[0][0]:
        five = [c for c, _ in a[:5]]
        return 0.6 + sum(c in [x for x, _ in b[:5]] for c in five) / 5 * 0.4
    return 0.5 if a[0][0] in [c for c, _ in b[:3]] or b[0][0] in [c for c, _ in a[:3]] else 0.0


def plain_merge(a, b):
    scores = dict(a)
    for ch, score in b:
        old = scores.get(ch)
        scores[ch] = (old + score) * 0.8 if old is not None and old > 0 else score * 0.6
    order = list(scores)
    return sorted(scores.items(), key=lambda x: (-x[1], order.index(x[0])))[:15]


def plain_stitch(chunks):
    """One list that grows chunk by chunk; items are ``(ch, col, centre, alternatives)``."""
    out = [tuple(i) for i in chunks[0][2]]
    for offset, step, items in chunks[1:]:
        best = None
        for p in range(max(0, len(out) - 10), len(out)):
            for c, item in enumerate(items[:10]):
                dist, agree = abs(out[p][2] - item[2]), plain_agreement(out[p][3], item[3])
                if dist <= 30 and agree >= 0.4:
                    found = ((1 - dist / 30) * 0.3 + agree * 0.7, p, -c)
                    best = found if best is None or found > best else best

        def put(item, col, centre, out=out):
            if not (out and out[-1][0] == item[0] == " "):
                out.append((item[0], item[1] + col, item[2] + centre, item[3]))

        if best:
            _, p, c = best
            met, kept = items[-c], out[p]
            del out[p + 1 :]
            out[p] = (*kept[:3], plain_merge(kept[3], met[3]))
            for item in items[1 - c :]:
                put(item, kept[1] - met[1], kept[2] - met[2])
            continue
        end, before, last = (out[-1][2] if out else -100.0), len(out), out[-1] if out else None
        for item in items:
            if item[2] > end + 10 or (last and len(items) == 1):
                put(item, offset / step, 0.0)
        if len(out) == before and last and not any(i[2] > end + 10 for i in items) and items:
            for item in items:
                put(item, last[1] + 1 - items[0][1], last[2] + step - items[0][2])
    return [x for i, x in enumerate(out) if not (i and x[0] == out[i - 1][0] == " ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_stitching_is_that_of_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    lines = {}
    for line in range(60):
        text = [rng.choice("あいうえおかき ") for _ in range(rng.randrange(1, 80))]
        chunks, at = [], 0
        while at < len(text):
            n = rng.choice([0, 1, 2, 5, 12, 20])
            items = []
            for k, ch in enumerate(text[at : at + n]):
                ch = rng.choice("xyz") if rng.random() < 0.1 else ch
                others = rng.sample("abcdefg", rng.randrange(0, 6))
                alts = [] if rng.random() < 0.03 else [(ch, 9.0 + rng.random())] + [(o, 5.0 - i + rng.random() * 0.5) for i, o in enumerate(others)]
                items.append((ch, float(k), 10.0 * (at + k) + rng.uniform(-4, 4) + rng.choice([0, 0, 0, 25]), alts))
            chunks.append((10.0 * at, 10.0, items))
            at += max(1, n - rng.choice([0, 0, 1, 3, 8]))
        lines[line] = chunks
    schema = "line_id long, chunk long, offset_px double, step_px double, items array<struct<ch:string,col:double,centre:double,alts:array<struct<ch:string,score:double>>>>"
    df = spark.createDataFrame([(i, k, *c) for i, chunks in lines.items() for k, c in enumerate(chunks)], schema)
    got = {}
    for r in evidence.stitch_lines(df).orderBy("line_id", "char_idx").collect():
        got.setdefault(r.line_id, []).append((r.ch, round(r.col, 6), round(r.centre, 6), [(a.ch, round(a.score, 6)) for a in r.alts]))
    for i, chunks in lines.items():
        want = [(c, round(col, 6), round(at, 6), [(a, round(s, 6)) for a, s in alts]) for c, col, at, alts in plain_stitch(chunks)]
        assert got.get(i, []) == want, i


def box(page, i, x, y, w, h):
    return (page, i, x, y, w, h, 1.0, False)


BOX = "page_id long, box_idx long, x int, y int, w int, h int, confidence double, is_rotated boolean"


def merged(spark, rows):
    return sorted((r.x, r.y, r.w, r.h, r.members) for r in geometry.merge_overlapping(spark.createDataFrame(rows, BOX)).collect())


def test_merge_with_running_union(spark):
    # the union of the first two reaches the third, which neither reaches alone; the fourth overlaps too little
    rows = [box(1, 0, 0, 0, 100, 20), box(1, 1, 60, 0, 80, 20), box(1, 2, 130, 0, 20, 20), box(1, 3, 148, 0, 40, 20), box(1, 4, 0, 500, 10, 10)]
    assert merged(spark, rows) == [(0, 0, 150, 20, 3), (0, 500, 10, 10, 1), (148, 0, 40, 20, 1)]
    # boxes on either side of an empty strip are never one
    rows = [box(2, i, 40 * i, 0, 30, 10) for i in range(50)]
    assert len(merged(spark, rows)) == 50


def cut_apart(spark, rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "page_id long, box_idx long, x int, y int, w int, h int")
    return {r.box_idx: (r.y, r.h) for r in geometry.split_stacked(df).collect()}


def test_split_stacked(spark):
    assert cut_apart(spark, [(0, 0, 100, 30), (0, 20, 100, 30), (200, 0, 100, 30)]) == {0: (0, 25), 1: (25, 25), 2: (0, 30)}
    # a box inside another, and equal tops: the earlier one stays above
    assert cut_apart(spark, [(0, 0, 100, 40), (0, 10, 100, 10)]) == {0: (0, 15), 1: (15, 5)}
    assert cut_apart(spark, [(0, 0, 100, 10), (0, 0, 100, 10)]) == {0: (0, 5), 1: (5, 5)}


def test_stacked_boxes_push_the_next_ones_down(spark):
    # twelve boxes in one place take a pixel each, and so reach one that lies below the first eleven
    got = cut_apart(spark, [(0, 0, 10, 1)] * 12 + [(0, 5, 10, 3)])
    assert got[12] == (12, 1)


def test_large_pages_are_cut_like_small_ones(spark):
    rng = random.Random(4)
    rows = [(200 * (i % 50) + rng.randint(0, 60), rng.randint(0, 500), 100, rng.randint(5, 20)) for i in range(2500)]
    whole = cut_apart(spark, rows)
    for column in (0, 7):
        mine = [i for i in range(2500) if i % 50 == column]
        alone = cut_apart(spark, [rows[i] for i in mine])
        assert {i: whole[i] for i in mine} == {i: alone[n] for n, i in enumerate(mine)}


def test_ruby_overlap_boundary(spark):
    rows = []
    for page, right in ((1, 200), (2, 180)):
        rows += [(page, 0, 0, 276, right, 24, -10, 266, right + 20, 42), (page, 1, 100, 300, 500, 60, 90, 290, 520, 80)]
    df = spark.createDataFrame(rows, "page_id int, box_idx int, x int, y int, w int, h int, ux int, uy int, uw int, uh int")
    pages = spark.createDataFrame([(1, 1000, 1000), (2, 1000, 1000)], "page_id int, img_w int, img_h int")
    assert [(r.page_id, r.box_idx) for r in geometry.ruby_pairs(df, pages).collect()] == [(1, 0)]


def test_grid_search_equals_one_cell(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.randint(0, 2000), rng.randint(0, 2000), 10, 10) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, box_idx long, x int, y int, w int, h int")
    pick = lambda phase: sorted(map(tuple, geometry.directional_neighbours(df, phase).select("src", "dir", "rank", "dst").collect()))
    per_cell = geometry.PER_CELL
    for phase in (geometry.FAR, geometry.WRAP):
        try:
            geometry.PER_CELL = 10_000
            want = pick(phase)
            geometry.PER_CELL = 12
            assert pick(phase) == want
        finally:
            geometry.PER_CELL = per_cell


def test_reading_order_and_frames(spark):
    boxes = [(1, 0, 10, 10, 200, 30), (1, 1, 10, 100, 200, 30), (1, 2, 100, 10, 30, 200), (1, 3, 300, 10, 30, 200), (1, 4, 10, 200, 40, 40)]
    df = spark.createDataFrame(boxes, "page_id int, box_idx int, x int, y int, w int, h int")
    assert [r.box_idx for r in geometry.reading_order(df).orderBy("position").collect()] == [0, 1, 4, 3, 2]
    frames = [(200, 40, 162.0, False, False, -18.0), (200, 40, -100.0, False, False, 80.0), (200, 40, 0.5, False, True, 0.5), (100, 125, 0.0, True, True, 0.0), (100, 124, 0.0, False, True, 0.0), (20, 10, 3.0, False, True, 3.0), (20, 10, 5.0, False, False, 5.0)]
    f = spark.createDataFrame([(1, i, 0.0, 0.0, float(w), float(h), a) for i, (w, h, a, *_) in enumerate(frames)], "page_id int, idx int, cx double, cy double, w double, h double, angle_deg double")
    got = geometry.frame_columns(f).orderBy("idx").collect()
    assert [(r.is_vertical, r.axis_aligned, round(r.angle_deg, 6)) for r in got] == [(v, a, n) for *_, v, a, n in frames]
    local = geometry.map_local_rects(f.filter("idx = 3").withColumns({"lx": F.lit(0.0), "ly": F.lit(0.0), "lw": F.lit(100.0), "lh": F.lit(125.0)})).first()
    assert (local.x, local.y, local.bw, local.bh) == (-50, -63, 100, 125)
