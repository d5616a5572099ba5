"""Page geometry.

Pair rules are evaluated through a grid: each page gets as many cells as its
box count calls for (one cell on an ordinary page), the candidate is a point in
one cell, and the box it is tested against covers the cells its rule can reach.
"""

from __future__ import annotations

from itertools import combinations
from operator import itemgetter

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx
from kotonoha.functions.tables import dealt, written
from kotonoha.operators import ordered

PAGE = ["page_id"]
PER_CELL = 256
MAX_GRID = 256


# -- G01 ---------------------------------------------------------------------------


def normalise_angle(deg: Column) -> Column:
    """To [-90, 90) degrees."""
    return deg - 180.0 * F.floor((deg + 90.0) / 180.0)


def is_vertical(w: Column, h: Column) -> Column:
    return h >= w * fx.VERTICAL_ASPECT


def frame_columns(frames: DataFrame, ratio: float = 1.5) -> DataFrame:
    """``(page_id, idx, cx, cy, w, h, angle_deg)`` with derived columns."""
    d = frames.withColumn("angle_deg", normalise_angle(F.col("angle_deg")))
    c, s = F.abs(F.cos(F.radians("angle_deg"))), F.abs(F.sin(F.radians("angle_deg")))
    d = d.withColumn("aabb_w", F.col("w") * c + F.col("h") * s).withColumn("aabb_h", F.col("w") * s + F.col("h") * c)
    long = F.greatest("w", "h", F.lit(1.0))
    tolerance = F.greatest(F.radians(F.lit(fx.AXIS_TOL_DEG)), F.atan(fx.AXIS_QUANT_PX / long))
    expand = F.when(
        (F.col("w") > 1e-6) & (F.col("h") > 1e-6), F.col("w") * F.col("h") * ratio / (2.0 * (F.col("w") + F.col("h")))
    ).otherwise(0.0)
    return d.withColumns({
        "aabb_x": F.col("cx") - F.col("aabb_w") / 2.0,
        "aabb_y": F.col("cy") - F.col("aabb_h") / 2.0,
        "is_vertical": is_vertical(F.col("w"), F.col("h")),
        "axis_aligned": F.abs(F.radians("angle_deg")) <= tolerance,
        "unclip_w": F.col("w") + 2.0 * expand,
        "unclip_h": F.col("h") + 2.0 * expand,
    })


def map_local_rects(rects: DataFrame) -> DataFrame:
    """Rectangles ``(lx, ly, lw, lh)`` of a frame's own space to page boxes."""
    c, s = F.cos(F.radians("angle_deg")), F.sin(F.radians("angle_deg"))
    mx = F.col("lx") + F.col("lw") / 2.0 - F.col("w") / 2.0
    my = F.col("ly") + F.col("lh") / 2.0 - F.col("h") / 2.0
    width = F.col("lw") * F.abs(c) + F.col("lh") * F.abs(s)
    height = F.col("lw") * F.abs(s) + F.col("lh") * F.abs(c)
    x = F.col("cx") + mx * c - my * s - width / 2.0
    y = F.col("cy") + mx * s + my * c - height / 2.0
    as_px = lambda v: F.round(v).cast("int")
    return rects.withColumns({
        "x": as_px(x), "y": as_px(y),
        "bw": F.greatest(as_px(width), F.lit(1)), "bh": F.greatest(as_px(height), F.lit(1)),
    })


# -- the grid ------------------------------------------------------------------------


def _with_grid(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``_gx``/``_gy`` (cell size) and ``_g`` (cells per axis) of the page."""
    n = boxes.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n"))
    g = F.least(F.lit(MAX_GRID), F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_n") / F.lit(PER_CELL))))).cast("int")
    grid = n.join(pages.select("page_id", "img_w", "img_h"), "page_id").withColumn("_g", g)
    return boxes.join(
        grid.select(
            "page_id", "img_w", "img_h", "_g", (F.col("img_w") / F.col("_g")).alias("_gx"), (F.col("img_h") / F.col("_g")).alias("_gy")
        ),
        "page_id",
    )


def _cell(v: Column, size: str) -> Column:
    return F.least(F.col("_g") - 1, F.greatest(F.lit(0), F.floor(v / F.col(size)).cast("int")))


def _at_point(d: DataFrame, x: Column, y: Column) -> DataFrame:
    return d.withColumns({"_cx": _cell(x, "_gx"), "_cy": _cell(y, "_gy")})


def _over_area(d: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    d = d.withColumn("_cx", F.explode(F.sequence(_cell(x0, "_gx"), F.greatest(_cell(x0, "_gx"), _cell(x1, "_gx")))))
    return d.withColumn("_cy", F.explode(F.sequence(_cell(y0, "_gy"), F.greatest(_cell(y0, "_gy"), _cell(y1, "_gy")))))


CELL = ["page_id", "_cx", "_cy"]


# -- G02, G03, G04 ---------------------------------------------------------------------


def _ruby_rules() -> tuple[Column, Column]:
    """Whether box ``s_`` is ruby of box ``b_``, beside a tall one or above a wide one."""
    e = F.expr
    overlap = lambda a, n: f"greatest(least(s_{a} + s_{n}, b_{a} + b_{n}) - greatest(s_{a}, b_{a}), 0)"
    middle = e("(s_x + s_x + s_w) div 2")
    vertical = (
        (F.col("s_h") < F.col("b_h") * fx.RUBY_SIZE)
        & (F.col("s_h") < F.col("img_h") * fx.RUBY_MAX_SIDE)
        & (F.col("s_uw") < F.col("b_uw") * fx.RUBY_WIDTH)
        & ((middle < F.col("b_x")) | (middle > e("b_x + b_w")))
        & (e("greatest(greatest(s_ux, b_ux) - least(s_ux + s_uw, b_ux + b_uw), 0)") <= F.col("b_uw") * fx.RUBY_GAP)
        & (e(overlap("y", "h")) >= F.col("s_h") * fx.RUBY_OVERLAP)
    )
    horizontal = (
        (F.col("s_h") < F.col("b_h") * fx.RUBY_THIN)
        & (F.col("s_h") < F.col("img_h") * fx.RUBY_MAX_SIDE)
        & (F.col("s_uh") < F.col("b_uh") * fx.RUBY_SHORT_H)
        & (F.col("s_uw") < F.col("b_uw") * fx.RUBY_WIDTH_H)
        & (e("s_y + s_h") <= F.col("b_y") + 2)
        & (e("b_uy - (s_uy + s_uh)") <= F.col("b_uh") * fx.RUBY_GAP)
        & (e(overlap("x", "w")) >= F.col("s_w") * fx.RUBY_OVERLAP)
    )
    return vertical, horizontal


def ruby_pairs(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """``(page_id, box_idx)`` of boxes that are ruby of a larger one.

    ``boxes(page_id, box_idx, x, y, w, h, ux, uy, uw, uh)``: raw geometry and the
    unclipped box around it; sizes are positive.  Sizes, centres and overlap
    are raw, gap and short side unclipped.
    """
    d = _with_grid(boxes, pages)
    tall, square = is_vertical(F.col("w"), F.col("h")), F.least("w", "h") >= F.greatest("w", "h") / fx.VERTICAL_ASPECT
    small = lambda kind, rows: rows.select(
        *CELL, F.lit(kind).alias("kind"), "box_idx", *[F.col(c).alias(f"s_{c}") for c in ("x", "y", "w", "h", "ux", "uy", "uw", "uh")]
    )
    beside = _at_point(d.filter(tall | square), F.col("ux") + F.col("uw") / 2.0, F.col("y") + F.col("h") / 2.0)
    above = _at_point(d.filter(~tall | square), F.col("x") + F.col("w") / 2.0, (F.col("y") + F.col("h")).cast("double"))
    big_cols = ["box_idx", "x", "y", "w", "h", "ux", "uy", "uw", "uh"]
    big = lambda kind, rows: rows.select(
        *CELL, F.lit(kind).alias("kind"), "img_w", "img_h", *[F.col(c).alias(f"b_{c}") for c in big_cols]
    )
    # how far a ruby's reference point can lie from the box it annotates
    reach = F.col("uw") * (fx.RUBY_GAP + fx.RUBY_WIDTH / 2.0) + 1.0
    columns = _over_area(
        d.filter(tall & (F.col("h") >= F.col("img_h") * fx.RUBY_MIN_BIG)),
        F.col("ux") - reach, F.col("ux") + F.col("uw") + reach, F.col("y") - 1.0, F.col("y") + F.col("h") + 1.0,
    )
    rows = _over_area(
        d.filter(~tall & (F.col("w") >= F.col("img_w") * fx.RUBY_MIN_BIG)),
        F.col("x") - 1.0, F.col("x") + F.col("w") + 1.0,
        F.col("uy") - F.col("uh") * (fx.RUBY_GAP + fx.RUBY_SHORT_H) - 1.0, F.col("y") + 3.0,
    )
    pairs = small("v", beside).unionByName(small("h", above)).join(
        big("v", columns).unionByName(big("h", rows)), [*CELL, "kind"]
    ).filter("box_idx <> b_box_idx")
    vertical, horizontal = _ruby_rules()
    rule = F.when(F.col("kind") == "v", vertical).otherwise(horizontal)
    return pairs.filter(rule).select("page_id", "box_idx").distinct()


def drop_ruby(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes that are not ruby."""
    return boxes.join(ruby_pairs(boxes, pages), ["page_id", "box_idx"], "left_anti")


def _holds() -> Column:
    """Whether a frame holds the centre ``(px, py)`` of a smaller one."""
    dx, dy = F.col("px") - F.col("cx"), F.col("py") - F.col("cy")
    c, s = F.cos(F.radians("angle_deg")), F.sin(F.radians("angle_deg"))
    inside = (F.abs(dx * c + dy * s) <= F.col("w") / 2.0) & (F.abs(-dx * s + dy * c) <= F.col("h") / 2.0)
    return (F.col("idx") != F.col("i_idx")) & (F.col("i_area") < F.col("w") * F.col("h") * fx.ENCLOSED_AREA) & inside


def drop_enclosing(frames: DataFrame, pages: DataFrame) -> DataFrame:
    """Drop frames that hold the centres of two or more smaller,
    line-shaped frames.  ``frames(page_id, idx, cx, cy, w, h, angle_deg)``."""
    d = _with_grid(frame_columns(frames), pages)
    lean = F.greatest("w", "h") >= fx.ENCLOSED_ASPECT * F.least("w", "h")
    inner = _at_point(d.filter(lean), F.col("cx"), F.col("cy")).select(
        *CELL, F.col("idx").alias("i_idx"), F.col("cx").alias("px"), F.col("cy").alias("py"), (F.col("w") * F.col("h")).alias("i_area")
    )
    outer = _over_area(
        d, F.col("aabb_x"), F.col("aabb_x") + F.col("aabb_w"), F.col("aabb_y"), F.col("aabb_y") + F.col("aabb_h")
    ).select(*CELL, "idx", "cx", "cy", "w", "h", "angle_deg")
    held = outer.join(inner, CELL).filter(_holds())
    blobs = held.groupBy("page_id", "idx").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= fx.ENCLOSED_COUNT)
    return frames.join(blobs.select("page_id", "idx"), ["page_id", "idx"], "left_anti")


def _frame_rect(frames: DataFrame, names: tuple[str, ...] | str) -> DataFrame:
    return frame_columns(frames).select(
        "page_id", F.col("idx").alias("box_idx"), *[F.round(F.col(c)).cast("int").alias(n) for c, n in zip(("aabb_x", "aabb_y", "aabb_w", "aabb_h"), names)]
    )


def prefilter_frames(frames: DataFrame, raw: DataFrame, pages: DataFrame, ruby: bool = True) -> DataFrame:
    """Ruby, minimum size, enclosing frames, then the vertical inset.

    ``raw`` holds the same frames before unclipping.  Pages of up to ``PER_CELL`` frames, one cell each, are compared where
    they are; larger ones go through the grid.
    """
    large = frames.groupBy("page_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > PER_CELL).select("page_id")
    large = written(large, "large-pages")
    if large.isEmpty():
        kept = _prefiltered_near(frames, raw, pages, ruby)
    else:
        near, far = (frames.join(large, "page_id", how) for how in ("left_anti", "left_semi"))
        near_raw, far_raw = (raw.join(large, "page_id", how) for how in ("left_anti", "left_semi"))
        kept = _prefiltered_near(near, near_raw, pages, ruby).unionByName(_prefiltered(far, far_raw, pages, ruby))
    inset = F.when(is_vertical(F.col("w"), F.col("h")), F.col("w") * (1.0 - 2.0 * fx.VERTICAL_INSET)).otherwise(F.col("w"))
    return kept.withColumn("w", inset)


def _large_enough(frames: DataFrame) -> DataFrame:
    return frames.filter((F.col("w") >= fx.MIN_FRAME_SIDE) & (F.col("h") >= fx.MIN_FRAME_SIDE))


def _prefiltered(frames: DataFrame, raw: DataFrame, pages: DataFrame, ruby: bool) -> DataFrame:
    d = frames
    if ruby:
        boxes = _frame_rect(raw, "xywh").join(_frame_rect(frames, ("ux", "uy", "uw", "uh")), ["page_id", "box_idx"])
        gone = ruby_pairs(boxes, pages).withColumnRenamed("box_idx", "idx")
        d = d.join(gone, ["page_id", "idx"], "left_anti")
    return drop_enclosing(_large_enough(d), pages)


def _prefiltered_near(frames: DataFrame, raw: DataFrame, pages: DataFrame, ruby: bool) -> DataFrame:
    """As ``_prefiltered``, by joins on the page alone: rows that are dealt by page stay where they are."""
    same = lambda a, b: F.col(a) - F.col(b) == 0  # noqa: E731 - not a key, by which rows would be dealt anew
    sized = pages.select("page_id", "img_w", "img_h")

    def without(d: DataFrame, gone: DataFrame) -> DataFrame:
        gone = gone.select(F.col("page_id").alias("_page"), F.col("idx").alias("_idx"))
        return d.join(gone, (F.col("page_id") == F.col("_page")) & same("idx", "_idx"), "left_anti")

    d = frames
    if ruby:
        rects = _frame_rect(raw, "xywh").withColumnRenamed("box_idx", "raw_idx").join(_frame_rect(frames, ("ux", "uy", "uw", "uh")), "page_id")
        rects = rects.filter(same("raw_idx", "box_idx"))
        tall, square = is_vertical(F.col("w"), F.col("h")), F.least("w", "h") >= F.greatest("w", "h") / fx.VERTICAL_ASPECT
        rects = rects.withColumns({"tall": tall, "square": square})
        named = lambda p: rects.select("page_id", *[F.col(c).alias(f"{p}_{c}") for c in ("box_idx", "x", "y", "w", "h", "ux", "uy", "uw", "uh", "tall", "square")])
        vertical, horizontal = _ruby_rules()
        beside = (F.col("s_tall") | F.col("s_square")) & F.col("b_tall") & (F.col("b_h") >= F.col("img_h") * fx.RUBY_MIN_BIG) & vertical
        above = (~F.col("s_tall") | F.col("s_square")) & ~F.col("b_tall") & (F.col("b_w") >= F.col("img_w") * fx.RUBY_MIN_BIG) & horizontal
        pairs = named("s").join(named("b"), "page_id").join(sized, "page_id").filter((F.col("s_box_idx") != F.col("b_box_idx")) & (beside | above))
        d = without(d, pairs.select("page_id", F.col("s_box_idx").alias("idx")).distinct())
    d = _large_enough(d)
    lean = F.greatest("w", "h") >= fx.ENCLOSED_ASPECT * F.least("w", "h")
    inner = d.filter(lean).select("page_id", F.col("idx").alias("i_idx"), F.col("cx").alias("px"), F.col("cy").alias("py"), (F.col("w") * F.col("h")).alias("i_area"))
    outer = d.withColumn("angle_deg", normalise_angle(F.col("angle_deg"))).select("page_id", "idx", "cx", "cy", "w", "h", "angle_deg")
    held = outer.join(inner, "page_id").filter(_holds()).join(sized.select("page_id"), "page_id")
    blobs = held.groupBy("page_id", "idx").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= fx.ENCLOSED_COUNT)
    return without(d, blobs)


# -- independent parts of a page ---------------------------------------------------------


def _bands(boxes: DataFrame, start: str, length: str) -> DataFrame:
    """Refine ``_part``: a new band begins where all earlier boxes of the part, along one axis, have ended."""
    keys = ["page_id", "_part"]
    tie = [F.col("box_idx")]
    end = (F.col(start) + F.col(length)).cast("long")
    d = ordered.prefix_max(boxes, keys, start, end, "_far", tie)
    opens = (F.col("_far").isNotNull() & (F.col("_far") <= F.col(start))).cast("long")
    d = ordered.prefix_sums(d.withColumn("_o", opens), keys, start, {"_band": F.col("_o")}, order=tie, inclusive=True)
    part = F.xxhash64("_part", F.lit(start), "_band")
    return d.withColumn("_part", part).drop("_far", "_o", "_band")


def column_parts(boxes: DataFrame) -> DataFrame:
    """Add ``_part``: boxes of different parts never share an x, so neither do their unions or cuts."""
    return _bands(boxes.withColumn("_part", F.lit(0).cast("long")), "x", "w")


def independent_parts(boxes: DataFrame) -> DataFrame:
    """Add ``_part``: boxes of different parts are kept apart by an empty strip, so their unions never meet."""
    return _bands(written(column_parts(boxes), "parts"), "y", "h")


def crowded_parts(boxes: DataFrame) -> DataFrame:
    """Parts in which some box begins before an earlier one has ended, from above: all others have no two boxes that overlap."""
    keys = ["page_id", "_part"]
    d = ordered.prefix_max(boxes, keys, "y", (F.col("y") + F.col("h")).cast("long"), "_far", [F.col("box_idx")])
    return d.filter(F.col("_far") > F.col("y")).select(*keys).distinct()


# -- G05, G06 ----------------------------------------------------------------------------


MERGED = "page_id long, x int, y int, w int, h int, confidence double, members int"


def _merge_fold(threshold: float):
    def joins(a: dict, b: dict) -> bool:
        ix = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
        iy = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
        area = min(a["w"] * a["h"], b["w"] * b["h"])
        if ix <= 0 or iy <= 0 or area <= 0 or ix * iy / area < threshold:
            return False
        return abs(a["y"] + a["h"] / 2.0 - b["y"] - b["h"] / 2.0) <= (a["h"] + b["h"]) / 2.0

    def fold(rows: list[dict]) -> list[tuple]:
        out = []
        waiting = rows
        while waiting:
            cur, rest = {**waiting[0], "members": 1}, []
            for box in waiting[1:]:
                if not joins(cur, box):
                    rest.append(box)
                    continue
                x, y = min(cur["x"], box["x"]), min(cur["y"], box["y"])
                cur["w"] = max(cur["x"] + cur["w"], box["x"] + box["w"]) - x
                cur["h"] = max(cur["y"] + cur["h"], box["y"] + box["h"]) - y
                cur["x"], cur["y"] = x, y
                cur["confidence"] = max(cur["confidence"], box["confidence"])
                cur["members"] += 1
            out.append(tuple(cur[c] for c in ("page_id", "x", "y", "w", "h", "confidence", "members")))
            waiting = rest
        return out

    return fold


def merge_overlapping(boxes: DataFrame, threshold: float = fx.MERGE_OVERLAP) -> DataFrame:
    """Greedy union of overlapping boxes, largest first, with the running
    union.  ``boxes(page_id, box_idx, x, y, w, h, confidence, is_rotated)``.

    Rotated frames pass through.  Only parts where boxes can overlap are
    folded; the rest are untouched.
    """
    straight = written(independent_parts(boxes.filter("not is_rotated").drop("is_rotated")), "parts")
    touched = crowded_parts(straight)
    keys = ["page_id", "_part"]
    area = F.col("w").cast("long") * F.col("h")
    folded = ordered.fold_groups(
        straight.join(touched, keys, "left_semi").withColumn("_area", -area), keys, [F.col("_area"), F.col("box_idx")],
        _merge_fold(threshold), MERGED,
    )
    plain = lambda d: d.select(
        "page_id", "x", "y", "w", "h", F.col("confidence").cast("double").alias("confidence"), F.lit(1).alias("members")
    )
    return folded.unionByName(plain(straight.join(touched, keys, "left_anti"))).unionByName(plain(boxes.filter("is_rotated")))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Position of each box in reading order.

    ``boxes(page_id, box_idx, x, y, w, h)`` and, where known, the frame's own
    ``frame_w``/``frame_h``, which then decide the orientation.
    """
    own = {"frame_w", "frame_h"} <= set(boxes.columns)
    fw, fh = (F.coalesce("frame_w", "w"), F.coalesce("frame_h", "h")) if own else (F.col("w"), F.col("h"))
    d = boxes.withColumn("_v", is_vertical(fw, fh))
    d = d.withColumns({
        "_first": F.when(F.col("_v"), -(F.col("x") + F.col("w"))).otherwise(F.col("y")),
        "_second": F.when(F.col("_v"), F.col("y")).otherwise(F.col("x")),
    })
    bucket = F.struct(F.col("_v"), F.floor(F.col("_first") / 64))
    order = [F.col("_v"), F.col("_first"), F.col("_second"), F.col("box_idx")]
    return ordered.ranked(d, PAGE, bucket, order, "position").drop("_v", "_first", "_second")


# -- G07 ---------------------------------------------------------------------------------

DIRECTIONS = ("N", "S", "E", "W")
_ALONG = {"N": ("y", -1), "S": ("y", 1), "E": ("x", 1), "W": ("x", -1)}
LOCAL, FAR, WRAP = 1, 2, 3


def box_positions(boxes: DataFrame, whole: bool = False) -> DataFrame:
    """Centres in units of the page extent.  With ``whole`` a page's boxes come into one task, and what follows by page
    needs no shuffle of its own."""
    extent = {
        "_mx": F.max(F.col("x") + F.col("w")),
        "_my": F.max(F.col("y") + F.col("h")),
        "_n": F.count(F.lit(1)),
    }
    if whole:
        page = Window.partitionBy("page_id")
        sized = boxes.select("page_id", "box_idx", "x", "y", "w", "h", *[c.over(page).alias(n) for n, c in extent.items()])
    else:
        sized = boxes.join(boxes.groupBy("page_id").agg(*[c.alias(n) for n, c in extent.items()]), "page_id")
    return sized.select(
        "page_id", "box_idx",
        ((F.col("x") + F.col("w") / 2.0) / F.greatest("_mx", F.lit(1))).alias("px"),
        ((F.col("y") + F.col("h") / 2.0) / F.greatest("_my", F.lit(1))).alias("py"),
        "_n",
    )


def _split_pages(boxes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Positions of pages whose boxes can be compared one by one, and those of larger pages, if there are any."""
    largest = ordered.largest_group(boxes, PAGE)
    points = box_positions(boxes, whole=largest <= ordered.BLOCK)
    if largest <= PER_CELL:
        return points, None
    return points.filter(F.col("_n") <= PER_CELL), points.filter(F.col("_n") > PER_CELL)


def _pairs_of_pages(points: DataFrame, phase: int) -> DataFrame:
    """Pairs of boxes of a page that face each other; boxes are shuffled once, by page, pairs never."""
    src = points.select("page_id", F.col("box_idx").alias("src"), "px", "py")
    dst = points.select("page_id", F.col("box_idx").alias("dst"), F.col("px").alias("jx"), F.col("py").alias("jy"))
    pairs = src.join(dealt(dst), "page_id").filter("src <> dst")
    return _facing(pairs.withColumn("dir", F.explode(F.array(*map(F.lit, DIRECTIONS)))), phase)


def _targets(points: DataFrame, phase: int) -> DataFrame:
    """Targets per direction; in the wrapped phase they are moved by one page,
    so that every phase looks straight ahead."""
    rows = points.select("page_id", F.col("box_idx").alias("dst"), F.col("px").alias("jx"), F.col("py").alias("jy"))
    rows = rows.withColumn("dir", F.explode(F.array(*map(F.lit, DIRECTIONS))))
    if phase != WRAP:
        return rows.withColumns({"tx": F.col("jx"), "ty": F.col("jy")})
    d = F.col("dir")
    return rows.withColumns({
        "tx": F.col("jx") + F.when(d == "E", 1.0).when(d == "W", -1.0).otherwise(0.0),
        "ty": F.col("jy") + F.when(d == "S", 1.0).when(d == "N", -1.0).otherwise(0.0),
    })


def _facing(pairs: DataFrame, phase: int) -> DataFrame:
    """Keep pairs inside the 45 degree cone and add their cost."""
    d = F.col("dir")
    ahead = (
        F.when(d == "N", F.col("py") - F.col("jy")).when(d == "S", F.col("jy") - F.col("py"))
        .when(d == "E", F.col("jx") - F.col("px")).otherwise(F.col("px") - F.col("jx"))
    )
    upright = d.isin("N", "S")
    aside = F.when(upright, F.abs(F.col("px") - F.col("jx"))).otherwise(F.abs(F.col("py") - F.col("jy")))
    euclid = F.sqrt(F.pow(F.col("px") - F.col("jx"), 2) + F.pow(F.col("py") - F.col("jy"), 2))
    if phase == WRAP:
        # a target one page away lies on the other side of its source; a page is added to the difference, not to the place,
        # which would round it
        pairs, ahead = pairs.filter(ahead < 0), ahead + 1.0
    p = pairs.filter("src <> dst").withColumns({"ahead": ahead, "aside": aside, "euclid": euclid})
    p = p.filter((F.col("ahead") > 0) & (F.col("aside") <= F.col("ahead")))
    if phase == LOCAL:
        return p.filter(F.col("euclid") <= fx.NAV_RADIUS).withColumn("cost", F.col("ahead") + fx.NAV_WEIGHT_LOCAL * F.col("aside"))
    if phase == WRAP:
        p = p.withColumn("aside", F.least("aside", 1.0 - F.col("aside")))
    return p.withColumn("euclid", F.lit(0.0)).withColumn("cost", F.col("ahead") + fx.NAV_WEIGHT_FAR * F.col("aside"))


_SOURCE = ["page_id", "src", "dir"]


def directional_neighbours(boxes: DataFrame, phase: int, k: int = fx.NAV_K) -> DataFrame:
    """The k cheapest targets per box and direction.

    Boxes of an ordinary page are compared with each other.  On larger pages the local phase looks through cells of its own radius.  The others search
    the page grid in squares around the source that double in size: a target
    outside a square costs at least its half width, so a source is finished as
    soon as its k-th cost is below that.
    """
    points, large = _split_pages(boxes)
    w = Window.partitionBy(*_SOURCE).orderBy("cost", "euclid", "dst")
    near = _pairs_of_pages(points, phase).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    near = near.select(*_SOURCE, "rank", "dst", "cost")
    return near if large is None else near.unionByName(_searched_neighbours(large, phase, k))


def _searched_neighbours(points: DataFrame, phase: int, k: int) -> DataFrame:
    if phase == LOCAL:
        points = points.withColumn("_g", F.lit(int(1 / fx.NAV_RADIUS)))
        sizes, radii = 1, [1]
    else:
        g = F.least(F.lit(64), F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_n") / F.lit(PER_CELL))))).cast("int")
        points = points.withColumn("_g", g)
        sizes = points.agg(F.max("_g")).first()[0] or 1
        radii = [2**i for i in range(math.ceil(math.log2(sizes)) + 2)] if sizes > 1 else [1]
        points = written(points, "points") if sizes > 1 else points
    cell = lambda v: F.floor(v * F.col("_g")).cast("int")
    targets = _targets(points.select("page_id", "box_idx", "px", "py"), phase).join(
        points.select("page_id", "_g").distinct(), "page_id"
    )
    targets = targets.select(
        "page_id", "dir", "dst", "jx", "jy", "tx", "ty", cell(F.col("tx")).alias("_cx"), cell(F.col("ty")).alias("_cy")
    )
    waiting = points.select("page_id", F.col("box_idx").alias("src"), "px", "py", "_g").withColumn(
        "dir", F.explode(F.array(*map(F.lit, DIRECTIONS)))
    )
    found = None
    for i, r in enumerate(radii):
        d = F.col("dir")
        span = lambda v, back, ahead: F.sequence(
            cell(v) - F.when(d == back, 0).otherwise(r), cell(v) + F.when(d == ahead, 0).otherwise(r)
        )
        around = waiting.withColumn("_cx", F.explode(span(F.col("px"), "E", "W"))).withColumn(
            "_cy", F.explode(span(F.col("py"), "S", "N"))
        )
        ranked = _facing(around.join(targets, ["page_id", "dir", "_cx", "_cy"]), phase)
        w = Window.partitionBy(*_SOURCE).orderBy("cost", "euclid", "dst")
        top = ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        top = top.select(*_SOURCE, "rank", "dst", "cost", "_g")
        if i == len(radii) - 1:
            return top.drop("_g") if found is None else found.unionByName(top.drop("_g"))
        top = written(top, "neighbours")
        sure = F.col("cost") <= F.lit(float(r)) / F.col("_g")
        done = top.filter((F.col("rank") == k) & sure).select(*_SOURCE)
        covered = waiting.filter(F.col("_g") <= F.lit(r)).select(*_SOURCE)
        done = written(done.unionByName(covered).distinct(), "finished")
        kept = top.join(done, _SOURCE, "left_semi").drop("_g")
        found = kept if found is None else found.unionByName(kept)
        waiting = waiting.join(done, _SOURCE, "left_anti")
    raise AssertionError("unreachable")


#: Boxes of a strip: what a box is compared with one by one.
STRIP_BOXES = 512
# in these frames the cone of a direction is what lies further on both axes
_FRAMES = {"S": (1, 1), "N": (-1, -1), "E": (1, -1), "W": (-1, 1)}
_PER_DIR = ["page_id", "dir"]


def _strips(points: DataFrame, axis: str, size: int) -> DataFrame:
    """Each point's strip along ``axis``: about ``size`` points, equal values in one strip."""
    counts = points.groupBy(*_PER_DIR, axis).agg(F.count(F.lit(1)).alias("_m"))
    before = ordered.prefix_sums(counts, _PER_DIR, axis, {"_before": F.col("_m")})
    strip = before.select(*_PER_DIR, axis, F.floor(F.col("_before") / F.lit(size)).cast("int").alias("_raw"))
    # without holes, so that a strip's neighbours are those next to it
    kept = strip.groupBy(*_PER_DIR, "_raw").agg(F.lit(1).alias("_one"))
    dense = ordered.prefix_sums(kept, _PER_DIR, "_raw", {f"s{axis}": F.col("_one")}).select(*_PER_DIR, "_raw", F.col(f"s{axis}").cast("int").alias(f"s{axis}"))
    return points.join(strip.join(dense, [*_PER_DIR, "_raw"]).drop("_raw"), [*_PER_DIR, axis])


def _further(points: DataFrame) -> DataFrame:
    """Per cell ``(su, sw)`` the points at least two strips further on both axes: they are surely in the cone."""
    cells = points.groupBy(*_PER_DIR, "su", "sw").agg(F.count(F.lit(1)).cast("long").alias("_m"))
    top = cells.groupBy(*_PER_DIR).agg(F.max("su").alias("_u"), F.max("sw").alias("_w")).filter("_u >= 2 and _w >= 2")
    grid = top.withColumn("su", F.explode(F.sequence(F.lit(0), F.col("_u")))).withColumn("sw", F.explode(F.sequence(F.lit(0), F.col("_w"))))
    grid = grid.drop("_u", "_w").join(cells, [*_PER_DIR, "su", "sw"], "left").na.fill({"_m": 0})
    onward = lambda keys, by: Window.partitionBy(*_PER_DIR, keys).orderBy(by).rowsBetween(2, Window.unboundedFollowing)
    row = grid.withColumn("_r", F.coalesce(F.sum("_m").over(onward("su", "sw")), F.lit(0)))
    return row.withColumn("sure", F.coalesce(F.sum("_r").over(onward("sw", "su")), F.lit(0))).select(*_PER_DIR, "su", "sw", "sure")


def _far_counts(points: DataFrame, size: int) -> DataFrame:
    """Dominance counting: with ``u = x + y`` and ``w = y - x`` a cone is a quadrant.

    Whole cells of strips that lie two strips further on both axes are added up; boxes of the strips around a box are compared with it.
    """
    frames = F.explode(F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(a).alias("a"), F.lit(b).alias("b")) for d, (a, b) in _FRAMES.items()]))
    units = lambda v: F.floor(v * F.lit(1e6)).cast("long")
    d = points.select("page_id", "box_idx", "px", "py", frames.alias("f")).select(
        "page_id", "box_idx", "px", "py", "f.dir",
        units((F.col("px") + F.col("py")) * F.col("f.a")).alias("u"), units((F.col("py") - F.col("px")) * F.col("f.b")).alias("w"),
    )
    d = written(_strips(_strips(written(d, "frames"), "u", size), "w", size).drop("u", "w"), "strips")
    source = d.select(*_PER_DIR, F.col("box_idx").alias("src"), "px", "py", "su", "sw")
    target = d.select(*_PER_DIR, F.col("box_idx").alias("dst"), F.col("px").alias("jx"), F.col("py").alias("jy"), F.col("su").alias("tu"), F.col("sw").alias("tw"))
    target = target.withColumns({"tx": F.col("jx"), "ty": F.col("jy")})
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    beside = source.withColumn("tu", around("su")).join(target, [*_PER_DIR, "tu"]).filter("tw >= sw - 1")
    ahead = source.withColumn("tw", around("sw")).join(target, [*_PER_DIR, "tw"]).filter("tu >= su + 2")
    near = [_facing(p, FAR).groupBy(*_SOURCE).agg(F.count(F.lit(1)).alias("n")) for p in (beside, ahead)]
    sure = source.join(_further(d), [*_PER_DIR, "su", "sw"]).select(*_SOURCE, F.col("sure").alias("n"))
    return near[0].unionByName(near[1]).unionByName(sure).groupBy(*_SOURCE).agg(F.sum("n").alias("n")).filter("n > 0")


def candidate_counts(boxes: DataFrame, phase: int, size: int = STRIP_BOXES) -> DataFrame:
    """How many targets each box has per direction.

    Pairs are counted where they are met and never shuffled or kept: those of an ordinary page, on larger ones in the far phase those of strips of about ``size`` boxes, in the
    local phase those of cells of its radius, in the wrapped phase those of a page.
    """
    points, large = _split_pages(boxes)
    small = _pairs_of_pages(points, phase).groupBy(*_SOURCE).agg(F.count(F.lit(1)).alias("n"))
    return small if large is None else small.unionByName(_searched_counts(large, phase, size))


def _searched_counts(points: DataFrame, phase: int, size: int) -> DataFrame:
    if phase == FAR:
        return _far_counts(points, size)
    src = points.select("page_id", F.col("box_idx").alias("src"), "px", "py")
    targets = _targets(points.select("page_id", "box_idx", "px", "py"), phase)
    if phase == LOCAL:
        cell = lambda c: F.floor(F.col(c) / F.lit(fx.NAV_RADIUS)).cast("int")
        near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
        src = src.withColumn("_cx", near("px")).withColumn("_cy", near("py"))
        pairs = src.join(targets.withColumns({"_cx": cell("tx"), "_cy": cell("ty")}), ["page_id", "_cx", "_cy"])
    else:
        pairs = src.join(targets, "page_id")
    return _facing(pairs, phase).groupBy(*_SOURCE).agg(F.count(F.lit(1)).alias("n"))


# -- G08, G09 ------------------------------------------------------------------------------

COMPONENTS = "page_id long, node long, component long"


def _components_fold(rows: list[dict]) -> list[tuple]:
    """Strong components of one page's graph; a component is named by its
    smallest node."""
    page = rows[0]["page_id"]
    ahead: dict[int, list[int]] = {}
    back: dict[int, list[int]] = {}
    for r in rows:
        for node in (r["src"], r["dst"]):
            ahead.setdefault(node, [])
            back.setdefault(node, [])
        ahead[r["src"]].append(r["dst"])
        back[r["dst"]].append(r["src"])
    finished: list[int] = []
    seen: set[int] = set()
    for start in sorted(ahead):
        stack = [(start, iter(ahead[start]))] if start not in seen else []
        seen.add(start)
        while stack:
            node, targets = stack[-1]
            nxt = next((t for t in targets if t not in seen), None)
            if nxt is None:
                finished.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(ahead[nxt])))
    label: dict[int, int] = {}
    for root in reversed(finished):
        if root in label:
            continue
        members, queue = [root], [root]
        label[root] = root
        while queue:
            for t in back[queue.pop()]:
                if t not in label:
                    label[t] = root
                    members.append(t)
                    queue.append(t)
        for m in members:
            label[m] = min(members)
    return [(page, node, comp) for node, comp in sorted(label.items())]


#: Edges of a page that a task may hold; larger pages are worked out in tables.
FOLD_EDGES = 100_000
_NODE = ["page_id", "node"]


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest node that reaches each node, as ``(page_id, node, color)``, to a fixed point."""
    at = lambda end: labels.select("page_id", F.col("node").alias(end), F.col("color").alias("_c"))
    while True:
        came = edges.join(at("src"), ["page_id", "src"]).groupBy("page_id", F.col("dst").alias("node")).agg(F.min("_c").alias("_c"))
        step = labels.join(came, _NODE, "left").select("page_id", "node", F.col("color").alias("_was"), F.least("color", F.coalesce("_c", "color")).alias("color"))
        # what reaches the node that reaches a node reaches that one too
        jump = labels.select("page_id", F.col("node").alias("color"), F.col("color").alias("_far"))
        step = step.join(jump, ["page_id", "color"], "left").select("page_id", "node", "_was", F.least("color", F.coalesce("_far", "color")).alias("color"))
        step = written(step, "colors")
        labels = step.select("page_id", "node", "color")
        if step.filter("color <> _was").isEmpty():
            return labels


def _reaching(colors: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that reach the node they are coloured by, along nodes of their colour."""
    inside = edges.join(colors.withColumnRenamed("node", "src"), ["page_id", "src"]).join(
        colors.select("page_id", F.col("node").alias("dst"), F.col("color").alias("_d")), ["page_id", "dst"]
    ).filter("color = _d").select("page_id", "src", "dst")
    inside = written(inside, "inside")
    front = written(colors.filter("node = color").select("page_id", "node", "color"), "reaching")
    found = front
    while True:
        back = inside.join(front.withColumnRenamed("node", "dst"), ["page_id", "dst"]).select("page_id", F.col("src").alias("node"), "color").distinct()
        front = written(back.join(found, _NODE, "left_anti"), "reaching")
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def _components_in_tables(edges: DataFrame) -> DataFrame:
    """Strong components by colours, for pages of any size.

    A node is coloured by the smallest node that reaches it; those of a colour that also reach that node are its component.
    Nodes without an edge to or from what is left are components of their own and go first; edges between colours
    go, as they lie in no component.  Every step is a written table, and no page meets in one task.
    """
    edges = written(edges.select("page_id", "src", "dst").distinct(), "edges")
    nodes = edges.select("page_id", F.col("src").alias("node")).union(edges.select("page_id", F.col("dst").alias("node"))).distinct()
    nodes = written(nodes, "nodes")
    done = None
    while not nodes.isEmpty():
        ends = lambda end: edges.filter("src <> dst").select("page_id", F.col(end).alias("node")).distinct()
        both = written(nodes.join(ends("src"), _NODE, "left_semi").join(ends("dst"), _NODE, "left_semi"), "between")
        alone = nodes.join(both, _NODE, "left_anti").select("page_id", "node", F.col("node").alias("color"))
        kept = lambda rows, of, end: rows.join(of.select("page_id", F.col("node").alias(end)), ["page_id", end], "left_semi")
        edges = written(kept(kept(edges, both, "src"), both, "dst"), "edges")
        colors = _spread(both.select("page_id", "node", F.col("node").alias("color")), edges)
        found = written(alone.unionByName(_reaching(colors, edges)), "components")
        done = found if done is None else done.unionByName(found)
        left = written(colors.join(found.select(*_NODE), _NODE, "left_anti"), "left")
        nodes = left.select(*_NODE)
        edges = kept(edges, nodes, "src").join(left.withColumnRenamed("node", "src"), ["page_id", "src"])
        edges = edges.join(left.select("page_id", F.col("node").alias("dst"), F.col("color").alias("_d")), ["page_id", "dst"])
        edges = written(edges.filter("color = _d").select("page_id", "src", "dst"), "edges")
    if done is None:
        return edges.select("page_id", F.col("src").alias("node"), F.col("dst").alias("component"))
    return done.select("page_id", "node", F.col("color").alias("component"))


def strong_components(edges: DataFrame, most: int = FOLD_EDGES) -> DataFrame:
    """Strong component of each node of each page's directed graph, named by its smallest node.

    Pages of up to ``most`` edges are searched in one task each, larger ones in tables.
    """
    edges = edges.select("page_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    large = written(edges.groupBy("page_id").count().filter(F.col("count") > most).select("page_id"), "large-pages")
    whole = ordered.fold_groups(edges.join(large, PAGE, "left_anti"), PAGE, [F.col("src"), F.col("dst")], _components_fold, COMPONENTS)
    if large.isEmpty():
        return whole
    return whole.unionByName(_components_in_tables(edges.join(large, PAGE, "left_semi")))


def strong_connectivity(edges: DataFrame) -> DataFrame:
    """Per page whether the graph is strongly connected."""
    comp = strong_components(edges)
    return comp.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.countDistinct("component").alias("components"),
        (F.countDistinct("component") == 1).alias("connected"),
    )


CUT_BOXES = "page_id long, box_idx long, x int, y int, w int, h int"


def _separate(rows: list[dict]) -> list[tuple]:
    """Boxes as vertical spans.  Of two that share an x and overlap, the end of the upper and the start of the lower
    one become the same line, halfway through what they share; a span keeps at least one pixel."""
    spans = [[r["y"], r["y"] + r["h"]] for r in rows]
    for (i, a), (j, b) in combinations(enumerate(rows), 2):
        if a["x"] >= b["x"] + b["w"] or b["x"] >= a["x"] + a["w"]:
            continue
        upper, lower = sorted((spans[i], spans[j]), key=itemgetter(0))
        if lower[0] < upper[1]:
            line = max(int((lower[0] + min(upper[1], lower[1])) / 2), upper[0] + 1)
            upper[1] = lower[0] = line
            lower[1] = max(lower[1], line + 1)
    return [(r["page_id"], r["box_idx"], r["x"], top, r["w"], end - top) for r, (top, end) in zip(rows, spans)]


def split_stacked(boxes: DataFrame) -> DataFrame:
    """Horizontal lines that overlap are cut apart, pair by pair in index
    order on the boxes as already cut.

    A cut moves boxes down but never sideways, so boxes that are connected by shared x
    are folded together and no others; a part without overlapping boxes is untouched.
    """
    flat = written(column_parts(boxes.filter(~is_vertical(F.col("w"), F.col("h")))), "parts")
    keys = ["page_id", "_part"]
    touched = crowded_parts(flat)
    cols = ["page_id", "box_idx", "x", "y", "w", "h"]
    cut = ordered.fold_groups(flat.join(touched, keys, "left_semi"), keys, [F.col("box_idx")], _separate, CUT_BOXES)
    rest = flat.join(touched, keys, "left_anti").select(cols)
    return cut.unionByName(rest).unionByName(boxes.filter(is_vertical(F.col("w"), F.col("h"))).select(cols))
