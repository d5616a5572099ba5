"""Recogniser evidence as long tables.

Tables: ``timesteps(line_id, t, rank, cls, ch, score)``, ``chars(line_id, idx, ch,
...)``, ``lines(line_id, n, is_vertical, ...)``.  Neighbour and running
computations go through ``ordered``, so a single very long line is spread over
many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx
from kotonoha.functions import text as tx
from kotonoha.functions.tables import dealt, written
from kotonoha.operators import ordered

LINE = ["line_id"]


# -- D01 - D05: decoding ---------------------------------------------------------


def decode_timesteps(logits: DataFrame, vocab: DataFrame, remap: DataFrame, k: int = fx.TOP_K) -> DataFrame:
    """The top-k classes of each timestep and their characters.

    ``logits(line_id, t, cls, score)``, ``vocab(idx, token)``, ``remap(pruned, cls)``;
    a class without a remap row stands for itself.  Ties go to the lower class.
    """
    w = Window.partitionBy("line_id", "t").orderBy(F.desc("score"), "cls")
    top = logits.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)
    to = remap.select(F.col("pruned").alias("cls"), F.col("cls").alias("_to"))
    d = top.join(to, "cls", "left").withColumn("cls", F.coalesce("_to", "cls")).drop("_to")
    tokens = vocab.select((F.col("idx") + 1).alias("cls"), F.left("token", F.lit(1)).alias("_first"))
    d = d.join(tokens, "cls", "left")
    cls = F.col("cls")
    ch = (
        F.when(cls == fx.SPACE_CLASS, " ")
        .when(cls.between(1, fx.FULL_SPACE_CLASS - 1), F.coalesce(F.nullif("_first", F.lit("")), F.lit(fx.REPLACEMENT_CHAR)))
        .otherwise(fx.BLANK_CHAR)
    )
    return d.select("line_id", "t", "rank", "cls", ch.alias("ch"), "score")


def _emissions(top: DataFrame, label: str, blank: Column, space: Column) -> DataFrame:
    """Greedy collapse of usable top rows: a label is emitted where it is not
    blank and differs from the previous one; a space is always emitted."""
    d = ordered.previous_values(top, LINE, "t", {"_before": label})
    kept = d.filter(~blank & (space | F.col("_before").isNull() | (F.col(label) != F.col("_before")))).drop("_before")
    return ordered.prefix_sums(kept, LINE, "t", {"char_idx": F.lit(1).cast("long")})


def ctc_collapse(timesteps: DataFrame) -> DataFrame:
    """Emitted characters with the timestep they came from."""
    top = timesteps.filter((F.col("rank") == 0) & (F.col("ch") != fx.REPLACEMENT_CHAR))
    d = _emissions(top, "cls", F.col("cls") == fx.BLANK_CLASS, F.col("cls") == fx.SPACE_CLASS)
    return d.select("line_id", "char_idx", "t", "cls", "ch", "score")


def line_text(chars: DataFrame, keys: list[str] = LINE, idx: str = "char_idx", ch: str = "ch") -> DataFrame:
    """The text of each line, joined per block first."""
    ordered_join = lambda c, i: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(i, c))), lambda s: s[c]), "")
    blocks = chars.withColumn("_b", F.floor(F.col(idx) / F.lit(ordered.BLOCK))).groupBy(*keys, "_b").agg(
        ordered_join(ch, idx).alias("_piece")
    )
    return blocks.groupBy(*keys).agg(ordered_join("_piece", "_b").alias("text"))


def peak_offset(left: Column, mid: Column, right: Column) -> Column:
    """Sub-column offset of a parabola through three scores."""
    denom = left - 2.0 * mid + right
    flat = (denom >= -1e-6) | (F.least(mid - left, mid - right) <= 1.0)
    offset = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (left - right) / denom))
    return F.when(left.isNull() | right.isNull() | flat, F.lit(0.0)).otherwise(offset)


def _columns(rows: DataFrame, label: str) -> DataFrame:
    """Fractional column of every ``(line, t, label)`` row from the scores of
    the same label one step before and after."""
    d, w = ordered.with_halo(rows, ["line_id", label], "t", 1, 1)
    side = lambda f, step: F.when(f("t").over(w) == F.col("t") + step, f("score").over(w))
    d = d.withColumns({"_l": side(F.lag, -1), "_r": side(F.lead, 1)})
    col = F.col("t") + peak_offset(F.col("_l"), F.col("score"), F.col("_r"))
    return ordered.home_rows(d.withColumn("col", col)).drop("_l", "_r")


def peak_columns(chars: DataFrame, timesteps: DataFrame) -> DataFrame:
    """Emitted characters with their fractional column."""
    cols = _columns(timesteps.select("line_id", "t", "cls", "score"), "cls").select("line_id", "t", "cls", "col")
    return chars.join(cols, ["line_id", "t", "cls"])


def redecode(timesteps: DataFrame, lines: DataFrame) -> DataFrame:
    """Decode again from cached characters alone.

    U+3000 is the blank, a space never collapses, neighbouring scores are
    matched by character (the best-ranked one of a step), and vertical lines
    get vertical punctuation.
    """
    by_char = timesteps.groupBy("line_id", "t", "ch").agg(F.min_by("score", "rank").alias("score"))
    cols = _columns(by_char, "ch").select("line_id", "t", "ch", "col")
    top = timesteps.filter("rank = 0").select("line_id", "t", "ch")
    d = _emissions(top, "ch", F.col("ch") == fx.BLANK_CHAR, F.col("ch") == " ").join(cols, ["line_id", "t", "ch"])
    d = d.join(lines.select("line_id", "is_vertical"), "line_id")
    ch = F.when(F.col("is_vertical"), tx.vertical_punctuation(F.col("ch"))).otherwise(F.col("ch"))
    return d.select("line_id", "char_idx", "t", ch.alias("ch"), "col")


def walk_columns(timesteps: DataFrame) -> DataFrame:
    """The bare column walk, ``(line_id, idx, col)``."""
    top = timesteps.filter("rank = 0").select("line_id", "t", "ch")
    d = _emissions(top, "ch", F.col("ch") == fx.BLANK_CHAR, F.col("ch") == " ")
    return d.select("line_id", F.col("char_idx").alias("idx"), F.col("t").cast("double").alias("col"))


def line_confidence(lines: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Mean over characters of the top softmax share; 0 with no lists."""
    top = F.max("score").over(Window.partitionBy("line_id", "char_idx"))
    per_char = alternatives.withColumn("_e", F.exp(F.col("score") - top)).groupBy("line_id", "char_idx").agg(
        (F.lit(1.0) / F.sum("_e")).alias("share")
    )
    per_line = per_char.groupBy("line_id").agg(F.avg("share").alias("confidence"))
    return lines.select("line_id").join(per_line, "line_id", "left").na.fill({"confidence": 0.0})


# -- D06 - D08: chunk stitching --------------------------------------------------


def agreement(a: Column, b: Column) -> Column:
    """Prediction overlap of two ranked alternative lists."""
    chars = lambda alts, n: F.transform(F.slice(alts, 1, n), lambda x: x["ch"])
    same = F.size(F.filter(chars(a, 5), lambda c: F.array_contains(chars(b, 5), c)))
    top_a, top_b = F.get(a, F.lit(0))["ch"], F.get(b, F.lit(0))["ch"]
    crossed = F.array_contains(chars(b, 3), top_a) | F.array_contains(chars(a, 3), top_b)
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when(top_a == top_b, F.lit(0.6) + same / F.lit(5.0) * 0.4)
        .when(crossed, 0.5)
        .otherwise(0.0)
    )


def overlap_pairs(chunk_chars: DataFrame) -> DataFrame:
    """The best pair joining each chunk to the next one of its line.

    ``chunk_chars(line_id, chunk, idx, n, centre, alts)``.  At most ten last and
    ten first characters meet, so a chunk pair yields at most a hundred rows.
    """
    tail = chunk_chars.filter(F.col("idx") >= F.col("n") - fx.STITCH_WINDOW).select(
        "line_id", F.col("chunk"), F.col("idx").alias("prev_idx"), F.col("centre").alias("_pc"), F.col("alts").alias("_pa")
    )
    head = chunk_chars.filter(F.col("idx") < fx.STITCH_WINDOW).select(
        "line_id", (F.col("chunk") - 1).alias("chunk"), F.col("idx").alias("curr_idx"), F.col("centre").alias("_cc"), F.col("alts").alias("_ca")
    )
    d = tail.join(head, ["line_id", "chunk"]).withColumn("dist", F.abs(F.col("_pc") - F.col("_cc")))
    d = d.filter(F.col("dist") <= fx.STITCH_MAX_DIST).withColumn("pred", agreement(F.col("_pa"), F.col("_ca")))
    d = d.filter(F.col("pred") >= fx.STITCH_MIN_AGREEMENT)
    score = (1.0 - F.col("dist") / fx.STITCH_MAX_DIST) * 0.3 + F.col("pred") * 0.7
    best = F.max(F.struct(score.alias("score"), F.col("prev_idx"), (-F.col("curr_idx")).alias("neg"))).alias("b")
    return d.groupBy("line_id", "chunk").agg(best).select(
        "line_id", "chunk", "b.prev_idx", (-F.col("b.neg")).alias("curr_idx"), "b.score"
    )


def merge_alternatives(a: Column, b: Column, k: int = fx.TOP_K) -> Column:
    """Union of two ranked lists; shared characters gain, others fade.
    Lists hold at most ``k`` items."""
    typed = lambda ch, score, pos: F.struct(ch.alias("ch"), score.cast("double").alias("score"), pos.cast("int").alias("pos"))
    empty = F.array().cast("array<struct<ch:string,score:double,pos:int>>")

    def put(acc: Column, item: Column, merged) -> Column:
        known = F.exists(acc, lambda x: x["ch"] == item["ch"])
        changed = F.transform(
            acc, lambda x: typed(x["ch"], F.when(x["ch"] == item["ch"], merged(x["score"], item["score"])).otherwise(x["score"]), x["pos"])
        )
        fresh = F.concat(acc, F.array(typed(item["ch"], merged(None, item["score"]), F.size(acc))))
        return F.when(known, changed).otherwise(fresh)

    first = F.aggregate(a, empty, lambda acc, i: put(acc, i, lambda old, new: new))
    second = lambda old, new: new * 0.6 if old is None else F.when(old > 0, (old + new) * 0.8).otherwise(new * 0.6)
    both = F.aggregate(b, first, lambda acc, i: put(acc, i, second))
    by_score = lambda x, y: (
        F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(x["pos"] - y["pos"])
    )
    return F.transform(F.slice(F.array_sort(both, by_score), 1, k), lambda x: F.struct(x["ch"], x["score"]))


_ITEM = "array<struct<ch:string,col:double,centre:double,alts:array<struct<ch:string,score:double>>>>"


def _without_double_spaces(items: Column, before: Column) -> Column:
    """Items without those spaces that follow a space; ``before`` is the character ahead of the first."""
    follows = lambda i: F.when(i == 0, before).otherwise(F.get(items, i - 1)["ch"])
    return F.filter(items, lambda x, i: ~((x["ch"] == " ") & F.coalesce(follows(i) == " ", F.lit(False))))


def _moved(items: Column, col: Column, centre: Column) -> Column:
    return F.transform(items, lambda x: F.struct(
        x["ch"].alias("ch"), (x["col"] + col).alias("col"), (x["centre"] + centre).alias("centre"), x["alts"].alias("alts")
    ))


def _join_of(rows: Column, items: Column) -> Column:
    """The best pair (D06's rule) of the last ten characters so far and a chunk's first ten: ``(score, place so far, -place in the chunk)``."""
    n = F.size(rows)
    head = F.slice(items, 1, fx.STITCH_WINDOW)

    def pairs_at(p: Column) -> Column:
        def pair(x: Column, c: Column) -> Column:
            kept = F.get(rows, p)
            dist, agree = F.abs(kept["centre"] - x["centre"]), agreement(kept["alts"], x["alts"])
            score = (1.0 - dist / fx.STITCH_MAX_DIST) * 0.3 + agree * 0.7
            fits = (dist <= fx.STITCH_MAX_DIST) & (agree >= fx.STITCH_MIN_AGREEMENT)
            return F.when(fits, F.struct(score.alias("score"), p.cast("int").alias("place"), (-c).cast("int").alias("back")))

        return F.transform(head, pair)

    places = F.sequence(F.greatest(n - fx.STITCH_WINDOW, F.lit(0)), n - 1)
    return F.when((n > 0) & (F.size(items) > 0), F.array_max(F.flatten(F.transform(places, pairs_at))))


def _with_chunk(rows: Column, chunk: Column) -> Column:
    """The characters so far and those a chunk adds."""
    items, n = chunk["items"], F.size(rows)
    last = F.get(rows, n - 1)

    def joined(best: Column) -> Column:
        kept, met = F.get(rows, best["place"]), F.get(items, -best["back"])
        both = F.struct(kept["ch"].alias("ch"), kept["col"].alias("col"), kept["centre"].alias("centre"), merge_alternatives(kept["alts"], met["alts"]).alias("alts"))
        rest = _moved(F.slice(items, 2 - best["back"], F.size(items)), kept["col"] - met["col"], kept["centre"] - met["centre"])
        return F.concat(F.slice(rows, 1, best["place"]), F.array(both).cast(_ITEM), _without_double_spaces(rest, kept["ch"]).cast(_ITEM))

    # without a pair: what lies beyond the last centre, a single character in any case, else the chunk one step on
    edge = F.coalesce(last["centre"], F.lit(-100.0)) + fx.STITCH_APPEND_GAP
    lone = (n > 0) & (F.size(items) == 1)
    beyond = F.filter(items, lambda x: lone | (x["centre"] > edge))
    beyond = _without_double_spaces(_moved(beyond, chunk["offset_px"] / chunk["step_px"], F.lit(0.0)), last["ch"])
    first = F.get(items, F.lit(0))
    next_ = _without_double_spaces(_moved(items, last["col"] + 1.0 - first["col"], last["centre"] + chunk["step_px"] - first["centre"]), last["ch"])
    added = F.when((F.size(beyond) > 0) | (n == 0), beyond).otherwise(next_).cast(_ITEM)
    # the pair is found once and then used
    found = F.transform(F.filter(F.array(_join_of(rows, items)), lambda b: b.isNotNull()), joined)
    return F.coalesce(F.get(found, F.lit(0)), F.concat(rows, added))


def stitch_lines(chunks: DataFrame) -> DataFrame:
    """Fold the overlapping chunks of each line into one line.

    ``chunks(line_id, chunk, offset_px, step_px, items)`` with ``items`` an array of
    ``(ch, col, centre, alts)``.  What a chunk adds depends on the text so far, so a line's chunks are
    folded in order as one array; lines are folded in parallel.
    """
    rows = chunks.select("line_id", F.struct(
        "chunk", F.col("offset_px").cast("double").alias("offset_px"), F.col("step_px").cast("double").alias("step_px"), F.col("items").cast(_ITEM).alias("items")
    ).alias("c"))
    lines = rows.groupBy("line_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    start = F.get("c", F.lit(0))["items"]
    text = F.aggregate(F.slice("c", 2, F.size("c")), start, _with_chunk)
    done = lines.select("line_id", text.alias("_text")).select("line_id", _without_double_spaces(F.col("_text"), F.lit("")).alias("_text"))
    return done.select("line_id", F.posexplode("_text").alias("_i", "x")).select(
        "line_id", F.col("_i").cast("long").alias("char_idx"), "x.ch", "x.col", "x.centre", "x.alts"
    )


# -- D09 - D12: gaps -------------------------------------------------------------


def _counted(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("line_id").agg(F.count(F.lit(1)).alias(name))


def gap_geometry(lines: DataFrame, boxes: DataFrame, columns: DataFrame, timesteps: DataFrame) -> DataFrame:
    """Character centres ``(line_id, idx, centre, unit)`` from the first source
    that describes the whole text: boxes, columns, walked timesteps.

    ``lines(line_id, n, is_vertical, crop_w, crop_h, seq_len)``.  Timesteps, the
    largest table, are read only for lines the other two do not cover.
    """
    usable = lines.filter("n >= 2")
    d = usable.join(_counted(boxes, "n_boxes"), "line_id", "left").join(_counted(columns, "n_cols"), "line_id", "left")
    d = d.na.fill({"n_boxes": 0, "n_cols": 0})
    length = F.when(F.col("is_vertical"), F.col("crop_h")).otherwise(F.col("crop_w"))
    stride = F.when((length > 0) & (F.col("seq_len") > 0), length / F.col("seq_len")).otherwise(fx.DEFAULT_STRIDE_PX)
    d = d.withColumn("unit", stride)
    by_box = d.filter("n_boxes >= n").join(boxes, "line_id").filter("idx < n").selectExpr(
        "line_id", "idx", "cast(if(is_vertical, y + h div 2, x + w div 2) as double) as centre", "cast(1 as double) as unit"
    )
    rest = d.filter("n_boxes < n")
    by_col = rest.filter("n_cols = n").join(columns, "line_id").select("line_id", "idx", F.col("col").alias("centre"), "unit")
    bare = rest.filter("n_cols <> n").select("line_id", "n", "unit")
    walked = written(walk_columns(timesteps.join(bare.select("line_id"), "line_id", "left_semi")), "walked")
    fits = _counted(walked, "n_walked").join(bare, "line_id").filter("n_walked = n").select("line_id", "unit")
    by_step = walked.join(fits, "line_id").select("line_id", "idx", F.col("col").alias("centre"), "unit")
    return by_box.unionByName(by_col).unionByName(by_step)


def spacings(geometry: DataFrame) -> DataFrame:
    """Spacing of each character to the one before it; ``insert_at`` is its index."""
    d, w = ordered.with_halo(geometry, LINE, "idx", 1, 0)
    d = d.withColumn("spacing", F.abs(F.col("centre") - F.lag("centre").over(w)))
    return ordered.home_rows(d).filter("spacing is not null").select(
        "line_id", F.col("idx").cast("int").alias("insert_at"), "spacing", "unit"
    )


def gap_ratios(geometry: DataFrame) -> DataFrame:
    """Every spacing over its line's median spacing.

    The spacings feed both the medians and the ratios; they are written once
    rather than derived again from the evidence.
    """
    s = written(spacings(geometry), "spacings")
    medians = ordered.group_medians(s, LINE, "spacing").filter("median > 0").select("line_id", "median")
    return s.join(medians, "line_id").select(
        "line_id", "insert_at", (F.col("spacing") / F.col("median")).alias("ratio"), (F.col("spacing") * F.col("unit")).alias("span_px")
    )


def detect_gaps(
    lines: DataFrame, boxes: DataFrame, columns: DataFrame, timesteps: DataFrame,
    vertical: float = fx.GAP_RATIO_VERTICAL, horizontal: float = fx.GAP_RATIO_HORIZONTAL,
) -> DataFrame:
    """Gaps where spacing over median reaches the orientation's threshold."""
    ratios = gap_ratios(gap_geometry(lines, boxes, columns, timesteps))
    threshold = F.when(F.col("is_vertical"), vertical).otherwise(horizontal)
    return ratios.join(lines.select("line_id", "is_vertical"), "line_id").filter(F.col("ratio") >= threshold).drop("is_vertical")


def gap_sweep(ratios: DataFrame, thresholds: list[float], truth: DataFrame) -> DataFrame:
    """Gaps, precision and recall per threshold, from one set of ratios.

    A spacing is repeated only for the thresholds it reaches."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    marked = ratios.join(truth.select("line_id", "insert_at").distinct().withColumn("_true", F.lit(1)), ["line_id", "insert_at"], "left")
    fired = marked.withColumn("threshold", F.explode(F.filter(grid, lambda t: F.col("ratio") >= t)))
    counts = fired.groupBy("threshold").agg(F.count(F.lit(1)).alias("fired"), F.count("_true").alias("hits"))
    total = truth.select("line_id", "insert_at").distinct().agg(F.count(F.lit(1)).alias("total"))
    spark = ratios.sparkSession
    asked = spark.range(1).select(F.explode(grid).alias("threshold"))
    d = asked.join(counts, "threshold", "left").na.fill(0).join(total, F.lit(True))
    return d.select(
        "threshold", "fired", "hits",
        F.try_divide("hits", "fired").alias("precision"),
        F.try_divide("hits", "total").alias("recall"),
    )


def plan_gaps(lines: DataFrame, boxes: DataFrame, columns: DataFrame, timesteps: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Placeholders for vertical lines that hold none yet.

    ``lines`` also carries ``text``; ``alternatives(line_id, n_alts)`` only lengths.
    """
    open_lines = lines.filter(F.col("is_vertical") & ~F.contains("text", F.lit(fx.GAP_CHAR)))
    gaps = written(detect_gaps(open_lines, boxes, columns, timesteps), "gaps")
    counts = (
        open_lines.select("line_id", "n").join(_counted(boxes, "nb"), "line_id", "left")
        .join(_counted(columns, "nc"), "line_id", "left").join(alternatives, "line_id", "left")
        .na.fill({"nb": 0, "nc": 0, "n_alts": 0})
        .select(
            "line_id",
            (F.col("nb") == F.col("n")).alias("grows_boxes"),
            (F.col("n_alts") == F.col("n")).alias("grows_alternatives"),
            (F.col("nc") == F.col("n")).alias("grows_columns"),
        )
    )
    box = F.struct("x", "y", "w", "h")
    at = lambda rows, value, shift, name: rows.select("line_id", (F.col("idx") + shift).cast("int").alias("insert_at"), value.alias(name))
    d = gaps.join(counts, "line_id")
    key = ["line_id", "insert_at"]
    d = d.join(at(boxes, box, 1, "b"), key, "left").join(at(boxes, box, 0, "a"), key, "left")
    d = d.join(at(columns, F.col("col"), 1, "cb"), key, "left").join(at(columns, F.col("col"), 0, "ca"), key, "left")
    column = F.when(~F.col("grows_columns"), F.lit(0.0)).otherwise(
        F.coalesce((F.col("cb") + F.col("ca")) / 2.0, F.col("cb"), F.col("ca"), F.lit(0.0))
    )
    d = d.withColumn("column", column)
    between = F.expr(
        "named_struct('x', least(b.x, a.x), "
        "'y', ((b.y + b.y + b.h) div 2 + (a.y + a.y + a.h) div 2) div 2 - greatest((b.h + a.h) div 2, 1) div 2, "
        "'w', greatest(b.x + b.w, a.x + a.w) - least(b.x, a.x), 'h', greatest((b.h + a.h) div 2, 1))"
    ).cast("struct<x:int,y:int,w:int,h:int>")
    zero = F.struct(*[F.lit(0).alias(c) for c in "xywh"])
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    d = d.withColumn("box", F.when(both, between).otherwise(F.coalesce("b", "a", zero)))
    return d.select(
        "line_id", "insert_at", "ratio", "span_px", "column", "box.x", "box.y", "box.w", "box.h",
        "grows_boxes", "grows_alternatives", "grows_columns",
    )


def apply_gaps(chars: DataFrame, plans: DataFrame) -> DataFrame:
    """Characters with the planned placeholders inserted.

    ``chars(line_id, idx, ch, col, x, y, w, h)``.  The new index is the number of rows
    before a row once placeholders stand in front of their character; a list
    the plan does not grow gives its placeholder NULL.
    """
    when = lambda flag, c: F.when(F.col(flag), F.col(c))
    marks = plans.select(
        "line_id",
        (F.col("insert_at").cast("long") * 2).alias("_at"),
        F.lit(fx.GAP_CHAR).alias("ch"),
        when("grows_columns", "column").alias("col"),
        *[when("grows_boxes", c).alias(c) for c in "xywh"],
    )
    own = chars.select("line_id", (F.col("idx").cast("long") * 2 + 1).alias("_at"), "ch", "col", "x", "y", "w", "h")
    d = ordered.prefix_sums(own.unionByName(marks), LINE, "_at", {"idx": F.lit(1).cast("long")})
    return d.select("line_id", "idx", "ch", "col", "x", "y", "w", "h")


def shift_overrides(overrides: DataFrame, plans: DataFrame) -> DataFrame:
    """Override keys moved by the placeholders at or before them."""
    marks = plans.select("line_id", F.col("insert_at").cast("long").alias("idx"), F.lit(1).cast("long").alias("_m"))
    rows = overrides.select("line_id", F.col("idx").cast("long").alias("idx"), "ch", F.lit(0).cast("long").alias("_m"))
    d = ordered.prefix_sums(
        rows.unionByName(marks, allowMissingColumns=True), LINE, "idx", {"_before": F.col("_m")}, order=[F.desc("_m")]
    )
    return d.filter("_m = 0").select("line_id", F.col("idx").alias("old_idx"), (F.col("idx") + F.col("_before")).alias("idx"), "ch")


# -- D13 - D15: size pairs, corrections -------------------------------------------


def _cell_bytes(ch: Column) -> Column:
    """The UTF-8 bytes of a character, left-aligned in four places."""
    hexed = F.rpad(F.hex(F.encode(F.coalesce(ch, F.lit("")), "UTF-8")), 8, "0")
    return F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substr(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    )


def size_pair_features(chars: DataFrame, keys: list[str]) -> DataFrame:
    """Characters of the size pairs with their 40-byte context window.

    ``chars(keys..., idx, ch)``.  Context stops at a boundary character.
    """
    r = fx.SIZE_RADIUS
    d, w = ordered.with_halo(chars, keys, "idx", r, r)
    sides = {f"_p{k}": F.lag("ch", k).over(w) for k in range(1, r + 1)}
    sides |= {f"_n{k}": F.lead("ch", k).over(w) for k in range(1, r + 1)}
    d = ordered.home_rows(d.withColumns(sides))
    small, big = fx.SIZE_SMALL, fx.SIZE_BIG
    as_big = F.translate("ch", small, big)
    d = d.withColumn("pair", F.instr(F.lit(big), as_big) - 1).filter("pair >= 0")

    def reach(side: str, k: int) -> Column:
        stopped = [F.instr(F.lit(fx.SIZE_BOUNDARY), F.coalesce(f"_{side}{j}", F.lit("\n"))) > 0 for j in range(1, k + 1)]
        cut = stopped[0]
        for s in stopped[1:]:
            cut = cut | s
        return F.when(~cut, F.col(f"_{side}{k}"))

    cells = [reach("p", k) for k in range(r, 0, -1)] + [reach("n", k) for k in range(1, r + 1)]
    return d.select(
        *keys, "idx", "ch", "pair", (F.instr(F.lit(small), F.col("ch")) > 0).alias("is_small"),
        F.concat(*[_cell_bytes(c) for c in cells]).alias("window"),
    )


def size_pair_policy(
    candidates: DataFrame, scores: DataFrame, keys: list[str], batch: list[str], epsilon: float = fx.SIZE_EPSILON
) -> DataFrame:
    """Join supplied logits and decide each candidate.

    A batch whose scores do not match its candidates one to one is left out
    altogether.  ``action`` is ``flip`` or ``declined``.
    """
    asked = candidates.select(*keys, "idx", "ch", "is_small")
    d = asked.join(dealt(scores.select(*keys, "idx", "logit")), [*keys, "idx"], "left")
    n_asked = d.groupBy(*batch).agg(F.count(F.lit(1)).alias("_n"), F.count("logit").alias("_have"))
    n_given = scores.groupBy(*batch).agg(F.count(F.lit(1)).alias("_given"))
    whole = n_asked.join(dealt(n_given), batch).filter("_n = _have and _n = _given").select(*batch)
    p = 1.0 / (1.0 + F.exp(-F.col("logit")))
    d = d.join(dealt(whole), batch, "left_semi").withColumn("p", p)
    small = F.col("is_small")
    flips = F.when(small, F.col("p") > 1.0 - epsilon).otherwise(F.col("p") < epsilon)
    other = F.when(small, F.translate("ch", fx.SIZE_SMALL, fx.SIZE_BIG)).otherwise(F.translate("ch", fx.SIZE_BIG, fx.SIZE_SMALL))
    return d.select(
        *keys, "idx", "ch", F.when(flips, other).otherwise(F.col("ch")).alias("to"), "p",
        F.when(flips, "flip").otherwise("declined").alias("action"),
        F.when(~flips, F.when(small, 1.0 - F.col("p")).otherwise(F.col("p"))).alias("confidence"),
    )


def declined_report(decisions: DataFrame, keys: list[str], batch: list[str], top: int = 5) -> DataFrame:
    """The least confident declined positions of each batch."""
    w = Window.partitionBy(*batch).orderBy("confidence", *keys, "idx")
    return decisions.filter("action = 'declined'").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def apply_corrections(chars: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Per position the last correction replaces the character; positions
    the line does not have are ignored."""
    last = corrections.groupBy(*keys, "idx").agg(F.max_by("ch", "version").alias("_new"))
    return chars.join(last, [*keys, "idx"], "left").withColumn("ch", F.coalesce("_new", "ch")).drop("_new")


# -- D16 - D18 ---------------------------------------------------------------------


def estimate_em(chars: DataFrame) -> DataFrame:
    """Per line the upper median of centre gaps over mean advance."""
    advance = F.when(tx.is_half_width(F.col("ch")), 0.5).otherwise(1.0)
    d, w = ordered.with_halo(chars.withColumn("_adv", advance), LINE, "idx", 1, 0)
    gap = F.abs(F.col("centre") - F.lag("centre").over(w))
    units = (F.col("_adv") + F.lag("_adv").over(w)) / 2.0
    d = ordered.home_rows(d.withColumn("_gap", gap).withColumn("pitch", F.col("_gap") / units)).filter("_gap > 0")
    em = ordered.group_medians(written(d.select("line_id", "pitch"), "pitches"), LINE, "pitch").select("line_id", F.col("upper_median").alias("em"))
    return chars.select("line_id").distinct().join(em, "line_id", "left").na.fill({"em": 0.0})


def column_cells(chars: DataFrame, lines: DataFrame) -> DataFrame:
    """The reading-axis cell of each character, ordered by start.

    ``lines(line_id, length, seq_len, cross)``.
    """
    d = chars.join(lines.select("line_id", "length", "seq_len", "cross"), "line_id")
    centre = (F.col("col") + 0.5) * (F.col("length") / F.col("seq_len"))
    half = F.col("cross") / 2.0
    d = d.withColumn("lo", F.greatest(centre - half, F.lit(0.0))).withColumn(
        "hi", F.least(centre + half, F.col("length").cast("double"))
    )
    d = ordered.ranked(d, LINE, F.floor(F.col("lo") / 64), [F.col("lo"), F.col("idx")], "cell")
    return d.select("line_id", "cell", "idx", "lo", "hi")


def run_statistics(timesteps: DataFrame, texts: DataFrame) -> DataFrame:
    """Argmax runs with their extent, mean top score and mean margin.

    ``texts(line_id, n)``; a line whose run count differs has no runs.
    """
    steps = timesteps.filter("rank <= 1").groupBy("line_id", "t").agg(
        F.max(F.when(F.col("rank") == 0, F.col("ch"))).alias("ch"),
        F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("top"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("second"),
    ).filter("ch is not null")
    d = written(ordered.previous_values(steps, LINE, "t", {"_before": "ch"}), "steps")
    inked = F.col("ch") != fx.BLANK_CHAR
    opens = inked & (F.col("_before").isNull() | (F.col("_before") != F.col("ch")))
    d = ordered.prefix_sums(d, LINE, "t", {"_run": opens.cast("long")}, inclusive=True).filter(inked)
    runs = d.groupBy("line_id", (F.col("_run") - 1).alias("run")).agg(
        F.min("t").alias("run_start"), F.max("t").alias("run_end"), F.avg("top").alias("confidence"),
        F.avg(F.col("top") - F.coalesce("second", F.lit(0.0))).alias("margin"),
    )
    fits = _counted(runs, "_runs").join(texts.select("line_id", "n"), "line_id").filter("_runs = n").select("line_id")
    return runs.join(fits, "line_id")
