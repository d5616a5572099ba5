"""Registered queries for recogniser evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx
from kotonoha.functions import text as tx
from kotonoha.operators import evidence, ordered
from kotonoha.plans import inputs, oracle
from kotonoha.plans.oracle import cte, sql
from kotonoha.plans.registry import query

cte("event_steps", """select user_id line_id, row_number() over (partition by user_id order by ts, event_id) - 1 t,
 case event_type when 'error' then 0 when 'view' then 1 when 'click' then 2 when 'signup' then 3 else 4 end cls, value score from events""")
cte("logits", "select line_id, t, (cls + k) % 5 cls, score - k * 2 score from (select *, unnest([0,1,2]) k from event_steps)", "event_steps")
cte("vocab", "select r_regionkey idx, translate(right(r_name, 2), 'ACESIPT', 'てかきくけこ…') token from region where r_regionkey <> 2")
cte("steps", """select line_id, t, rank, cls, case when cls = 18709 then ' ' when cls between 1 and 18707
   then coalesce(nullif(left(token, 1), ''), chr(65533)) else '　' end ch, score from (
 select l.line_id, l.t, rank, case when cls = 4 then 18709 else cls end cls, score from (
  select *, row_number() over (partition by line_id, t order by score desc, cls) - 1 rank from logits) l where rank < 15) l
 left join vocab v on v.idx + 1 = l.cls""", "logits", "vocab")
cte("emitted", """select line_id, row_number() over (partition by line_id order by t) - 1 char_idx, t, cls, ch, score from (
 select *, lag(cls) over (partition by line_id order by t) b from steps where rank = 0 and ch <> chr(65533))
 where cls <> 0 and (cls = 18709 or b is null or cls <> b)""", "steps")
cte("walked", """select line_id, row_number() over (partition by line_id order by t) - 1 idx, t, ch from (
 select *, lag(ch) over (partition by line_id order by t) b from steps where rank = 0)
 where ch <> '　' and (ch = ' ' or b is null or ch <> b)""", "steps")


def offset_sql(l, m, r):
    return (f"case when {l} is null or {r} is null or {l} - 2*{m} + {r} >= -1e-6 or least({m}-{l}, {m}-{r}) <= 1.0 then 0.0 "
            f"else greatest(-0.5, least(0.5, 0.5*({l}-{r})/({l} - 2*{m} + {r}))) end")


def _steps(spark, d):
    return evidence.decode_timesteps(inputs.logits(spark, d), inputs.vocab(spark, d), inputs.remap(spark, d))


def _lines(spark, d):
    return inputs.table(spark, d, "events").select(
        F.col("user_id").alias("line_id"), (F.col("user_id") % 2 == 0).alias("is_vertical")
    ).distinct()


@query("d01_decode_timesteps", sql("select line_id, t, rank, cls, ch, score from steps", "steps"))
def decode_timesteps(spark, d):
    return _steps(spark, d)


@query("d02_ctc_collapse", sql("select line_id, char_idx, t, cls, ch, score from emitted", "emitted"))
def ctc_collapse(spark, d):
    return evidence.ctc_collapse(_steps(spark, d))


@query("d02_line_text", sql("select line_id, string_agg(ch, '' order by char_idx) as text from emitted group by line_id", "emitted"))
def line_text(spark, d):
    return evidence.line_text(evidence.ctc_collapse(_steps(spark, d)))


@query("d03_peak_columns", sql(
    f"""select e.line_id, e.char_idx, e.t, e.ch, round(e.t + {offset_sql('l.score', 'e.score', 'r.score')}, 6) col from emitted e
 left join steps l on l.line_id = e.line_id and l.cls = e.cls and l.t = e.t - 1
 left join steps r on r.line_id = e.line_id and r.cls = e.cls and r.t = e.t + 1""", "emitted", "steps"))
def peak_columns(spark, d):
    s = _steps(spark, d)
    out = evidence.peak_columns(evidence.ctc_collapse(s), s)
    return out.select("line_id", "char_idx", "t", "ch", F.round("col", 6).alias("col"))


@query("d04_redecode", sql(
    f""", by_ch as (select line_id, t, ch, min_by(score, rank) score from steps group by all)
select w.line_id, w.idx char_idx, w.t, case when w.line_id % 2 = 0 then translate(w.ch, '?…‥', '？︙︰') else w.ch end ch,
  round(w.t + {offset_sql('l.score', 'm.score', 'r.score')}, 6) col from walked w join by_ch m on m.line_id = w.line_id and m.t = w.t and m.ch = w.ch
 left join by_ch l on l.line_id = w.line_id and l.ch = w.ch and l.t = w.t - 1
 left join by_ch r on r.line_id = w.line_id and r.ch = w.ch and r.t = w.t + 1""", "walked", "steps").replace("\n, by_ch", ", by_ch", 1))
def redecode(spark, d):
    return evidence.redecode(_steps(spark, d), _lines(spark, d)).withColumn("col", F.round("col", 6))


@query("d04_walk_columns", sql("select line_id, idx, cast(t as double) col from walked", "walked"))
def walk_columns(spark, d):
    return evidence.walk_columns(_steps(spark, d))


@query("d05_line_confidence", sql(
    """select line_id, round(coalesce(avg(share), 0), 6) confidence from (select distinct user_id line_id from events) l left join (
 select line_id, char_idx, 1.0 / sum(exp(score - m)) share from (select e.line_id, e.char_idx, s.score, max(s.score) over (partition by e.line_id, e.char_idx) m
   from emitted e join steps s on s.line_id = e.line_id and s.t = e.t) group by all) c using (line_id) group by line_id""", "emitted", "steps"))
def line_confidence(spark, d):
    s = _steps(spark, d)
    alts = evidence.ctc_collapse(s).select("line_id", "char_idx", "t").join(s.select("line_id", "t", "score"), ["line_id", "t"])
    return evidence.line_confidence(_lines(spark, d), alts).withColumn("confidence", F.round("confidence", 6))


# chunks of twelve steps; neighbours overlap in page pixels
cte("chunk_chars", """select line_id, t // 12 chunk, t % 12 idx, count(*) over (partition by line_id, t // 12) n,
  cast((t // 12) * 80 + (t % 12) * 10 + cls as double) centre, alts from (
  select line_id, t, min(case when rank = 0 then cls end) cls, list({'ch': ch, 'score': score} order by rank) alts from steps group by line_id, t)""", "steps")


def _chunk_chars(spark, d):
    s = _steps(spark, d)
    per = s.groupBy("line_id", "t").agg(
        F.min(F.when(F.col("rank") == 0, F.col("cls"))).alias("c0"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ch", "score"))), lambda x: F.struct(x["ch"], x["score"])).alias("alts"),
    )
    chunk = F.floor(F.col("t") / 12)
    per = per.select("line_id", chunk.alias("chunk"), (F.col("t") % 12).alias("idx"), "c0", "alts")
    n = per.groupBy("line_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    centre = (F.col("chunk") * 80 + F.col("idx") * 10 + F.col("c0")).cast("double")
    return per.join(n, ["line_id", "chunk"]).withColumn("centre", centre)


AGREE = """case when len(a) = 0 or len(b) = 0 then 0.0
 when a[1].ch = b[1].ch then 0.6 + len(list_filter(a[1:5], lambda x: list_contains(list_transform(b[1:5], lambda y: y.ch), x.ch))) / 5.0 * 0.4
 when list_contains(list_transform(b[1:3], lambda y: y.ch), a[1].ch) or list_contains(list_transform(a[1:3], lambda y: y.ch), b[1].ch) then 0.5 else 0.0 end"""


@query("d06_overlap_pairs", sql(
    f"""select line_id, chunk, prev_idx, curr_idx, round(score, 9) score from (select *, row_number() over (partition by line_id, chunk order by score desc, prev_idx desc, curr_idx) r
 from (select *, (1 - dist / 30.0) * 0.3 + pred * 0.7 score from (select line_id, chunk, prev_idx, curr_idx, dist, {AGREE} pred from (
  select p.line_id, p.chunk, p.idx prev_idx, c.idx curr_idx, abs(p.centre - c.centre) dist, p.alts a, c.alts b
  from chunk_chars p join chunk_chars c on c.line_id = p.line_id and c.chunk = p.chunk + 1
  where p.idx >= p.n - 10 and c.idx < 10 and abs(p.centre - c.centre) <= 30)) where pred >= 0.4)) where r = 1""", "chunk_chars"))
def overlap_pairs(spark, d):
    return evidence.overlap_pairs(_chunk_chars(spark, d)).withColumn("score", F.round("score", 9))


cte("merge_in", """select a.line_id, a.t, a.alts a, b.alts b from (
  select line_id, t, list({'ch': ch, 'score': score} order by rank) alts from (select line_id, t, ch, min(rank) rank, min_by(score, rank) score from steps group by all) group by all) a
 join (select line_id, t - 1 t, list({'ch': ch, 'score': score} order by rank) alts from (select line_id, t, ch, min(rank) rank, min_by(score, rank) score from steps group by all) group by all) b
 using (line_id, t)""", "steps")


@query("d07_merge_alternatives", sql(
    """select line_id, t, row_number() over (partition by line_id, t order by score desc, p) - 1 pos, ch, round(score, 9) score from (
 select coalesce(x.line_id, y.line_id) line_id, coalesce(x.t, y.t) t, coalesce(x.ch, y.ch) ch,
  case when y.score is null then x.score when x.score > 0 then (x.score + y.score) * 0.8 else y.score * 0.6 end score,
  case when x.ch is null then 100 + y.i else x.i end p from
 (select line_id, t, i, a[i].ch ch, a[i].score score from (select *, unnest(range(1, len(a) + 1)) i from merge_in)) x full join
 (select line_id, t, i, b[i].ch ch, b[i].score score from (select *, unnest(range(1, len(b) + 1)) i from merge_in)) y
 on x.line_id = y.line_id and x.t = y.t and x.ch = y.ch)""", "merge_in"))
def merge_alternatives(spark, d):
    s = _steps(spark, d).groupBy("line_id", "t", "ch").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    a = s.groupBy("line_id", "t").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ch", "score"))), lambda x: F.struct(x["ch"], x["score"])).alias("a")
    )
    b = a.select("line_id", (F.col("t") - 1).alias("t"), F.col("a").alias("b"))
    both = a.join(b, ["line_id", "t"]).select("line_id", "t", F.posexplode(evidence.merge_alternatives(F.col("a"), F.col("b"))).alias("pos", "x"))
    return both.select("line_id", "t", "pos", "x.ch", F.round("x.score", 9).alias("score"))


@query("d08_stitch_lines")
def stitch_lines(spark, d):
    c = _chunk_chars(spark, d)
    item = F.struct("idx", F.get("alts", F.lit(0))["ch"].alias("ch"), F.col("idx").cast("double").alias("col"), "centre", "alts")
    chunks = c.groupBy("line_id", "chunk").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["ch"], x["col"], x["centre"], x["alts"])).alias("items")
    ).withColumn("offset_px", (F.col("chunk") * 80).cast("double")).withColumn("step_px", F.lit(10.0))
    out = evidence.stitch_lines(chunks)
    return out.select("line_id", "char_idx", "ch", F.round("col", 6).alias("col"), F.round("centre", 6).alias("centre"), F.size("alts").alias("n_alts"))


# lines whose geometry comes from boxes, from columns, or from the walk, by thirds
cte("gap_chars", """select line_id, t idx, sum(10 + cast(floor(score) as bigint) % 30) over (partition by line_id order by t) centre, cls from event_steps""", "event_steps")
cte("gap_lines", """select l.line_id, case when l.line_id % 3 = 2 then coalesce(w.n, 0) else l.n end n, l.line_id % 2 = 0 is_vertical,
  cast(l.n * 20 as integer) crop_w, cast(case when l.line_id % 5 = 0 then 0 else l.n * 24 end as integer) crop_h, cast(l.n as integer) seq_len,
  case when l.line_id % 11 = 0 then '◌' else 'か' end as text
 from (select line_id, count(*) n from event_steps group by line_id) l left join (select line_id, count(*) n from walked group by line_id) w using (line_id)""", "event_steps", "walked")
cte("gap_boxes", "select line_id, idx, cast(centre - 5 as integer) x, cast(centre - 7 as integer) y, cast(9 + cls as integer) w, cast(13 + cls as integer) h from gap_chars where line_id % 3 = 0", "gap_chars")
cte("gap_cols", "select line_id, idx, centre / 8.0 col from gap_chars where line_id % 3 = 1", "gap_chars")
cte("gap_geo", """select b.line_id, idx, cast(case when is_vertical then y + h // 2 else x + w // 2 end as double) centre, 1.0 unit from gap_boxes b join gap_lines l using (line_id)
 union all select c.line_id, idx, col, case when case when is_vertical then crop_h else crop_w end > 0 then case when is_vertical then crop_h else crop_w end / seq_len else 8.0 end from gap_cols c join gap_lines l using (line_id)
 union all select w.line_id, idx, t, case when case when is_vertical then crop_h else crop_w end > 0 then case when is_vertical then crop_h else crop_w end / seq_len else 8.0 end from walked w join gap_lines l using (line_id) where w.line_id % 3 = 2""",
    "gap_boxes", "gap_cols", "gap_lines", "walked")
cte("gap_ratios", """select line_id, insert_at, spacing / m ratio, spacing * unit span_px from (
 select line_id, cast(idx as integer) insert_at, spacing, unit, median(spacing) over (partition by line_id) m from (
  select g.*, abs(centre - lag(centre) over (partition by line_id order by idx)) spacing from gap_geo g join gap_lines l using (line_id) where l.n >= 2) where spacing is not null)
 where m > 0""", "gap_geo", "gap_lines")
cte("gaps", """select r.* from gap_ratios r join gap_lines l using (line_id) where ratio >= case when is_vertical then 1.6 else 1.8 end""", "gap_ratios", "gap_lines")


def _gap_inputs(spark, d):
    s = inputs.event_steps(spark, d)
    step = (10 + F.floor("score") % 30).cast("long")
    chars = ordered.prefix_sums(s, ["line_id"], "t", {"centre": step}, inclusive=True).select("line_id", F.col("t").alias("idx"), "centre", "cls", "score")
    steps = _steps(spark, d)
    walked = evidence.walk_columns(steps).groupBy("line_id").agg(F.count(F.lit(1)).alias("wn"))
    lines = s.groupBy("line_id").agg(F.count(F.lit(1)).alias("k")).join(walked, "line_id", "left").select(
        "line_id",
        F.when(F.col("line_id") % 3 == 2, F.coalesce("wn", F.lit(0))).otherwise(F.col("k")).alias("n"),
        (F.col("line_id") % 2 == 0).alias("is_vertical"),
        (F.col("k") * 20).cast("int").alias("crop_w"),
        F.when(F.col("line_id") % 5 == 0, 0).otherwise(F.col("k") * 24).cast("int").alias("crop_h"),
        F.col("k").cast("int").alias("seq_len"),
        F.when(F.col("line_id") % 11 == 0, "◌").otherwise("か").alias("text"),
    )
    as_int = lambda c, n: c.cast("int").alias(n)
    boxes = chars.filter("line_id % 3 = 0").select(
        "line_id", "idx", as_int(F.col("centre") - 5, "x"), as_int(F.col("centre") - 7, "y"), as_int(9 + F.col("cls"), "w"), as_int(13 + F.col("cls"), "h")
    )
    cols = chars.filter("line_id % 3 = 1").select("line_id", "idx", (F.col("centre") / 8.0).alias("col"))
    return lines, boxes, cols, steps, chars


@query("d09_detect_gaps", sql("select line_id, insert_at, round(ratio, 6) ratio, round(span_px, 6) span_px from gaps", "gaps"))
def detect_gaps(spark, d):
    lines, boxes, cols, steps, _ = _gap_inputs(spark, d)
    out = evidence.detect_gaps(lines, boxes, cols, steps)
    return out.select("line_id", "insert_at", F.round("ratio", 6).alias("ratio"), F.round("span_px", 6).alias("span_px"))


GRID = [1.2, 1.4, 1.6, 1.8, 2.0, 2.5, 9.0]


@query("d10_gap_sweep", sql(
    f""", truth as (select distinct line_id, cast(t as integer) insert_at from event_steps where score > 20)
select g.threshold, count(r.line_id) fired, count(t.line_id) hits, case when count(r.line_id) > 0 then count(t.line_id) / count(r.line_id) end as "precision",
 count(t.line_id) / (select count(*) from truth) recall
from (select unnest({GRID}::double[]) threshold) g left join gap_ratios r on r.ratio >= g.threshold
left join truth t on t.line_id = r.line_id and t.insert_at = r.insert_at group by g.threshold""", "gap_ratios", "event_steps").replace("\n, truth", ", truth", 1))
def gap_sweep(spark, d):
    lines, boxes, cols, steps, chars = _gap_inputs(spark, d)
    truth = chars.filter("score > 20").select("line_id", F.col("idx").cast("int").alias("insert_at"))
    return evidence.gap_sweep(evidence.gap_ratios(evidence.gap_geometry(lines, boxes, cols, steps)), GRID, truth)


cte("gap_plans", """select g.line_id, g.insert_at, g.ratio, g.span_px,
  case when c0.col is not null or c1.col is not null then coalesce((c0.col + c1.col) / 2, c0.col, c1.col) else 0.0 end "column",
  case when b0.x is not null and b1.x is not null then least(b0.x, b1.x) else coalesce(b0.x, b1.x, 0) end x,
  case when b0.x is not null and b1.x is not null then ((b0.y*2 + b0.h) // 2 + (b1.y*2 + b1.h) // 2) // 2 - greatest((b0.h + b1.h) // 2, 1) // 2 else coalesce(b0.y, b1.y, 0) end y,
  case when b0.x is not null and b1.x is not null then greatest(b0.x + b0.w, b1.x + b1.w) - least(b0.x, b1.x) else coalesce(b0.w, b1.w, 0) end w,
  case when b0.x is not null and b1.x is not null then greatest((b0.h + b1.h) // 2, 1) else coalesce(b0.h, b1.h, 0) end h,
  g.line_id % 3 = 0 grows_boxes, g.line_id % 4 = 0 grows_alternatives, g.line_id % 3 = 1 grows_columns
 from gaps g join gap_lines l using (line_id)
 left join gap_boxes b0 on b0.line_id = g.line_id and b0.idx = g.insert_at - 1 left join gap_boxes b1 on b1.line_id = g.line_id and b1.idx = g.insert_at
 left join gap_cols c0 on c0.line_id = g.line_id and c0.idx = g.insert_at - 1 left join gap_cols c1 on c1.line_id = g.line_id and c1.idx = g.insert_at
 where l.is_vertical and not contains(l.text, '◌')""", "gaps", "gap_lines", "gap_boxes", "gap_cols")


def _plans(spark, d):
    lines, boxes, cols, steps, chars = _gap_inputs(spark, d)
    alts = lines.select("line_id", F.when(F.col("line_id") % 4 == 0, F.col("n")).otherwise(0).alias("n_alts"))
    return evidence.plan_gaps(lines, boxes, cols, steps, alts), boxes, cols, chars


@query("d11_plan_gaps", sql("""select * replace (round(ratio, 6) as ratio, round(span_px, 6) as span_px, round("column", 6) as "column",
  cast(x as integer) as x, cast(y as integer) as y, cast(w as integer) as w, cast(h as integer) as h) from gap_plans""", "gap_plans"))
def plan_gaps(spark, d):
    p = _plans(spark, d)[0]
    return p.withColumns({c: F.round(c, 6) for c in ("ratio", "span_px", "column")})


@query("d12_apply_gaps", sql("""select line_id, row_number() over (partition by line_id order by pos) - 1 idx, ch, round(col, 6) col, x from (
 select line_id, idx * 2 + 1 pos, chr(cast(12363 + cls as integer)) ch, null col, null x from gap_chars where line_id % 3 = 2
 union all select g.line_id, g.idx * 2 + 1, chr(cast(12363 + cls as integer)), c.col, b.x from gap_chars g left join gap_cols c using (line_id, idx) left join gap_boxes b using (line_id, idx) where g.line_id % 3 <> 2
 union all select line_id, insert_at * 2, '◌', case when grows_columns then "column" end, case when grows_boxes then x end from gap_plans)""", "gap_plans", "gap_chars", "gap_boxes", "gap_cols"))
def apply_gaps(spark, d):
    plans, boxes, cols, chars = _plans(spark, d)
    ch = F.element_at(F.array(*map(F.lit, "かがきぎく")), F.col("cls") + 1)
    full = chars.select("line_id", "idx", ch.alias("ch")).join(cols, ["line_id", "idx"], "left").join(boxes, ["line_id", "idx"], "left")
    return evidence.apply_gaps(full, plans).select("line_id", "idx", "ch", F.round("col", 6).alias("col"), "x")


@query("d12_shift_overrides", sql("""select g.line_id, g.idx old_idx, g.idx + count(p.line_id) idx, any_value('x') ch
 from gap_chars g left join gap_plans p on p.line_id = g.line_id and p.insert_at <= g.idx where g.cls = 2 group by g.line_id, g.idx""", "gap_chars", "gap_plans"))
def shift_overrides(spark, d):
    plans, _, _, chars = _plans(spark, d)
    over = chars.filter("cls = 2").select("line_id", "idx", F.lit("x").alias("ch"))
    return evidence.shift_overrides(over, plans)


SIZES = "あいうえっおつゃやゆよわアかゅきツくッけょヨこヮァゎ"
KEYS = ["page_id", "line_idx"]
cte("size_chars", f"""select page_id, line_idx, i - 1 idx, cs[i] ch from (select page_id, line_idx, cs, unnest(range(1, len(cs) + 1)) i from (
 select conv_id page_id, turn line_idx, string_split({oracle.translate('lower(text)', inputs.LETTERS + '.', SIZES + '。')}, '') cs from conversations where length(text) > 0))""")


def _size_chars(spark, d):
    c = inputs.table(spark, d, "conversations")
    text = F.translate(F.lower("text"), inputs.LETTERS + ".", SIZES + "。")
    return c.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("line_idx"), F.posexplode(tx.chars_of(text)).alias("idx", "ch"))


_B = oracle.quoted("。\n")
_left = [f"case when {' or '.join(f'coalesce(p{j}, chr(10)) in (chr(10), chr(12290))' for j in range(1, k + 1))} then '' else p{k} end" for k in range(5, 0, -1)]
_right = [f"case when {' or '.join(f'coalesce(n{j}, chr(10)) in (chr(10), chr(12290))' for j in range(1, k + 1))} then '' else n{k} end" for k in range(1, 6)]
cte("size_feats", "select page_id, line_idx, idx, ch, pair, is_small, " + " || ".join(f"rpad(hex(encode({e})), 8, '0')" for e in _left + _right) + f""" win from (
 select *, instr('{fx.SIZE_BIG}', translate(ch, '{fx.SIZE_SMALL}', '{fx.SIZE_BIG}')) - 1 pair, instr('{fx.SIZE_SMALL}', ch) > 0 is_small, """
    + ", ".join(f"lag(ch, {k}) over w p{k}, lead(ch, {k}) over w n{k}" for k in range(1, 6))
    + " from size_chars window w as (partition by page_id, line_idx order by idx)) where pair >= 0", "size_chars")


@query("d13_size_pair_features", sql(
    "select page_id, line_idx, count(*) n, sum(pair * (idx + 1)) pair_sum, count(case when is_small then 1 end) n_small, min(win) first_window, max(win) last_window "
    "from size_feats group by all", "size_feats"))
def size_pair_features(spark, d):
    f = evidence.size_pair_features(_size_chars(spark, d), KEYS)
    hexed = F.array_join(F.transform("window", lambda b: F.lpad(F.hex(b), 2, "0")), "")
    return f.withColumn("win", hexed).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("pair") * (F.col("idx") + 1)).alias("pair_sum"),
        F.count_if("is_small").alias("n_small"), F.min("win").alias("first_window"), F.max("win").alias("last_window"),
    )


cte("size_scores", """select page_id, line_idx, idx, cast((idx * 37 + pair * 11 + line_idx) % 21 as double) - 10.25 logit from size_feats
 where not (page_id % 5 = 0 and line_idx = 0 and idx < 40)""", "size_feats")
cte("size_scored", """select * from (select f.*, logit, count(*) over (partition by page_id) - count(logit) over (partition by page_id) missing
 from size_feats f left join size_scores s using (page_id, line_idx, idx)) where missing = 0""", "size_feats", "size_scores")
cte("size_decisions", f"""select *, case when flips then translate(ch, '{fx.SIZE_SMALL}{fx.SIZE_BIG}', '{fx.SIZE_BIG}{fx.SIZE_SMALL}') else ch end to_ch,
 case when not flips then case when is_small then 1 - p else p end end confidence from (
 select f.*, 1 / (1 + exp(-logit)) p, case when is_small then 1 / (1 + exp(-logit)) > 0.99 else 1 / (1 + exp(-logit)) < 0.01 end flips
 from size_scored f)""", "size_scored")


def _decisions(spark, d):
    f = evidence.size_pair_features(_size_chars(spark, d), KEYS)
    logit = ((F.col("idx") * 37 + F.col("pair") * 11 + F.col("line_idx")) % 21).cast("double") - 10.25
    scores = f.filter("not (page_id % 5 = 0 and line_idx = 0 and idx < 40)").select(*KEYS, "idx", logit.alias("logit"))
    return evidence.size_pair_policy(f, scores, KEYS, ["page_id"])


@query("d14_size_pair_policy", sql(
    "select page_id, line_idx, idx, ch, to_ch as \"to\", round(p, 9) p from size_decisions where flips", "size_decisions"))
def size_pair_policy(spark, d):
    return _decisions(spark, d).filter("action = 'flip'").select(*KEYS, "idx", "ch", "to", F.round("p", 9).alias("p"))


@query("d14_declined_report", sql(
    """select page_id, line_idx, idx, ch, round(confidence, 9) confidence, place from (select *, row_number() over (partition by page_id order by confidence, line_idx, idx) place
 from size_decisions where not flips) where place <= 5""", "size_decisions"))
def declined_report(spark, d):
    out = evidence.declined_report(_decisions(spark, d), KEYS, ["page_id"])
    return out.select(*KEYS, "idx", "ch", F.round("confidence", 9).alias("confidence"), "place")


@query("d15_apply_corrections", sql(
    """select page_id, line_idx, string_agg(coalesce(n, ch), '' order by idx) as text from size_chars left join (
 select page_id, line_idx, idx, max_by(ch, version) n from (select conv_id page_id, turn line_idx, k * (turn + 3) idx, k * 7 % 5 version, ['甲','乙','丙'][k % 3 + 1] ch
  from (select conv_id, turn, unnest([1, 2, 3, 4, 6, 9, 400]) k from conversations) union all
  select conv_id, turn, turn + 3, 9, '丁' from conversations) group by all) c using (page_id, line_idx, idx) group by page_id, line_idx""", "size_chars"))
def apply_corrections(spark, d):
    c = inputs.table(spark, d, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("line_idx"))
    k = F.col("k")
    some = c.withColumn("k", F.explode(F.array(*map(F.lit, [1, 2, 3, 4, 6, 9, 400])))).select(
        *KEYS, (k * (F.col("line_idx") + 3)).alias("idx"), (k * 7 % 5).alias("version"), F.get(F.array(*map(F.lit, "甲乙丙")), k % 3).alias("ch")
    )
    last = c.select(*KEYS, (F.col("line_idx") + 3).alias("idx"), F.lit(9).alias("version"), F.lit("丁").alias("ch"))
    fixed = evidence.apply_corrections(_size_chars(spark, d), some.unionByName(last), KEYS)
    return evidence.line_text(fixed, KEYS, "idx")


cte("em_chars", "select line_id, idx, centre, chr(cast(case when cls < 2 then 97 + cls when cls = 2 then 65393 else 12363 end as integer)) ch from gap_chars", "gap_chars")


@query("d16_estimate_em", sql(
    """select line_id, coalesce(max(case when r = n // 2 then pitch end), 0.0) em from (select distinct line_id from em_chars) left join (
 select line_id, pitch, row_number() over (partition by line_id order by pitch) - 1 r, count(*) over (partition by line_id) n from (
  select line_id, gap / ((adv + padv) / 2.0) pitch from (select line_id, abs(centre - lag(centre) over w) gap, adv, lag(adv) over w padv from (
   select *, case when unicode(ch) <= 126 or unicode(ch) between 65377 and 65500 then 0.5 else 1.0 end adv from em_chars) window w as (partition by line_id order by idx))
  where gap > 0)) using (line_id) group by line_id""", "em_chars"))
def estimate_em(spark, d):
    chars = _gap_inputs(spark, d)[4]
    ch = F.get(F.array(*map(F.lit, "abｱかか")), F.col("cls"))
    return evidence.estimate_em(chars.select("line_id", "idx", "centre", ch.alias("ch")))


@query("d17_column_cells", sql(
    """select line_id, row_number() over (partition by line_id order by lo, idx) - 1 cell, idx, round(lo, 6) lo, round(hi, 6) hi from (
 select line_id, idx, greatest((col + 0.5) * (length / seq_len) - 12.0, 0.0) lo, least((col + 0.5) * (length / seq_len) + 12.0, length) hi from (
  select line_id, idx, (centre * 7 % 64) / 2.0 col, 640.0 length, 40 seq_len from gap_chars))""", "gap_chars"))
def column_cells(spark, d):
    lines, _, _, _, chars = _gap_inputs(spark, d)
    dims = lines.select("line_id", F.lit(640).alias("length"), F.lit(40).alias("seq_len"), F.lit(24.0).alias("cross"))
    cells = evidence.column_cells(chars.select("line_id", "idx", (F.col("centre") * 7 % 64 / 2.0).alias("col")), dims)
    return cells.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query("d18_run_statistics", sql(
    """, tops as (select line_id, t, max(case when rank = 0 then ch end) ch, max(case when rank = 0 then score end) top, max(case when rank = 1 then score end) sec from steps group by all),
runs as (select line_id, run, min(t) run_start, max(t) run_end, avg(top) confidence, avg(top - coalesce(sec, 0)) margin from (
 select *, sum(case when ch <> '　' and (b is null or b <> ch) then 1 else 0 end) over (partition by line_id order by t) - 1 run from (
  select *, lag(ch) over (partition by line_id order by t) b from tops)) where ch <> '　' group by line_id, run)
select line_id, run, run_start, run_end, round(confidence, 6) confidence, round(margin, 6) margin from (select *, count(*) over (partition by line_id) n from runs) r
join (select line_id, count(*) + case when line_id % 2 = 0 then 0 else 1 end k from runs group by line_id) x using (line_id) where n = k""", "steps").replace("\n, tops", ", tops", 1))
def run_statistics(spark, d):
    s = _steps(spark, d)
    # even lines claim as many characters as they have runs, odd lines one more
    every = evidence.run_statistics(s, _run_counts(s))
    return every.withColumns({"confidence": F.round("confidence", 6), "margin": F.round("margin", 6)})


def _run_counts(steps):
    top = steps.filter("rank = 0").select("line_id", "t", "ch")
    d = ordered.previous_values(top, ["line_id"], "t", {"b": "ch"})
    opens = d.filter((F.col("ch") != "　") & (F.col("b").isNull() | (F.col("b") != F.col("ch"))))
    return opens.groupBy("line_id").agg((F.count(F.lit(1)) + F.max(F.col("line_id") % 2)).alias("n"))
