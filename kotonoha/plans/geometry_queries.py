"""Registered queries for page geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx
from kotonoha.operators import geometry
from kotonoha.plans import inputs
from kotonoha.plans.oracle import cte, sql
from kotonoha.plans.registry import query

cte("boxes", """select l_orderkey page_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 box_idx,
 cast(l_partkey % 900 as integer) x, cast((l_suppkey * 37 + l_partkey) % 1300 as integer) y,
 cast(case when cast(floor(l_quantity) as bigint) % 5 = 0 then 12 + cast(floor(l_quantity) as bigint) % 30 else 10 + cast(floor(l_quantity) as bigint) * 8 end as integer) w,
 cast(case when cast(floor(l_quantity) as bigint) % 7 = 0 then 300 + cast(floor(l_quantity) as bigint) * 4 else 10 + (l_partkey * 7) % 60 end as integer) h from lineitem""")
cte("boxes_un", "select *, x - 6 ux, y - 6 uy, w + 12 uw, h + 12 uh, h >= w * 1.25 vert, least(w, h) >= greatest(w, h) / 1.25 sq from boxes", "boxes")
cte("ruby", """select distinct s.page_id, s.box_idx from boxes_un s join boxes_un b on b.page_id = s.page_id and b.box_idx <> s.box_idx where
 ((s.vert or s.sq) and b.vert and b.h >= 1400 * 0.2 and s.h < b.h * 0.3 and s.h < 1400 * 0.12 and s.uw < b.uw * 0.65
  and not ((s.x * 2 + s.w) // 2 between b.x and b.x + b.w) and greatest(greatest(s.ux, b.ux) - least(s.ux + s.uw, b.ux + b.uw), 0) <= b.uw * 0.5
  and greatest(least(s.y + s.h, b.y + b.h) - greatest(s.y, b.y), 0) >= s.h * 0.5)
 or ((not s.vert or s.sq) and not b.vert and b.w >= 1000 * 0.2 and s.h < b.h * 0.75 and s.h < 1400 * 0.12 and s.uh < b.uh * 0.85 and s.uw < b.uw * 0.65
  and s.y + s.h <= b.y + 2 and b.uy - (s.uy + s.uh) <= b.uh * 0.5 and greatest(least(s.x + s.w, b.x + b.w) - greatest(s.x, b.x), 0) >= s.w * 0.5)""", "boxes_un")
cte("frames", "select page_id, box_idx idx, x + w / 2.0 cx, y + h / 2.0 cy, cast(w as double) w, cast(h as double) h, cast((x * 7 + y) % 5 - 2 as double) angle_deg from boxes", "boxes")


def _blobs(source):
    return f"""select o.page_id, o.idx from {source} o join {source} i on i.page_id = o.page_id and i.idx <> o.idx
 where i.w * i.h < o.w * o.h * 0.6 and greatest(i.w, i.h) >= 2 * least(i.w, i.h)
 and abs((i.cx - o.cx) * cos(radians(o.angle_deg)) + (i.cy - o.cy) * sin(radians(o.angle_deg))) <= o.w / 2
 and abs(-(i.cx - o.cx) * sin(radians(o.angle_deg)) + (i.cy - o.cy) * cos(radians(o.angle_deg))) <= o.h / 2
 group by all having count(*) >= 2"""


def _boxes(spark, d):
    return inputs.page_boxes(spark, d)


def _unclipped(b):
    return b.selectExpr("*", "x - 6 as ux", "y - 6 as uy", "w + 12 as uw", "h + 12 as uh")


def _frames(spark, d):
    return _boxes(spark, d).selectExpr(
        "page_id", "box_idx as idx", "x + w / 2 as cx", "y + h / 2 as cy", "cast(w as double) w", "cast(h as double) h",
        "cast((x * 7 + y) % 5 - 2 as double) angle_deg",
    )


@query("g01_frame_columns", sql("""
select page_id, idx, round(a, 6) angle_deg, round(cx - (w * abs(cos(radians(a))) + h * abs(sin(radians(a)))) / 2, 4) aabb_x,
 round(w * abs(sin(radians(a))) + h * abs(cos(radians(a))), 4) aabb_h, h >= w * 1.25 is_vertical,
 abs(radians(a)) <= greatest(radians(1.0), atan(1.5 / greatest(w, h, 1.0))) axis_aligned, round(w + w * h * 1.5 / (w + h), 4) unclip_w
from (select *, angle_deg * 50 - 180 * floor((angle_deg * 50 + 90) / 180) a from frames)""", "frames"))
def frame_columns(spark, d):
    f = geometry.frame_columns(_frames(spark, d).withColumn("angle_deg", F.col("angle_deg") * 50))
    return f.select(
        "page_id", "idx", F.round("angle_deg", 6).alias("angle_deg"), F.round("aabb_x", 4).alias("aabb_x"), F.round("aabb_h", 4).alias("aabb_h"),
        "is_vertical", "axis_aligned", F.round("unclip_w", 4).alias("unclip_w"),
    )


@query("g02_drop_ruby", sql("select page_id, box_idx from boxes where (page_id, box_idx) not in (select (page_id, box_idx) from ruby)", "boxes", "ruby"))
def drop_ruby(spark, d):
    b = _boxes(spark, d)
    return geometry.drop_ruby(_unclipped(b), inputs.page_sizes(b)).select("page_id", "box_idx")


@query("g03_drop_enclosing", sql(f"select page_id, idx from frames where (page_id, idx) not in (select (page_id, idx) from ({_blobs('frames')}))", "frames"))
def drop_enclosing(spark, d):
    f = _frames(spark, d)
    return geometry.drop_enclosing(f, inputs.page_sizes(f)).select("page_id", "idx")


# straight frames: raw is the unclipped frame shrunk by six pixels per side
cte("frames0", "select page_id, box_idx idx, x + w / 2.0 cx, y + h / 2.0 cy, cast(w + 12 as double) w, cast(h + 12 as double) h, 0.0 angle_deg from boxes", "boxes")
cte("frames1", "select f.* from frames0 f where (page_id, idx) not in (select (page_id, box_idx) from ruby) and w >= 10 and h >= 10", "frames0", "ruby")


@query("g04_prefilter_frames", sql(
    f"""select page_id, idx, round(case when h >= w * 1.25 then w * 0.9 else w end, 6) w, h from frames1
 where (page_id, idx) not in (select (page_id, idx) from ({_blobs('frames1')}))""", "frames1"))
def prefilter_frames(spark, d):
    f = _frames(spark, d).withColumn("angle_deg", F.lit(0.0))
    grown = f.withColumns({"w": F.col("w") + 12, "h": F.col("h") + 12})
    out = geometry.prefilter_frames(grown, f, inputs.page_sizes(f))
    return out.select("page_id", "idx", F.round("w", 6).alias("w"), "h")


# boxes of a page in order of area: the first waiting one meets the running union, is taken in or waits for the next round
cte("rec_merge", f"""select page_id, s[1] cur, s[2:] waiting, s[1:0] rest, s[1:0] done, false ended from (
  select page_id, list({{'x': x, 'y': y, 'w': w, 'h': h, 'members': 1}} order by -cast(w as bigint) * h, box_idx) s from boxes where box_idx % 6 <> 5 group by page_id)
 union all select page_id,
  case when len(waiting) = 0 then rest[1] when meets then {{'x': least(cur.x, b.x), 'y': least(cur.y, b.y),
   'w': greatest(cur.x + cur.w, b.x + b.w) - least(cur.x, b.x), 'h': greatest(cur.y + cur.h, b.y + b.h) - least(cur.y, b.y), 'members': cur.members + 1}} else cur end,
  case when len(waiting) = 0 then rest[2:] else waiting[2:] end,
  case when len(waiting) = 0 then rest[1:0] when meets then rest else list_append(rest, b) end,
  case when len(waiting) = 0 then list_append(done, cur) else done end,
  len(waiting) = 0 and len(rest) = 0
 from (select *, coalesce(ix > 0 and iy > 0 and area > 0 and ix * iy / area >= {fx.MERGE_OVERLAP} and abs(cur.y + cur.h / 2.0 - b.y - b.h / 2.0) <= (cur.h + b.h) / 2.0, false) meets from (
  select *, least(cur.x + cur.w, b.x + b.w) - greatest(cur.x, b.x) ix, least(cur.y + cur.h, b.y + b.h) - greatest(cur.y, b.y) iy,
   least(cast(cur.w as bigint) * cur.h, cast(b.w as bigint) * b.h) area from (select *, waiting[1] b from rec_merge where not ended)))""", "boxes")


@query("g05_merge_overlapping", sql("""select page_id, m.x, m.y, m.w, m.h, 1.0::double confidence, m.members from (select page_id, unnest(done) m from rec_merge where ended)
 union all select page_id, x, y, w, h, 1.0, 1 from boxes where box_idx % 6 = 5""", "rec_merge", "boxes"))
def merge_overlapping(spark, d):
    b = _boxes(spark, d).withColumn("confidence", F.lit(1.0)).withColumn("is_rotated", F.col("box_idx") % 6 == 5)
    return geometry.merge_overlapping(b)


@query("g06_reading_order", sql(
    """select page_id, box_idx, row_number() over (partition by page_id order by v, case when v then -(x + w) else y end,
 case when v then y else x end, box_idx) - 1 "position" from (select *, h >= w * 1.25 v from boxes)""", "boxes"))
def reading_order(spark, d):
    return geometry.reading_order(_boxes(spark, d)).select("page_id", "box_idx", "position")


cte("points", """select b.page_id, box_idx, (x + w / 2.0) / mx px, (y + h / 2.0) / my py from boxes b join
 (select page_id, greatest(max(x + w), 1) mx, greatest(max(y + h), 1) my from boxes group by page_id) e using (page_id)""", "boxes")
cte("nav_pairs", """select *, case when dir in ('N','S') then abs(px - jx) else abs(py - jy) end aside,
  case dir when 'N' then py - jy when 'S' then jy - py when 'E' then jx - px else px - jx end ahead, sqrt((px - jx)**2 + (py - jy)**2) euclid
 from (select a.page_id, a.box_idx src, b.box_idx dst, a.px, a.py, b.px jx, b.py jy, unnest(['N','S','E','W']) dir
  from points a join points b on a.page_id = b.page_id and a.box_idx <> b.box_idx)""", "points")
_TOP = """select page_id, src, dir, rank, dst from (select *, row_number() over (partition by page_id, src, dir order by cost, e, dst) rank
 from (%s)) where rank <= 5"""


@query("g07_local_neighbours", sql(_TOP % "select *, ahead + 10 * aside cost, euclid e from nav_pairs where ahead > 0 and aside <= ahead and euclid <= 0.05", "nav_pairs"))
def local_neighbours(spark, d):
    return geometry.directional_neighbours(_boxes(spark, d), geometry.LOCAL).drop("cost")


@query("g07_directional_neighbours", sql(_TOP % "select *, ahead + 1.5 * aside cost, 0 e from nav_pairs where ahead > 0 and aside <= ahead", "nav_pairs"))
def directional_neighbours(spark, d):
    return geometry.directional_neighbours(_boxes(spark, d), geometry.FAR).drop("cost")


@query("g07_wrapped_neighbours", sql(_TOP % "select *, ahead + 1 + 1.5 * least(aside, 1 - aside) cost, 0 e from nav_pairs where ahead < 0 and aside <= ahead + 1", "nav_pairs"))
def wrapped_neighbours(spark, d):
    return geometry.directional_neighbours(_boxes(spark, d), geometry.WRAP).drop("cost")


@query("g07_candidate_counts", sql("select page_id, src, dir, count(*) n from nav_pairs where ahead > 0 and aside <= ahead group by all", "nav_pairs"))
def candidate_counts(spark, d):
    return geometry.candidate_counts(_boxes(spark, d), geometry.FAR)


@query("g07_local_counts", sql("select page_id, src, dir, count(*) n from nav_pairs where ahead > 0 and aside <= ahead and euclid <= 0.05 group by all", "nav_pairs"))
def local_counts(spark, d):
    return geometry.candidate_counts(_boxes(spark, d), geometry.LOCAL)


# a sparse graph: each box points to its item number's successor and double
cte("edges", """select distinct page_id, src, dst from (select b.page_id, b.box_idx src, (b.box_idx * k + 1) % n dst from (select *, unnest([1, 2]) k from boxes) b
 join (select page_id, count(*) n from boxes group by page_id) c using (page_id) where (b.x + b.box_idx) % 5 > 0)""", "boxes")
cte("rec_reach", "select page_id, src, dst from edges union select r.page_id, r.src, e.dst from rec_reach r join edges e on e.page_id = r.page_id and e.src = r.dst", "edges")
cte("nodes", "select page_id, src node from edges union select page_id, dst from edges", "edges")
cte("scc", """select n.page_id, n.node, least(n.node, coalesce(min(a.dst), n.node)) component from nodes n
 left join (select a.page_id, a.src, a.dst from rec_reach a join rec_reach b on b.page_id = a.page_id and b.src = a.dst and b.dst = a.src) a
 on a.page_id = n.page_id and a.src = n.node group by n.page_id, n.node""", "nodes", "rec_reach")


@query("g08_strong_connectivity", sql("select page_id, count(*) nodes, count(distinct component) components, count(distinct component) = 1 connected from scc group by page_id", "scc"))
def strong_connectivity(spark, d):
    b = _boxes(spark, d)
    n = b.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    k = b.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).join(n, "page_id").filter((F.col("x") + F.col("box_idx")) % 5 > 0)
    edges = k.select("page_id", F.col("box_idx").alias("src"), ((F.col("box_idx") * F.col("k") + 1) % F.col("n")).alias("dst"))
    return geometry.strong_connectivity(edges.distinct())


# spans of a page's horizontal boxes, one pair (i, j) cut apart per step
cte("rec_cuts", """select page_id, s, 1 i, 2 j from (
  select page_id, list({'n': box_idx, 'x': x, 'w': w, 'top': y, 'low': y + h} order by box_idx) s from boxes where not (h >= w * 1.25) group by page_id)
 union all select page_id,
  case when cuts then list_transform(s, lambda b, k: case when k = u then {'n': b.n, 'x': b.x, 'w': b.w, 'top': b.top, 'low': line}
    when k = l then {'n': b.n, 'x': b.x, 'w': b.w, 'top': line, 'low': greatest(b.low, line + 1)} else b end) else s end,
  case when j < len(s) then i else i + 1 end, case when j < len(s) then j + 1 else i + 2 end
 from (select *, s[i].x < s[j].x + s[j].w and s[j].x < s[i].x + s[i].w and s[l].top < s[u].low cuts,
   greatest(cast(trunc((s[l].top + least(s[u].low, s[l].low)) / 2) as integer), s[u].top + 1) line from (
   select *, case when s[i].top <= s[j].top then i else j end u, case when s[i].top <= s[j].top then j else i end l from rec_cuts where j <= len(s)))""", "boxes")


@query("g09_split_stacked", sql("""select page_id, b.n box_idx, b.x, b.top y, b.w, b.low - b.top h from (select page_id, unnest(s) b from rec_cuts where j > len(s))
 union all select page_id, box_idx, x, y, w, h from boxes where h >= w * 1.25""", "rec_cuts", "boxes"))
def split_stacked(spark, d):
    return geometry.split_stacked(_boxes(spark, d))
