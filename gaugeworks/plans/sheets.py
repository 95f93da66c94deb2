"""Queries on boxes and pages: folds, page scans, crops, sources of boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.operators import cluster, filters, geometry, metering, pipeline, spatial
from gaugeworks.operators.geometry import Rect
from gaugeworks.plans import inputs
from gaugeworks.plans.inputs import BOXES_SQL, EVENTS_SQL, KEYS, spread, table
from gaugeworks.plans.registry import query
from gaugeworks.sources import boxes as sources
from gaugeworks.sources.stores import badge_counts

# ---- folds over pages: SQL repeats the decisions one by one, in a recursive query with the state in a list

_GAPS = "greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) as dx, greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) as dy, greatest(8, least(a.y1 - a.y0, b.y1 - b.y0)) as h"


@query(rf"""with recursive {BOXES_SQL},
j as (select a.doc_id, a.orientation, a.seq as a, b.seq as b, a.text as ta, b.text as tb, {_GAPS} from b a join b b on a.doc_id = b.doc_id and a.orientation = b.orientation and a.seq < b.seq),
p as (select doc_id, orientation, a, b, row_number() over (partition by doc_id, orientation order by dx + dy, a, b) as k from j
      where (dx < 1.5 * h and dy < 0.45 * h or dy < 1.2 * h and dx < 0.8 * h) and not contains(ta, '±') and not contains(tb, '±') and not (starts_with(ta, 'Ø') and starts_with(tb, 'Ø'))),
n as (select doc_id, orientation, seq, try_cast(regexp_extract(regexp_replace(text, '^[+±\-~= ]+', ''), '^[0-9]+(\.[0-9]+)?') as double) as v, starts_with(text, '±') as pm from b),
m as (select doc_id, orientation, seq, case when v >= 0.35 and not pm then v end as v from n),
r as (select doc_id, orientation, cast(0 as bigint) as k, list({{'seq': seq, 'home': seq, 'v': v}}) as st from m group by all
      union all
      select doc_id, orientation, k, case when ha = hb or (len(va) > 0 and len(vb) > 0 and va <> vb) then st else list_transform(st, lambda x: {{'seq': x.seq, 'home': case when x.home = hb then ha else x.home end, 'v': x.v}}) end
      from (select *, list_sort(list_distinct(list_filter(list_transform(list_filter(st, lambda x: x.home = ha), lambda x: x.v), lambda x: x is not null))) as va,
                   list_sort(list_distinct(list_filter(list_transform(list_filter(st, lambda x: x.home = hb), lambda x: x.v), lambda x: x is not null))) as vb
            from (select r.doc_id, r.orientation, p.k, r.st, list_filter(r.st, lambda x: x.seq = p.a)[1].home as ha, list_filter(r.st, lambda x: x.seq = p.b)[1].home as hb
                  from r join p on p.doc_id = r.doc_id and p.orientation = r.orientation and p.k = r.k + 1))),
l as (select doc_id, orientation, unnest(arg_max(st, k)) as x from r group by doc_id, orientation)
select doc_id, cast(0 as int) as page_num, orientation, x.seq as seq, min(x.seq) over (partition by doc_id, orientation, x.home) as cluster from l""")
def union_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_boxes(inputs.boxes(spark, sf_dir))


@query(f"""with recursive {BOXES_SQL},
o as (select *, row_number() over (partition by doc_id order by seq) as k from b),
r as (select doc_id, cast(0 as bigint) as k, [{{'slot': cast(0 as bigint), 'seq': cast(0 as bigint), 'text': '', 'x0': 0.0::double, 'y0': 0.0::double, 'x1': 0.0::double, 'y1': 0.0::double}}][1:0] as kept from o group by doc_id
      union all
      select doc_id, k, case when hit = 0 then list_append(kept, {{'slot': seq, 'seq': seq, 'text': text, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}})
                             when length(text) > length(kept[hit].text) then kept[1:hit - 1] || [{{'slot': kept[hit].slot, 'seq': seq, 'text': text, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] || kept[hit + 1:] else kept end
      from (select *, coalesce(list_position(list_transform(met, lambda m: m > 0.3), true), 0) as hit
            from (select o.doc_id, o.k, o.seq, o.text, o.x0, o.y0, o.x1, o.y1, r.kept,
                         list_transform(r.kept, lambda m: case when least(m.x1, o.x1) <= greatest(m.x0, o.x0) or least(m.y1, o.y1) <= greatest(m.y0, o.y0) then 0.0
                           when (least(m.x1, o.x1) - greatest(m.x0, o.x0)) * (least(m.y1, o.y1) - greatest(m.y0, o.y0)) > 0.6 * least((m.x1 - m.x0) * (m.y1 - m.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) then 0.99
                           else (least(m.x1, o.x1) - greatest(m.x0, o.x0)) * (least(m.y1, o.y1) - greatest(m.y0, o.y0)) / ((m.x1 - m.x0) * (m.y1 - m.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - (least(m.x1, o.x1) - greatest(m.x0, o.x0)) * (least(m.y1, o.y1) - greatest(m.y0, o.y0))) end) as met
                  from r join o on o.doc_id = r.doc_id and o.k = r.k + 1))),
l as (select doc_id, unnest(arg_max(kept, k)) as x from r group by doc_id)
select doc_id, x.slot as slot, x.seq as seq, x.text as raw_text from l""")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.suppress_overlaps(inputs.boxes(spark, sf_dir).withColumnRenamed("text", "raw_text")).select("doc_id", "slot", "seq", "raw_text")


_B = "{'i': i, 'text': text, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': score, 'cy': (y0 + y1) / 2}"


@query(f"""with recursive {BOXES_SQL},
o as (select doc_id, orientation, row_number() over (partition by doc_id, orientation order by seq) as i, text, x0, y0, x1, y1, score from b),
g as (select doc_id, orientation, list({_B} order by i) as boxes from o group by all),
-- signs, in order, each with the nearest free box at its right on its line
s as (select doc_id, orientation, cast(0 as bigint) as i, boxes, cast([] as bigint[]) as signs, cast([] as bigint[]) as partners from g
      union all
      select doc_id, orientation, i + 1, boxes, case when j is null then signs else list_append(signs, i + 1) end, case when j is null then partners else list_append(partners, j) end
      from (select *, case when boxes[i + 1].text = '-' and not list_contains(partners, i + 1) then
                     list_sort(list_transform(list_filter(boxes, lambda c: c.i <> i + 1 and not list_contains(signs, c.i) and not list_contains(partners, c.i)
                       and abs(boxes[i + 1].cy - c.cy) < 0.75 * greatest(boxes[i + 1].y1 - boxes[i + 1].y0, c.y1 - c.y0) and c.x0 >= boxes[i + 1].x1
                       and c.x0 - boxes[i + 1].x1 <= greatest(10, 1.5 * greatest(boxes[i + 1].y1 - boxes[i + 1].y0, c.y1 - c.y0))),
                       lambda c: {{'dy': abs(boxes[i + 1].cy - c.cy), 'i': c.i}}))[1].i end as j
            from s where i < len(boxes))),
e as (select doc_id, orientation, arg_max(boxes, i) as boxes, arg_max(signs, i) as signs, arg_max(partners, i) as partners from s group by all),
u as (select doc_id, orientation, unnest(boxes) as x, boxes, signs, partners from e),
v as (select doc_id, orientation, x.i as i, case when pos > 0 then '-' || ltrim(boxes[to_].text, '+-') else x.text end as text, x.x0 as x0, case when pos > 0 then least(x.y0, boxes[to_].y0) else x.y0 end as y0,
             case when pos > 0 then boxes[to_].x1 else x.x1 end as x1, case when pos > 0 then greatest(x.y1, boxes[to_].y1) else x.y1 end as y1, case when pos > 0 then (x.score + boxes[to_].score) / 2 else x.score end as score
      from (select *, coalesce(list_position(signs, x.i), 0) as pos, partners[coalesce(list_position(signs, x.i), 0)] as to_ from u) where not list_contains(partners, x.i)),
c as (select *, (y0 + y1) / 2 as cy, avg(y1 - y0) over (partition by doc_id, orientation) as mean, row_number() over (partition by doc_id, orientation order by x0, i) as across from v),
-- a tolerance above another, at the right of the leftmost box
f as (select doc_id, orientation, text, (x0 + x1) / 2 as cx, mean from c where across = 1),
t as (select c.doc_id, c.orientation, c.text, c.cy, row_number() over (partition by c.doc_id, c.orientation order by c.cy, c.x0, c.i) as down from c join f using (doc_id, orientation) where across > 1 and c.x0 >= f.cx),
k as (select f.doc_id, f.orientation, [f.text || ' ' || a.text || ' ' || z.text] as lines from f join t a using (doc_id, orientation) join t z using (doc_id, orientation)
      where a.down = 1 and z.down = 2 and regexp_matches(a.text, '[-+0.]') and regexp_matches(z.text, '[-+0.]') and z.cy - a.cy > 0 and z.cy - a.cy < 2.2 * f.mean),
-- lines by the distance to their first box
w as (select *, row_number() over (partition by doc_id, orientation order by cy, x0, i) as down from c),
q as (select doc_id, orientation, cast(0 as bigint) as down, cast([] as double[]) as heads, cast([] as bigint[]) as found from w group by doc_id, orientation
      union all
      select doc_id, orientation, down, case when line = 0 then list_append(heads, cy) else heads end, list_append(found, case when line = 0 then len(heads) + 1 else line end)
      from (select w.doc_id, w.orientation, w.down, w.cy, q.heads, q.found, coalesce(list_position(list_transform(q.heads, lambda y: abs(w.cy - y) < greatest(12, 0.6 * w.mean)), true), 0) as line
            from q join w on w.doc_id = q.doc_id and w.orientation = q.orientation and w.down = q.down + 1)),
h as (select doc_id, orientation, arg_max(found, down) as found from q group by all),
y as (select w.*, h.found[w.down] as line, row_number() over (partition by w.doc_id, w.orientation, h.found[w.down] order by w.x0, w.down) as place from w join h using (doc_id, orientation)),
-- of boxes that overlap the one kept before them, the better one
z as (select doc_id, orientation, line, cast(0 as bigint) as place, [{{'text': '', 'x0': 0.0::double, 'x1': 0.0::double, 'score': 0.0::double}}][1:0] as kept from y group by doc_id, orientation, line
      union all
      select doc_id, orientation, line, place, case when len(kept) = 0 or not over_ then list_append(kept, own) when better then list_append(kept[1:len(kept) - 1], own) else kept end
      from (select y.doc_id, y.orientation, y.line, y.place, z.kept, {{'text': y.text, 'x0': y.x0, 'x1': y.x1, 'score': y.score::double}} as own,
                   least(z.kept[-1].x1, y.x1) - greatest(z.kept[-1].x0, y.x0) > 0.4 * least(z.kept[-1].x1 - z.kept[-1].x0, y.x1 - y.x0) as over_,
                   contains(y.text, '.') and not contains(z.kept[-1].text, '.') or contains(y.text, '.') = contains(z.kept[-1].text, '.') and (y.score > z.kept[-1].score + 0.15 or length(y.text) > length(z.kept[-1].text)) as better
            from z join y on y.doc_id = z.doc_id and y.orientation = z.orientation and y.line = z.line and y.place = z.place + 1)),
x as (select doc_id, orientation, line, list_aggregate(list_transform(arg_max(kept, place), lambda m: m.text), 'string_agg', ' ') as text from z group by all),
tops as (select doc_id, orientation, line, min(y0) as top from y group by all),
plain as (select x.doc_id, x.orientation, list(x.text order by tops.top, x.line) as lines from x join tops using (doc_id, orientation, line) group by all)
select plain.doc_id, plain.orientation, list_aggregate(case when len(g.boxes) > 1 then coalesce(k.lines, plain.lines) else plain.lines end, 'string_agg', ' | ') as lines
from plain join g using (doc_id, orientation) left join k using (doc_id, orientation)""")
def line_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_lines(inputs.boxes(spark, sf_dir), ["doc_id", "page_num", "orientation"]).select("doc_id", "orientation", F.array_join("lines", " | ").alias("lines"))


# ---- pages whose dimensions are known: each line item of an order is one, written in one of four ways


def _known_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*KEYS[1:])) - 1
    line = spread(table(spark, sf_dir, "lineitem").select(*KEYS)).withColumn("i", place)
    k, i = F.col("l_partkey") % 4, F.col("i")
    n, dd, t = (10 + F.col("l_partkey") % 90).cast("string"), F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"), (1 + F.col("l_linenumber") % 9).cast("string")
    x, y = 100 + 200 * (i % 3), 60 + 60 * F.floor(i / 3)

    def box(part: int, text, x0: int, y0: int, x1: int, y1: int, turn: int = 0):
        parts = {"seq": (i * 10 + part).cast("long"), "text": text, "x0": (x + x0).cast("double"), "y0": (y + y0).cast("double"), "x1": (x + x1).cast("double"), "y1": (y + y1).cast("double"), "orientation": F.lit(turn)}
        return F.struct(*[v.alias(c) for c, v in parts.items()])

    whole = F.concat(n, F.lit("."), dd, F.lit(" ±0.0"), t)
    stacked = F.array(box(0, F.concat(n, F.lit("."), dd), 0, 6, 30, 18), box(1, F.concat(F.lit("+0.1"), t), 34, 0, 64, 10), box(2, F.concat(F.lit("-0.0"), t), 34, 13, 64, 23))
    typical = F.array(box(0, F.concat(F.lit("Ø"), n), 0, 0, 30, 12), box(1, F.lit("TYP"), 36, 0, 60, 12))
    each = F.when(k == 0, F.array(box(0, whole, 0, 0, 60, 12))).when(k == 1, stacked).when(k == 2, typical).otherwise(F.array(box(0, whole, 0, 0, 12, 40, 90)))
    return line.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_num"), (0.5 + F.col("l_linenumber") % 5 / 10.0).alias("score"), F.explode(each).alias("b")).select("doc_id", "page_num", "b.*", "score")


def _known_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order; every line item has a box, so these are the pages of the boxes."""
    orders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).distinct()
    return orders.select("doc_id", F.lit(0).alias("page_num"), F.lit(1000.0).alias("width"), F.lit(2000.0).alias("height"))


_KNOWN_SQL = """d as (
  select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i, l_partkey % 4 as k, cast(10 + l_partkey % 90 as varchar) as n,
         lpad(cast(l_suppkey % 100 as varchar), 2, '0') as dd, cast(1 + l_linenumber % 9 as varchar) as t, 0.5 + (l_linenumber % 5) / 10.0::double as score from lineitem),
e as (select *, 100.0 + 200 * (i % 3) as x, 60.0 + 60 * (i // 3) as y, case k when 1 then 3 when 2 then 2 else 1 end as parts, case k when 1 then 64 when 3 then 12 else 60 end as w, case k when 1 then 23 when 3 then 40 else 12 end as h,
  case k when 1 then n || '.' || dd || ' +0.1' || t || ' -0.0' || t when 2 then 'Ø' || n || ' TYP' else n || '.' || dd || ' ±0.0' || t end as raw_text,
  case k when 1 then n || '.' || dd || ' +0.1' || t || '/-0.0' || t when 2 then 'Ø ' || n || ' ±0.2 TYP' else n || '.' || dd || ' ±0.0' || t end as full_callout, case k when 2 then 'global' else 'local' end as tol_type from d)"""
_REPORT = """select doc_id, row_number() over (partition by doc_id order by y - py, x - px, i) as stt, raw_text, full_callout, tol_type, cast(x - px as double) as x0, cast(y - py as double) as y0, cast(x + w + px as double) as x1, cast(y + h + py as double) as y1,
  round_even((x - px) / 1000.0::double, 4) as crop_x, case when k = 3 then 270 else 0 end as crop_rotation from p"""
_REPORTED = ["doc_id", "stt", "raw_text", "dim.full_callout", "dim.tol_type", "x0", "y0", "x1", "y1", "crop_x", "crop_rotation"]


@query(f"with {_KNOWN_SQL}, p as (select *, case when sum(parts) over (partition by doc_id) >= 3 then 10 else 8 end as px, case when sum(parts) over (partition by doc_id) >= 3 then 8 else 6 end as py from e) {_REPORT}")
def detect_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector boxes of each page; pages with fewer than three fail over to scanning, which sees the same boxes."""
    b = _known_boxes(spark, sf_dir)
    return pipeline.detect_dimensions(b, _known_pages(spark, sf_dir), scans=b).select(*_REPORTED).withColumn("stt", F.col("stt").cast("long"))


@query(f"with {_KNOWN_SQL}, p as (select *, 8 as px, 6 as py from e) {_REPORT}")
def detect_scanned_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _known_boxes(spark, sf_dir)
    return pipeline.detect_dimensions(b, _known_pages(spark, sf_dir), scanned=True).select(*_REPORTED).withColumn("stt", F.col("stt").cast("long"))


@query(f"with {_KNOWN_SQL} select doc_id, i as crop_id, raw_text, full_callout, round(score, 6) as score, cast(parts as bigint) as n_boxes from e union all select distinct doc_id, -1, '', '', 0.0, 0 from e")
def extract_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crop around each dimension, numbered anew on every page, and one on each page that holds nothing."""
    b = _known_boxes(spark, sf_dir)
    around = b.groupBy("doc_id", "page_num", F.floor(F.col("seq") / 10).alias("crop_id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    empty = _known_pages(spark, sf_dir).select("doc_id", "page_num", F.lit(-1).cast("long").alias("crop_id"), *[F.lit(v).alias(c) for c, v in (("x0", 900.0), ("y0", 1900.0), ("x1", 950.0), ("y1", 1950.0))])
    out = pipeline.extract_crops(b, around.unionByName(empty))
    return out.select("doc_id", "crop_id", "raw_text", "dim.full_callout", F.round("score", 6).alias("score"), "n_boxes")


# ---- other joins of boxes

_MEET = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_OVERLAP = f"j as (select a.doc_id, a.seq as a, b.seq as b, {_MEET} / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) as s from b a join b b on a.doc_id = b.doc_id where least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0))"


@query(f"with {BOXES_SQL} select a.seq as clip, b.seq as seq from b a join b b using (doc_id) where a.x0 <= b.x1 and b.x0 <= a.x1 + 120 and a.y0 <= b.y1 and b.y0 <= a.y1 + 60 and a.orientation = 90")
def clip_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that touch the clip rectangle of each vertical box."""
    b = inputs.boxes(spark, sf_dir)
    clips = b.where("orientation = 90").withColumns({"x1": F.col("x1") + 120, "y1": F.col("y1") + 60})
    return spatial.meets_crop(b, clips).select(F.col("a_seq").alias("clip"), F.col("b_seq").alias("seq"))


@query(f"with {BOXES_SQL}, {_OVERLAP} select a as moved, b as absorbed, round(s, 9) as score from j where a <> b and s > 0.6")
def absorbed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inputs.boxes(spark, sf_dir)
    return spatial.absorb(b, b).select(F.col("a_seq").alias("moved"), F.col("b_seq").alias("absorbed"), F.round("score", 9).alias("score"))


@query(f"with {BOXES_SQL}, {_OVERLAP} select doc_id, a as seq, max(b) as hit from j where s > 0.5 group by all")
def latest_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inputs.boxes(spark, sf_dir)
    return spatial.latest_hit(b, b).select("doc_id", "seq", "hit")


@query("select p_partkey as doc_id, cast(k // 3 + 1 as int) as place, cast(k * 10 as int) as x, 5 as y from part, range(9) r(k) where k % 3 = 0")
def template_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine hits a page, ten apart, the left ones surer: every third is further than half a template from the one kept before."""
    k = F.explode(F.sequence(F.lit(0), F.lit(8)))
    hits = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page_num"), k.alias("k")).select("doc_id", "page_num", (F.col("k") * 10).alias("x"), F.lit(5).alias("y"), (1.0 - F.col("k") / 100).alias("score"))
    return cluster.suppress_hits(hits, 50, 20).select("doc_id", "place", "x", "y")


@query(f"with {BOXES_SQL} select seq, text, score from b where contains(text, '.5') and score >= 0.5 order by score desc, doc_id, seq limit 1")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.find_first(inputs.boxes(spark, sf_dir), ".5").select("seq", "text", "score")


@query(f"""with {BOXES_SQL} select seq, round_even(x0 / 1000, 4) as share_x, round_even((y1 - y0) / 700, 4) as share_h, least(995, floor(round_even(x0 / 1000, 4) * 1000)) as pixel_x,
  least(1000, least(995, floor(round_even(x0 / 1000, 4) * 1000)) + 5) as pixel_x1, 700 - y1 as turned_x0, x1 as turned_y1, 999 - y0 as back_x, x0 as back_y from b""")
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, w, h = Rect.of(), F.lit(1000.0), F.lit(700.0)
    share = geometry.normalized(r, w, h)
    pixel = geometry.pixels(share[0], share[1], F.lit(0.001), share[3], w, h)
    turned, back = geometry.turned(r, h), geometry.turned_back(r.x0, r.y0, w)
    out = {"share_x": share[0], "share_h": share[3], "pixel_x": pixel.x0.cast("double"), "pixel_x1": pixel.x1.cast("double"), "turned_x0": turned.x0, "turned_y1": turned.y1, "back_x": back[0], "back_y": back[1]}
    return inputs.boxes(spark, sf_dir).select("seq", *[v.alias(c) for c, v in out.items()])


# ---- sources


@query("select doc_id, cast(count(*) as bigint) as page_count, string_agg(cast(page_number as varchar) || ':' || cast(width as varchar), ',' order by page_number) as pages from (select p_partkey // 4 as doc_id, p_partkey % 4 + 1 as page_number, 600 + p_size as width from part) group by 1")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    pages = table(spark, sf_dir, "part").select(F.floor(key / 4).cast("long").alias("doc_id"), (key % 4).cast("int").alias("page_num"), (600 + F.col("p_size")).alias("width"), F.lit(800).alias("height"))
    shown = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page_number"].cast("string"), p["width"].cast("string"))), ",")
    return sources.page_info(pages).select("doc_id", "page_count", shown.alias("pages"))


@query("select event_id as seq, case when event_id % 10 in (0, 1, 9) then 90 else 0 end as orientation, 1.0::double as score, event_type as text from events")
def vector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("text"), F.when(F.col("event_id") % 10 == 0, -1.0).otherwise((F.col("event_id") % 10 - 2) / 7.0 * F.when(F.col("event_id") % 10 == 1, -6.0).otherwise(0.75)).alias("dir_y"))
    return sources.from_vector_lines(lines).select("seq", "orientation", "score", "text")


@query("select event_id as seq, cast(event_id % 50 as double) as x0, cast(event_id % 50 + 20 as double) as x1, 3.0::double as y0, 11.0::double as y1, event_id % 50 + 10.0::double as cx, 7.0::double as cy, 999 - 11.0::double as page_x0, cast(event_id % 50 as double) as page_y0 from events where event_id % 7 <> 3")
def scanned_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with four corners; those without ink go."""
    x = (F.col("event_id") % 50).cast("double")
    corner = lambda dx, y: F.struct((x + dx).alias("x"), F.lit(y).alias("y"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 7 == 3, " - ").otherwise(F.concat(F.lit(" "), "event_type")).alias("text"), F.lit(1000.0).alias("width"), F.array(corner(0, 3.0), corner(20, 3.0), corner(20, 11.0), corner(0, 11.0)).alias("corners"))
    found = sources.from_corners(rows)
    page = sources.to_page_pixels(found.select("seq", "width", "x0", "y0", "x1", "y1")).select("seq", F.col("x0").alias("page_x0"), F.col("y0").alias("page_y0"))
    return found.select("seq", "x0", "x1", "y0", "y1", "cx", "cy").join(page, "seq")


@query("select cast(p_partkey as varchar) as file_id, case when p_partkey % 3 = 0 then '/known/' || p_partkey when p_partkey % 3 = 1 and p_size <= 25 then '/files/' || p_partkey || '_a.pdf' when p_partkey % 3 = 2 then '/plain/' || p_partkey end as path from part")
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_partkey").cast("string").alias("file_id"))
    k = F.col("p_partkey") % 3
    registry = part.where(k == 0).select("file_id", F.concat(F.lit("/known/"), "file_id").alias("path"))
    named = part.where((k == 1) & (F.col("p_size") <= 25)).select(F.concat("file_id", F.lit("_a.pdf")).alias("name"), F.concat(F.lit("/files/"), "file_id", F.lit("_a.pdf")).alias("path"))
    plain = part.where(k == 2).select(F.col("file_id").alias("name"), F.concat(F.lit("/plain/"), "file_id").alias("path"))
    return sources.find_files(part.select("file_id"), registry, named.unionByName(plain))


@query("select count(*) as total, count(*) filter (where p_size <= 10) as shown, cast(count(*) filter (where p_partkey % 5 = 0) as bigint) + 2 as rules from part")
def shown_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return badge_counts(part, part.where("p_size <= 10"), part.where("p_partkey % 5 = 0"), [{"id": "a"}, {"id": "b"}]).select("total", "shown", "rules")


@query(f"with {EVENTS_SQL} select date_trunc('day', ts)::timestamp as bucket, model, round(sum(tokens) / 1e6 * 0.075, 4) as cost from u group by all")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = metering.usage(inputs.events(spark, sf_dir), "1 day", ["model"])
    out = metering.quota_report(daily, metering.profiles(spark, [("one", 1000, 1, 1)]))
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "model", "cost")
