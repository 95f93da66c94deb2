"""The queries of the engine by name, and the SQL that says what they must give.

The SQL computes the expected result from the tables' own columns; it never
reads the text that a query parses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions import grammar, tolerance
from gaugeworks.functions.callout import full_callout
from gaugeworks.functions.normalize import sanitize
from gaugeworks.functions.tolerance import Constraints
from gaugeworks.operators import cluster, filters, geometry, metering, results, rules, spatial
from gaugeworks.operators.geometry import Rect
from gaugeworks.plans import forms, inputs, sheets  # noqa: F401 - their queries are registered as they are imported
from gaugeworks.plans.inputs import BOXES_SQL, CALLOUTS_SQL, EVENTS_SQL, KEYS, table
from gaugeworks.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from gaugeworks.sources import boxes as box_sources


# ---- grammar


@query(f"with {CALLOUTS_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, prefix, nominal_str, upper_tol, lower_tol, tol_type, full_callout from p")
def callout_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grammar.parse(inputs.callouts(spark, sf_dir))
    return out.select(*KEYS, "dim.qty", "dim.prefix", "dim.nominal_str", "dim.upper_tol", "dim.lower_tol", "dim.tol_type", "dim.full_callout")


@query(f"with {CALLOUTS_SQL} select tol_type, prefix, count(*) as n, count(distinct full_callout) as n_callouts from p group by all")
def callout_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grammar.parse(inputs.callouts(spark, sf_dir))
    return out.groupBy("dim.tol_type", "dim.prefix").agg(F.count("*").alias("n"), F.countDistinct("dim.full_callout").alias("n_callouts"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(10 + l_partkey % 90 + (l_suppkey % 60) / 60.0::double + (l_partkey % 60) / 3600.0::double, 4) as degrees from lineitem where (l_orderkey + l_linenumber) % 8 = 5")
def dms_to_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammar.parse(inputs.callouts(spark, sf_dir).where("fam = 5")).select(*KEYS, F.col("dim.angle_deg").alias("degrees"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    whole, cut = (F.col("p_partkey") % 600).cast("string"), (F.col("p_partkey") % 6).cast("int")
    shown = F.concat(whole, F.when(cut > 0, F.concat(F.lit("."), F.repeat(F.lit("5"), cut))).otherwise(""))
    return part.select("p_partkey", shown.alias("nominal_str")).withColumn("nominal", F.col("nominal_str").cast("double"))


_SIZES_SQL = "s as (select p_partkey, p_partkey % 6 as cut, cast(cast(p_partkey % 600 as varchar) || case when p_partkey % 6 > 0 then '.' || repeat('5', cast(p_partkey % 6 as int)) else '' end as double) as nominal from part)"


@query(f"with {_SIZES_SQL} select p_partkey, case cut when 0 then 0.2 when 1 then 0.1 when 2 then 0.05 when 3 then 0.01 when 4 then 0.005 else 0.001 end::double as tol from s")
def global_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("p_partkey", tolerance.general_tolerance(F.col("nominal"), F.col("nominal_str"), Constraints()).alias("tol"))


@query("select p_partkey, 0.25::double as tol, case when p_partkey % 6 = 0 then 0.3 else 0.1 end::double as own_tol from part")
def global_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = Constraints.of({"mode": "fixed", "fixed_value": 0.25})
    own = Constraints.of({"decimals": {"0": 0.3, "1": 0.1, "2": 0.1, "3": 0.1, "4": 0.1, "5": 0.1}})
    c = F.col("nominal"), F.col("nominal_str")
    return _sizes(spark, sf_dir).select("p_partkey", tolerance.general_tolerance(*c, fixed).alias("tol"), tolerance.general_tolerance(*c, own).alias("own_tol"))


_BANDS = {"f": (0.05, 0.05, 0.1, 0.15, 0.2, 0.3), "m": (0.1, 0.1, 0.2, 0.3, 0.5, 0.8), "c": (0.2, 0.3, 0.5, 0.8, 1.2, 2.0)}
_CASE = {g: "case " + " ".join(f"when nominal <= {hi} then {t}" for hi, t in zip((3, 6, 30, 120, 400), v, strict=False)) + f" else {v[-1]} end::double" for g, v in _BANDS.items()}


@query(f"with {_SIZES_SQL} select p_partkey, {_CASE['f']} as fine, {_CASE['m']} as medium, {_CASE['c']} as coarse, {_CASE['c']} as joined from s")
def iso2768_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = _sizes(spark, sf_dir)
    grades = {"fine": "iso2768_f", "medium": "iso2768_m", "coarse": "iso2768_c"}
    size = size.withColumns({k: tolerance.general_tolerance(F.col("nominal"), F.col("nominal_str"), Constraints(mode)) for k, mode in grades.items()})
    return tolerance.band_join(size, "nominal", "c", spark).select("p_partkey", *grades, F.col("tol").alias("joined"))


@query("select p_partkey, nominal > tol as above, case when nominal < 1 then tol < nominal else tol <= nominal * 0.25 end as plausible from (select p_partkey, (p_partkey % 37) / 8.0::double as nominal, (p_partkey % 11) / 8.0::double as tol from part)")
def plausible_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 37 / 8.0).alias("nominal"), (F.col("p_partkey") % 11 / 8.0).alias("tol"))
    return part.select("p_partkey", (F.col("nominal") > F.col("tol")).alias("above"), tolerance.plausible(F.col("tol"), F.col("nominal")).alias("plausible"))


@query("select p_partkey, n + 0.25 as nominal, '+0.25' as upper_tol, '-0.25' as lower_tol, 'local_limit' as tol_type from (select p_partkey, 20 + p_partkey % 300 as n from part)")
def limit_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (20 + F.col("p_partkey") % 300).cast("string")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(n, F.lit(".50 / "), n, F.lit(".00")).alias("raw_text"))
    return grammar.parse(rows).select("p_partkey", F.col("dim.nominal").cast("decimal(18,2)").alias("nominal"), "dim.upper_tol", "dim.lower_tol", "dim.tol_type")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, n || '.5' as nominal_str, '+0.0' || t as upper_tol, '-0.1' || t as lower_tol, 'local_stacked' as tol_type from (select *, cast(20 + l_partkey % 70 as varchar) as n, cast(1 + l_linenumber % 9 as varchar) as t from lineitem)")
def stacked_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = (20 + F.col("l_partkey") % 70).cast("string"), (1 + F.col("l_linenumber") % 9).cast("string")
    rows = inputs.spread(table(spark, sf_dir, "lineitem").select(*KEYS)).select(*KEYS, F.concat(F.lit("+0.0"), t, F.lit("\n"), n, F.lit(".5\n-0.1"), t).alias("raw_text"))
    return grammar.parse(rows).select(*KEYS, "dim.nominal_str", "dim.upper_tol", "dim.lower_tol", "dim.tol_type")


@query(r"select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[+-]?[0-9]+(?:\.[0-9]+)?')) as int) as n_numbers, coalesce(list_aggregate(list_transform(regexp_extract_all(coalesce(text, ''), '[+-]?[0-9]+(?:\.[0-9]+)?'), lambda x: cast(length(x) as bigint)), 'max'), 0) as longest from documents")
def text_number_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({grammar.SIGNED})"), F.lit(1))
    out = table(spark, sf_dir, "documents").select("doc_id", found.alias("found"))
    return out.select("doc_id", F.size("found").alias("n_numbers"), F.coalesce(F.array_max(F.transform("found", F.length)), F.lit(0)).cast("long").alias("longest"))


@query("select p_partkey, replace(p_brand, '#', '') || ' Ø' || cast(p_size as varchar) || '.5' as clean from part")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = F.concat(F.lit("!! "), "p_brand", F.lit("  φ"), F.col("p_size").cast("string"), F.lit(",5 ;;\n\n~~~\n"))
    return table(spark, sf_dir, "part").select("p_partkey", sanitize(dirty).alias("clean"))


# ---- rules


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(
        F.concat(F.lit(" part "), n).alias("raw_text"), F.lit("").alias("qty"), F.lit("").alias("prefix"), F.col("p_partkey").cast("double").alias("nominal"), n.alias("nominal_str"), F.lit("+1").alias("upper_tol"), F.lit("-1").alias("lower_tol"),
        F.lit("user_defined").alias("tol_type"), F.lit("").alias("suffix"), F.concat(n, F.lit(" ±1")).alias("full_callout"), F.lit(True).alias("user_verified"),
    )


@query("select p_partkey, case when p_partkey % 5 = 0 then cast(p_partkey as varchar) || ' ±1' end as full_callout from part")
def exact_rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("raw_text"))
    return rules.lookup(rows, _exact(spark, sf_dir)).select("p_partkey", "rule.full_callout")


@query("select p_partkey, case when p_partkey % 5 = 0 then 'adaptive_exact' when p_partkey % 5 = 1 then 'adaptive_rule' else 'grammar' end as source, case when p_partkey % 5 = 0 then cast(p_partkey as varchar) || ' ±1' when p_partkey % 5 = 1 then cast(p_partkey % 80 as varchar) || '.0' || cast(p_partkey % 9 as varchar) || ' 0/-0.02' else cast(30 + p_partkey % 60 as varchar) || ' ±0.2' end as full_callout from part")
def rules_then_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("p_partkey"), lambda c: c.cast("string")
    raw = F.when(key % 5 == 0, F.concat(F.lit("part "), text(key))).when(key % 5 == 1, F.concat(F.lit("w "), text(key % 80), F.lit(" 0 "), text(key % 9), F.lit(" -0.02"))).otherwise(text(30 + key % 60))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw_text"))
    general = [{"id": "bad", "pattern": "(["}, {"id": "split", "pattern": r"^w ([0-9]+) ([0-9]+) ([0-9]+) (-[0-9.]+)$", "type": "split_tokens"}]
    out = rules.parse_callouts(rows, "raw_text", exact=_exact(spark, sf_dir), general=general)
    return out.select("p_partkey", "source", "dim.full_callout")


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.struct("ts", "event_id").alias("ts"), F.when(F.col("user_id") % 10 == 0, "  ").otherwise(F.concat(F.lit(" u"), F.col("user_id").cast("string"))).alias("raw_text"), F.col("event_type").alias("full_callout"))


@query("select 'u' || user_id as raw_text, arg_max(event_type, {'ts': ts, 'event_id': event_id}) as full_callout from events where user_id % 10 <> 0 group by user_id")
def learn_last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "raw_text string, full_callout string, user_verified boolean")
    return rules.learn(none, _corrections(spark, sf_dir)).select("raw_text", "full_callout")


@query("select cast(p_partkey as varchar) as nominal_str from part where p_partkey % 5 = 0 and p_partkey % 3 <> 0")
def delete_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = _exact(spark, sf_dir)
    return rules.delete_exact(exact, exact.where(F.col("nominal") % 3 == 0)).select("nominal_str")


# ---- filters

_PAGED = "p as (select *, 1000.0 as width, 700.0 as height from b)"


@query(f"with {BOXES_SQL}, {_PAGED} select seq, x0 > 500 and y0 > 476 as in_title, x0 > 1000.0::double * 0.52::double and y0 > 700.0::double * 0.70::double as in_title_scanned, y0 > 672 as in_notes from p")
def title_block_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w, h = inputs.boxes(spark, sf_dir), F.lit(1000.0), F.lit(700.0)
    x, y = F.col("x0"), F.col("y0")
    return b.select("seq", filters.in_title_block(x, y, w, h).alias("in_title"), filters.in_title_block(x, y, w, h, False).alias("in_title_scanned"), filters.in_note_strip(y, h).alias("in_notes"))


@query(f"with {BOXES_SQL} select seq from b where (x0 < 35 or x1 > 965 or y0 < 24.5 or y1 > 675.5) and length(text) <= 2")
def border_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return inputs.boxes(spark, sf_dir).where(filters.is_border_label(c("text"), c("x0"), c("y0"), c("x1"), c("y1"), F.lit(1000.0), F.lit(700.0))).select("seq")


_WORDS = " or ".join(f"contains(upper(p_name || ' ' || p_type), '{w}')" for w in filters.TITLE_WORDS + filters.VECTOR_WORDS)


@query(f"select p_partkey, {_WORDS} as title, contains(upper(p_brand), 'BRAND#1') as part_number from part")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", filters.has_title_word(text).alias("title"), filters.is_part_number(F.col("p_brand"), ["Brand#1"]).alias("part_number"))


@query("select p_partkey from part where contains(lower(p_name || ' ' || p_brand || ' ' || p_type || ' ' || cast(p_size as varchar)), 'brand#2')")
def table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search(table(spark, sf_dir, "part"), " BRAND#2 ", ["p_name", "p_brand", "p_type", "p_size"]).select("p_partkey")


@query(f"with {BOXES_SQL} select seq, text, score from b where score >= 0.7 and contains(text, '.5')")
def find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.find_text(inputs.boxes(spark, sf_dir), ".5", least=0.7).select("seq", "text", "score")


@query(f"with {BOXES_SQL} select seq, regexp_matches(text, '[0-9]+\\.[0-9]+|[°Øø±]') or regexp_matches(text, '\\b[1-9][0-9]*\\b') as ok, regexp_matches(text, '^[1-9]$') as lone, case when orientation = 0 then x1 - x0 between 12 and 360 and y1 - y0 between 8 and 180 else x1 - x0 between 8 and 180 and y1 - y0 between 12 and 360 end as sized from b")
def dimension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return inputs.boxes(spark, sf_dir).select("seq", filters.looks_like_dimension(c("text")).alias("ok"), filters.is_lone_digit(c("text")).alias("lone"), filters.is_box_size(c("x1") - c("x0"), c("y1") - c("y0"), c("orientation")).alias("sized"))


# ---- joins of boxes


@query(f"with {BOXES_SQL}, c as (select doc_id, seq as crop_id, x0, y0, x0 + 120 as x1, y0 + 80 as y1 from b) select c.crop_id, b.seq from c join b using (doc_id) where (b.x0 + b.x1) / 2 between c.x0 - 8 and c.x1 + 8 and (b.y0 + b.y1) / 2 between c.y0 - 8 and c.y1 + 8")
def center_in_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inputs.boxes(spark, sf_dir)
    return spatial.in_crop(b, inputs.crops(b)).select(F.col("a_crop_id").alias("crop_id"), F.col("b_seq").alias("seq"))


_GAPS = "greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) as dx, greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) as dy"
_SIDES = "least(a.y1 - a.y0, b.y1 - b.y0) as lh, least(a.x1 - a.x0, b.x1 - b.x0) as lw"


@query(f"with {BOXES_SQL}, j as (select a.seq as a, b.seq as b, a.text as ta, b.text as tb, {_GAPS}, {_SIDES} from b a join b b on a.doc_id = b.doc_id and a.orientation = b.orientation and a.seq < b.seq) select a, b, dx + dy as dist from j where (dx < 1.5 * greatest(8, lh) and dy < 0.45 * greatest(8, lh) or dy < 1.2 * greatest(8, lh) and dx < 0.8 * greatest(8, lh)) and not contains(ta, '±') and not contains(tb, '±') and not (starts_with(ta, 'Ø') and starts_with(tb, 'Ø'))")
def box_pairs_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.near_pairs_vector(inputs.boxes(spark, sf_dir)).select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), "dist")


@query(f"with {BOXES_SQL}, j as (select a.seq as a, b.seq as b, a.orientation as o, {_GAPS}, {_SIDES} from b a join b b on a.doc_id = b.doc_id and a.orientation = b.orientation and a.seq < b.seq) select a, b, dx + dy as dist from j where case when o = 0 then dx < 1.5 * greatest(10, lh) and dy < 0.35 * greatest(10, lh) or dy < 0.9 * greatest(10, lh) and dx < 0.6 * greatest(10, lh) else dy < 1.5 * greatest(10, lw) and dx < 0.35 * greatest(10, lw) or dx < 0.9 * greatest(10, lw) and dy < 0.6 * greatest(10, lw) end")
def box_pairs_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.near_pairs_scanned(inputs.boxes(spark, sf_dir)).select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), "dist")


_MEET = f"{BOXES_SQL}, j as (select a.seq as a, b.seq as b, a.orientation as oa, b.orientation as ob, a.text as ta, b.text as tb, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) as i, (a.x1 - a.x0) * (a.y1 - a.y0) as s, (b.x1 - b.x0) * (b.y1 - b.y0) as t from b a join b b on a.doc_id = b.doc_id and a.seq <> b.seq where least(a.x1, b.x1) > greatest(a.x0, b.x0) and least(a.y1, b.y1) > greatest(a.y0, b.y0))"


@query(f"with {_MEET}, v as (select a, b, case when i / least(s, t) > 0.6 then 0.99 else i / (s + t - i) end::double as score from j where a < b) select a, b, round(score, 9) as score from v where score > 0.3")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.iou_pairs(inputs.boxes(spark, sf_dir)).select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), F.round("score", 9).alias("score"))


@query(f"with {_MEET}, v as (select a, b, greatest(i / (s + t - i), i / least(s, t)) as score from j where a < b) select a, b, round(score, 9) as score from v where score > 0.5")
def box_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inputs.boxes(spark, sf_dir)
    return spatial.overlapping(b, b, geometry.overlap, 0.5).where("a_seq < b_seq").select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), F.round("score", 9).alias("score"))


@query(f"with {_MEET}, v as (select a, b, i / greatest(1, s) as score from j) select a, b, round(score, 9) as score from v where score > 0.5")
def box_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inputs.boxes(spark, sf_dir)
    return spatial.overlapping(b, b, geometry.containment, 0.5).where("a_seq <> b_seq").select(F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), F.round("score", 9).alias("score"))


@query(f"with {_MEET} select seq from b where not (length(text) <= 2 and exists (select 1 from j where j.a = b.seq and j.oa <> j.ob and length(tb) > length(ta) and i / greatest(1, s) > 0.5))")
def fragment_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.suppress_fragments(inputs.boxes(spark, sf_dir)).select("seq")


_UPSERT = f"""with {BOXES_SQL}, t as (select doc_id, seq as id, x0, y0, x1, y1, text as value from b where seq % 2 = 0), n as (select doc_id, seq, x0, y0, x1, y1, text as value from b where seq % 2 = 1),
h as (select n.doc_id, n.seq, min(t.id) as id from n join t using (doc_id) where least(n.x1, t.x1) > greatest(n.x0, t.x0) and least(n.y1, t.y1) > greatest(n.y0, t.y0)
      and (least(n.x1, t.x1) - greatest(n.x0, t.x0)) * (least(n.y1, t.y1) - greatest(n.y0, t.y0)) / least((n.x1 - n.x0) * (n.y1 - n.y0), (t.x1 - t.x0) * (t.y1 - t.y0)) > 0.5 group by all),
l as (select h.doc_id, h.id, max(h.seq) as seq from h group by all),
a as (select n.doc_id, n.value, coalesce((select max(id) from t where t.doc_id = n.doc_id), 0) + row_number() over (partition by n.doc_id order by n.seq) as id from n where n.seq not in (select seq from h))
select t.doc_id, t.id, coalesce(n.value, t.value) as value, case when n.seq is null then 'kept' else 'updated' end as action from t left join l on l.doc_id = t.doc_id and l.id = t.id left join n on n.doc_id = l.doc_id and n.seq = l.seq
union all select doc_id, id, value, 'added' from a"""


@query(_UPSERT)
def overlap_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = inputs.boxes(spark, sf_dir).withColumnRenamed("text", "value")
    old = b.where("seq % 2 = 0").withColumnRenamed("seq", "id")
    return spatial.upsert(old, b.where("seq % 2 = 1")).select("doc_id", "id", "value", "action")


@query(f"with {BOXES_SQL}, j as (select a.seq, b.seq as partner, '-' || ltrim(b.text, '+-') as text, (a.score + b.score) / 2 as score, abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) as dy, b.x0 - a.x1 as dx, greatest(a.y1 - a.y0, b.y1 - b.y0) as h from b a join b b on a.doc_id = b.doc_id and a.seq <> b.seq where a.text = '-') select seq, arg_min(partner, {{'d': dy, 's': partner}}) as partner, arg_min(text, {{'d': dy, 's': partner}}) as text, round(arg_min(score, {{'d': dy, 's': partner}}), 6) as score from j where dy < 0.75 * h and dx >= 0 and dx <= greatest(10, 1.5 * h) group by seq")
def sign_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.attach_signs(inputs.boxes(spark, sf_dir)).select("seq", "partner", "text", F.round("score", 6).alias("score"))


# ---- folds


def _small_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an order, at most seven, as if they were one cluster each."""
    line = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*KEYS[1:])) - 1
    return line.select("l_orderkey", *KEYS[1:], place.alias("seq"))


@query("with o as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i from lineitem) select l_orderkey as cluster, string_agg(cast(i as varchar) || '.5', ' ' order by i) as line, min(i) * 50.0::double as x0, max(i) * 50.0 + 40.0::double as x1 from o group by 1")
def cluster_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _small_clusters(spark, sf_dir).select(F.col("l_orderkey").alias("cluster"), "seq", F.concat(F.col("seq").cast("string"), F.lit(".5")).alias("text"), (F.col("seq") * 50.0).alias("x0"), F.lit(10.0).alias("y0"), (F.col("seq") * 50.0 + 40).alias("x1"), F.lit(20.0).alias("y1"), F.lit(1.0).alias("score"))
    # one line: the two topmost boxes are not one above the other, so nothing is taken for a stacked tolerance
    return cluster.cluster_lines(b, ["cluster"]).select("cluster", F.array_join("lines", " ").alias("line"), "x0", "x1")


@query("with o as (select l_orderkey, l_tax, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i from lineitem) select l_orderkey as cluster, min(i) * 30.0::double as x0, 5::double as y0, max(i) * 30.0 + 12.0::double as x1, 5.0 + max(l_quantity) as y1, round(avg(l_quantity), 6) as mean_height, round(avg(round(l_tax, 2)), 6) as score from o group by 1")
def cluster_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*KEYS[1:])) - 1
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), place.alias("seq"), F.lit("7").alias("text"), (place * 30.0).alias("x0"), F.lit(5.0).alias("y0"), (place * 30.0 + 12).alias("x1"), (F.col("l_quantity") + 5).alias("y1"), F.round("l_tax", 2).alias("score"))
    return cluster.cluster_lines(b, ["cluster"]).select("cluster", "x0", "y0", "x1", "y1", F.round("mean_height", 6).alias("mean_height"), F.round("score", 6).alias("score"))


@query("select o_orderkey as cluster, cast(10 + o_orderkey % 80 as varchar) || ' +0.1 -0.' || cast(1 + o_orderkey % 9 as varchar) as line from orders")
def stacked_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    box = lambda seq, text, x, y: F.struct(F.lit(seq).alias("seq"), text.alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(x + 40.0).alias("x1"), F.lit(y + 10.0).alias("y1"))
    each = F.explode(F.array(box(0, (10 + k % 80).cast("string"), 0.0, 6.0), box(1, F.lit("+0.1"), 50.0, 0.0), box(2, F.concat(F.lit("-0."), (1 + k % 9).cast("string")), 50.0, 12.0)))
    b = table(spark, sf_dir, "orders").select(k.alias("cluster"), each.alias("b")).select("cluster", "b.*", F.lit(1.0).alias("score"))
    return cluster.cluster_lines(b, ["cluster"]).select("cluster", F.array_join("lines", " | ").alias("line"))


@query("select p_partkey, case p_partkey % 4 when 0 then '+0.25' when 1 then '+0.5' when 2 then '+3' else '' end as best from part")
def best_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    texts = F.when(k == 0, F.array(F.lit("-0.1"), F.lit("+ O.25"), F.lit("+7"))).when(k == 1, F.array(F.lit("0.5"), F.lit("1"))).when(k == 2, F.array(F.lit("3"))).otherwise(F.array(F.lit("1"), F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", cluster.best_tolerance(texts).alias("best"))


# ---- results

_PASSES = """q as (select l_orderkey as crop_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pass_no, l_tax as score, l_partkey % 5 as k, l_partkey from lineitem),
r as (select *, case when k = 4 then null else 10.0 end as nominal, case k when 0 then 'local' when 1 then 'global' when 2 then 'local_limit' else 'angle' end as tol_type, case when k = 3 then '' when k = 0 and l_partkey % 2 = 0 then '0' else '+0.1' end as up, case when k = 3 then '' else '-0.1' end as lo from q),
s as (select *, score + case when nominal is null then 0 else 1 + case when tol_type <> 'global' then 1 else 0 end + case when up <> '' and lo <> '' then 0.5 + case when up <> '0' and lo <> '0' then 1 else 0 end else 0 end end as quality,
      nominal is not null and tol_type in ('local', 'angle') and up not in ('', '0') and lo not in ('', '0') as complete from r),
t as (select *, min(case when complete then pass_no end) over (partition by crop_id) as stop from s)"""


@query(f"with {_PASSES} select crop_id, arg_max(pass_no, {{'q': round(quality, 9), 'p': -pass_no}}) as pass_no from t where stop is null or pass_no <= stop group by crop_id")
def best_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") % 5
    passes = line.select(
        F.col("l_orderkey").alias("crop_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*KEYS[1:])).cast("long").alias("pass_no"), F.round("l_tax", 2).alias("score"), F.when(k != 4, 10.0).alias("nominal"),
        F.when(k == 0, "local").when(k == 1, "global").when(k == 2, "local_limit").otherwise("angle").alias("tol_type"), F.when(k == 3, "").when((k == 0) & (F.col("l_partkey") % 2 == 0), "0").otherwise("+0.1").alias("upper_tol"), F.when(k == 3, "").otherwise("-0.1").alias("lower_tol"),
    )
    return results.best_pass(passes, ["crop_id"]).select("crop_id", "pass_no")


@query(f"with {BOXES_SQL} select doc_id, seq, row_number() over (partition by doc_id order by seq) as stt from b")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.number(inputs.boxes(spark, sf_dir), ["seq"], ["doc_id"]).select("doc_id", "seq", F.col("stt").cast("long").alias("stt"))


@query(f"with {BOXES_SQL} select doc_id, seq, row_number() over (partition by doc_id order by y0, x0, seq) as place from b")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.number(inputs.boxes(spark, sf_dir), [*results.reading_order(), "seq"], ["doc_id"], "place").select("doc_id", "seq", F.col("place").cast("long").alias("place"))


@query(f"with {BOXES_SQL} select doc_id, seq from (select *, row_number() over (partition by doc_id order by seq desc) as r from b) where r <= 5")
def last_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.last_rows(inputs.boxes(spark, sf_dir), F.col("seq"), 5, ["doc_id"]).select("doc_id", "seq")


@query("select p_partkey, 'P' || cast(p_size % 3 + 1 as varchar) || ': X=' || cast(p_size as varchar) || ' Y=2 W=3 H=4' as coordinates, row_number() over (partition by p_size order by p_partkey) as stt, case when p_partkey % 2 = 0 then cast(p_size as varchar) || '°' else cast(p_size as varchar) || '.5' end as nominal from part")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        "p_size", (size % 3).alias("page"), F.lit("").alias("qty"), F.lit("").alias("prefix"), (size + 0.5).alias("nominal"), F.when(F.col("p_partkey") % 2 == 0, F.concat(size.cast("string"), F.lit("°"))).otherwise(F.concat(size.cast("string"), F.lit(".50"))).alias("nominal_str"),
        F.lit("").alias("upper_tol"), F.lit("").alias("lower_tol"), F.lit("local").alias("tol_type"), F.lit("").alias("full_callout"), F.col("p_partkey").cast("string").alias("raw_text"), (size + 0.9).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("w"), F.lit(4.0).alias("h"),
    )
    out = results.export_rows(rows, [F.col("raw_text").cast("long")], ["p_size"])
    return out.select(F.col("Raw Text").cast("long").alias("p_partkey"), F.col("Toa Do Crop (X,Y,W,H)").alias("coordinates"), F.col("STT").cast("long").alias("stt"), F.col("Nominal").alias("nominal"))


@query("select p_partkey, case when p_partkey % 3 = 0 then '4x Ø ' else '' end || cast(p_size as varchar) || ' ' || case when p_partkey % 2 = 0 then '±0.1' else '+0.1/0' end || case when p_partkey % 5 = 0 then ' TYP' else '' end as callout from part")
def callout_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lead = lambda text: F.when(k % 3 == 0, text).otherwise("")
    out = full_callout(lead("4x"), lead("Ø"), F.col("p_size").cast("string"), F.lit("+0.1"), F.when(k % 2 == 0, "-0.1").otherwise("0"), F.when(k % 5 == 0, "TYP").otherwise(""), F.lit(False))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("callout"))


@query("select p_partkey, case when p_partkey % 7 = 0 then 'none' when p_partkey % 2 = 0 then 'crop' else 'page' end as source from part")
def arbitrate_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("crop_id"))
    k = F.col("crop_id")
    dim = lambda nominal, up, lo, kind: F.struct(nominal.cast("double").alias("nominal"), F.lit(up).alias("upper_tol"), F.lit(lo).alias("lower_tol"), F.lit(kind).alias("tol_type"))
    page = part.select(k, F.when(k % 7 != 0, dim(k, "", "", "global")).alias("dim"))
    crop = part.select(k, F.lit(False).alias("tall"), F.when(k % 7 != 0, dim(F.when(k % 2 == 0, k + 0.01).otherwise(k + 1), "+0.1", "-0.1", "local")).alias("dim"))
    return results.arbitrate(page, crop).select(k.alias("p_partkey"), "source")


@query("select p_partkey, case when p_partkey % 2 = 0 then 'seen' else p_name end as p_name, p_size from part")
def overlay_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    top = part.where("p_partkey % 3 > 0 or p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "seen").otherwise("").alias("p_name"), F.lit(None).cast("int").alias("p_size"))
    return results.overlay(part, top, "p_partkey", ["p_name", "p_size"])


@query(f"with {BOXES_SQL} select seq, greatest(0, least(x0 + 30, 1000 - (x1 - x0))) as x0, least(1000, greatest(x0 + 10, x1 - 40)) as narrowed, greatest(0, x0 - 10) as padded, round(sqrt(pow(greatest(x0, least(500, x1)) - 500, 2) + pow(greatest(y0, least(350, y1)) - 350, 2)), 6) as leader from b")
def edit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, w, h = Rect.of(), F.lit(1000.0), F.lit(700.0)
    return inputs.boxes(spark, sf_dir).select("seq", geometry.moved(r, F.lit(30.0), F.lit(0.0), w, h).x0.alias("x0"), geometry.resized(r, F.lit(-40.0), F.lit(0.0), w, h).x1.alias("narrowed"), geometry.padded(r, 10, 8, w, h).x0.cast("double").alias("padded"), F.round(geometry.nearest_point(r, F.lit(500.0), F.lit(350.0))[2], 6).alias("leader"))


@query("select event_id, 0 as item_no, 0.1::double as crop_x, 0.2::double as crop_y, 0.3::double as crop_width, (event_id % 900 + 6) / 1000.0::double as crop_height, event_type as label from events where (event_id % 900 + 6) / 1000.0 <= 0.6")
def vision_box_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda top: F.concat(F.lit('{"box_2d":[200,100,'), top.cast("string"), F.lit(',400],"label":"'), F.col("event_type"), F.lit('"}'))
    low = F.lit('{"box_2d":[1,2,3],"label":"short"}')
    answer = F.concat(F.lit('```json\n{"dimensions":['), item(F.col("event_id") % 900 + 206), F.lit(","), low, F.lit("]}\n```"))
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(1000.0).alias("width"), F.lit(700.0).alias("height"), answer.alias("answer"))
    return box_sources.decode_vision(rows).select("event_id", "item_no", "crop_x", "crop_y", "crop_width", F.round("crop_height", 9).alias("crop_height"), "label")


# ---- metering


@query(f"with {EVENTS_SQL} select date_trunc('day', ts)::timestamp as bucket, model, count(*) as requests, cast(sum(tokens) as bigint) as tokens from u group by all")
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metering.usage(inputs.events(spark, sf_dir), "1 day", ["model"])
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"with {EVENTS_SQL} select date_trunc('minute', ts)::timestamp as bucket, count(*) as requests, cast(sum(tokens) as bigint) as tokens from u group by all")
def usage_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.usage(inputs.events(spark, sf_dir), "1 minute").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"with {EVENTS_SQL}, m as (select date_trunc('minute', ts)::timestamp as bucket, count(*) as requests from u group by all) select bucket, requests from m where bucket >= (select max(bucket) from m) - interval 10 minute")
def usage_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metering.recent(metering.usage(inputs.events(spark, sf_dir), "1 minute"))
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "requests")


@query(f"with {EVENTS_SQL}, d as (select date_trunc('day', ts)::timestamp as bucket, count(*) as requests, cast(sum(tokens) as bigint) as tokens from u group by all), q(tier, rpd) as (values ('free', 1500), ('tiny', 100)), r as (select *, least(100.0, round(requests * 100.0 / rpd, 1)) as percent from d cross join q) select bucket, tier, requests, tokens, cast(greatest(0, rpd - requests) as bigint) as remaining, cast(percent as double) as percent, case when percent >= 90 then 'red' when percent >= 70 then 'amber' else 'normal' end as level from r")
def quota_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = metering.profiles(spark, [("free", 1500, 15, 1_000_000), ("tiny", 100, 1, 1)])
    out = metering.quota_report(metering.usage(inputs.events(spark, sf_dir), "1 day"), profile)
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "tier", "requests", "tokens", "remaining", "percent", "level")
