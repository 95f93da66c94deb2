"""Folds, rules, sources and streams on small hand-made tables, and the catalogue against DuckDB."""

import io
import os
import random
import subprocess
import sys
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.tolerance import band_join
from gaugeworks.operators import cluster, filters, metering, pipeline, results, rules, spatial
from gaugeworks.plans import catalog
from gaugeworks.sources import boxes as sources
from gaugeworks.sources import stores
from gaugeworks.streaming import feeds

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def box(seq, text, x0, y0, x1, y1, score=1.0, orientation=0):
    return (1, 0, seq, text, float(x0), float(y0), float(x1), float(y1), score, orientation)


def lines(spark, *rows):
    df = spark.createDataFrame(list(rows), sources.BOXES)
    return cluster.cluster_lines(df, ["doc_id"]).first().lines


def test_lines_of_a_cluster(spark):
    assert lines(spark, box(1, "10.5", 0, 6, 40, 16), box(2, "+0.1", 50, 0, 80, 10), box(3, "-0.2", 50, 12, 80, 22)) == ["10.5 +0.1 -0.2"]
    assert lines(spark, box(1, "-", 0, 0, 5, 10), box(2, "0.02", 8, 0, 40, 10), box(3, "x9", 0, 40, 40, 50)) == ["-0.02", "x9"]
    assert lines(spark, box(1, "4142", 0, 0, 40, 10), box(2, "41.42", 2, 0, 42, 10, 0.3), box(3, "B", 60, 1, 70, 11)) == ["41.42 B"]
    assert lines(spark, box(1, "only", 0, 0, 9, 9)) == ["only"]


def test_clusters_keep_two_nominals_apart(spark):
    df = spark.createDataFrame([box(1, "10", 0, 0, 20, 10), box(2, "20", 22, 0, 42, 10), box(3, "TYP", 44, 0, 60, 10), box(4, "far", 500, 500, 520, 510)], sources.BOXES)
    assert {r.seq: r.cluster for r in cluster.cluster_boxes(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_pairs_of_large_boxes(spark):
    draw = random.Random(0)
    rows = [box(i, "7", x := draw.randrange(1500), y := draw.randrange(1500), x + draw.randint(5, 240), y + draw.randint(5, 240), 1.0, draw.choice((0, 90))) for i in range(250)]
    rows += [box(250, "A", 3000, 0, 3081, 10, 1.0, 90), box(251, "B", 3000, 120, 3081, 130, 1.0, 90), box(252, "A", 5000, 0, 5010, 90), box(253, "B", 5125, 0, 5135, 90)]
    df = spark.createDataFrame(rows, sources.BOXES)
    want = {True: set(), False: set()}
    for a in rows:
        for b in rows:
            if a[2] < b[2] and a[9] == b[9]:
                dx, dy = (max(0, max(a[k], b[k]) - min(a[k + 2], b[k + 2])) for k in (4, 5))
                w, h = (min(a[k + 2] - a[k], b[k + 2] - b[k]) for k in (4, 5))
                v = max(8, h)
                if dx < 1.5 * v and dy < 0.45 * v or dy < 1.2 * v and dx < 0.8 * v:
                    want[False].add((a[2], b[2]))
                along, across, s = (dx, dy, max(10, h)) if a[9] == 0 else (dy, dx, max(10, w))
                if along < 1.5 * s and across < 0.35 * s or across < 0.90 * s and along < 0.60 * s:
                    want[True].add((a[2], b[2]))
    assert [(r.a_seq, r.b_seq) for r in spatial.near_pairs_vector(df).orderBy("a_seq", "b_seq").collect()] == sorted(want[False])
    assert [(r.a_seq, r.b_seq) for r in spatial.near_pairs_scanned(df).orderBy("a_seq", "b_seq").collect()] == sorted(want[True])
    found = {r.seq: r.cluster for r in cluster.cluster_boxes(df.where("seq >= 250"), scanned=True).collect()}
    assert found == {250: 250, 251: 250, 252: 252, 253: 252}


def test_signs_of_boxes_of_any_size(spark):
    draw = random.Random(4)
    rows = [box(i, draw.choice(["-", "5", "7.5"]), x := draw.randrange(900), y := draw.randrange(900), x + draw.randint(3, 60), y + draw.randint(4, 260), 0.5) for i in range(140)]
    want = {}
    for a in rows:
        for b in rows if a[3] == "-" else ():
            dx, dy, h = b[4] - a[6], abs((a[5] + a[7]) / 2 - (b[5] + b[7]) / 2), max(a[7] - a[5], b[7] - b[5])
            if a[2] != b[2] and dy < 0.75 * h and 0 <= dx <= max(10, 1.5 * h):
                want[a[2]] = min(want.get(a[2], (dy, b[2])), (dy, b[2]))
    out = spatial.attach_signs(spark.createDataFrame(rows, sources.BOXES)).collect()
    assert {r.seq: r.partner for r in out} == {k: v[1] for k, v in want.items()} and max(abs(rows[k][6] - rows[v[1]][4]) for k, v in want.items()) > 96


def test_suppression_is_settled(spark):
    df = spark.createDataFrame([box(1, "ab", 0, 0, 20, 10), box(2, "abcd", 1, 0, 21, 10), box(3, "z", 50, 0, 60, 10)], sources.BOXES).withColumnRenamed("text", "raw_text")
    once = cluster.suppress_overlaps(df)
    assert sorted((r.slot, r.raw_text) for r in once.collect()) == [(1, "abcd"), (3, "z")]
    assert cluster.suppress_overlaps(once.drop("slot")).count() == 2


def test_overlap_measures_are_symmetric(spark):
    df = spark.createDataFrame([box(1, "a", 0, 0, 20, 10), box(2, "b", 5, 2, 30, 40), box(3, "c", 6, 3, 9, 9)], sources.BOXES)
    pairs = {(r.a_seq, r.b_seq): r.score for r in spatial.overlapping(df, df).collect()}
    assert all(pairs[b, a] == s for (a, b), s in pairs.items()) and pairs[3, 2] == 1.0


def test_rules(spark):
    exact = spark.createDataFrame([("A 1", "", "", 1.0, "1", "+2", "-2", "user_defined", "", "1 ±2", True)], rules.EXACT)
    new = spark.createDataFrame([(1, " A 1 ", "old"), (2, "A 1", "new"), (3, " ", "x"), (4, "4°30'", "ang")], "ts int, raw_text string, full_callout string")
    learned = rules.learn(exact, new)
    assert {r.raw_text: r.full_callout for r in learned.collect()} == {"A 1": "new", "4°30'": "ang"}
    assert [r["id"] for r in rules.learn_patterns([], new)] == ["rule_dms_angle"] and rules.learn_patterns([], new.where("ts < 4")) == []
    assert rules.delete_pattern(rules.learn_patterns([], new), "none")[1] is False
    df = spark.createDataFrame([("A 1",), ("4°30' x",), ("12.5",), (None,)], "raw_text string")
    out = {r.raw_text: (r.source, r.dim.full_callout) for r in rules.parse_callouts(df, exact=exact, general=stores.default_rules()).collect()}
    assert out["A 1"] == ("adaptive_exact", "1 ±2") and out["4°30' x"][0] == "adaptive_rule" and out["12.5"] == ("grammar", "12.5 ±0.1") and out[None] == ("grammar", None)


def test_stores(spark, tmp_path):
    exact = spark.createDataFrame([("A\n1", "", "", 1.0, "1", "+2", "-2", "user_defined", "", "1 ±2", True)], rules.EXACT)
    stores.write_rules(exact, [{"id": "a", "pattern": "x"}, {"id": "b", "pattern": "("}], {"O": "0"}, str(tmp_path / "rules"))
    back, general, letters = stores.read_rules(spark, str(tmp_path / "rules"))
    assert back.collect() == exact.collect() and [g["id"] for g in general] == ["a"] and letters == {"O": "0"}
    rows = spark.createDataFrame([("1", 0, "", "", 1.5, "1.50", "", "", "local", "", "c", None, None, None, None)], "raw_text string, page int, qty string, prefix string, nominal double, nominal_str string, upper_tol string, lower_tol string, tol_type string, suffix string, full_callout string, x double, y double, w double, h double")
    sheet = stores.sheet_text(results.export_rows(rows, ["raw_text"]))
    assert sheet.startswith("﻿STT,") and sheet.splitlines()[1] == "1,,,1.5,,,local,c,1,"


def test_sources(spark):
    corners = spark.createDataFrame([(1, " 5 ", [(1.0, 2.0), (9.0, 2.0), (9.0, 6.0), (1.0, 6.0)]), (2, "!", [(0.0, 0.0)])], "seq int, text string, corners array<struct<x:double,y:double>>")
    r = sources.from_corners(corners).collect()
    assert [(x.seq, x.text, x.x0, x.y1, x.cx) for x in r] == [(1, "5", 1.0, 6.0, 5.0)]
    answers = spark.createDataFrame([(1, 100.0, 100.0, '{"dimensions":[{"box_2d":[0,0,700,10],"label":"big"},{"box_2d":[10,20,30,40]}]}'), (2, 1.0, 1.0, "no json")], "id int, width double, height double, answer string")
    assert [(x.id, x.item_no, x.label, x.x) for x in sources.decode_vision(answers).collect()] == [(1, 1, "", 2.0)]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(f"2026-01-01 00:{m:02d}:30", "m", 5) for m in (0, 0, 1, 30)], "ts string, model string, tokens long").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = feeds.usage_stream(stream).writeStream.outputMode("append").format("memory").queryName("used").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.requests, r.tokens) for r in spark.table("used").collect()) == [(1, 5), (2, 10)]
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "ts int, raw_text string, full_callout string")
    rows.write.parquet(str(tmp_path / "new"))
    feed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "new"))
    feeds.start_corrections(feed, str(tmp_path / "table"), str(tmp_path / "c2")).awaitTermination()
    assert [(r.raw_text, r.full_callout) for r in feeds.latest_rules(spark, str(tmp_path / "table")).collect()] == [("a", "y")]


def test_crops_of_two_pages(spark):
    rows = [(1, 0, 1, "12.5 ±0.1", 0.0, 0.0, 40.0, 10.0, 0.5, 0), (2, 0, 1, "7 ±0.2", 0.0, 0.0, 40.0, 10.0, 1.0, 0), (2, 0, 2, "R9", 500.0, 500.0, 520.0, 510.0, 0.8, 0)]
    crops = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 50.0, 20.0), (2, 0, 1, 0.0, 0.0, 50.0, 20.0), (2, 0, 2, 490.0, 490.0, 530.0, 520.0), (2, 0, 3, 800.0, 0.0, 810.0, 9.0)], "doc_id long, page_num int, crop_id int, x0 double, y0 double, x1 double, y1 double")
    out = pipeline.extract_crops(spark.createDataFrame(rows, sources.BOXES), crops).collect()
    assert {(r.doc_id, r.crop_id): (r.dim.full_callout, r.score, r.n_boxes) for r in out} == {(1, 1): ("12.5 ±0.1", 0.5, 1), (2, 1): ("7 ±0.2", 1.0, 1), (2, 2): ("R 9 ±0.2", 0.8, 1), (2, 3): ("", 0.0, 0)}
    assert pipeline.extract_crops(spark.createDataFrame([], sources.BOXES), crops).where("dim.success").count() == 0


def test_few_vector_boxes_fail_over(spark):
    vector = spark.createDataFrame([box(1, "12.5 ±0.1", 100, 100, 160, 112)], sources.BOXES)
    scans = spark.createDataFrame([box(7, "12.5", 100, 100, 130, 112), box(8, "±0.1", 134, 100, 160, 112)], sources.BOXES)
    pages = spark.createDataFrame([(1, 0, 1000.0, 700.0)], sources.PAGES)
    assert pipeline.detect_dimensions(vector, pages).count() == 0
    (r,) = pipeline.detect_dimensions(vector, pages, scans=scans).collect()
    assert (r.seq, r.dim.full_callout, r.x0, r.y0) == (7, "12.5 ±0.1", 92.0, 94.0)


def test_images_are_read_by_a_hook(spark):
    def engine(image):
        return [([(1, 2), (9, 2), (9, 6), (1, 6)], word, 0.5) for word in image.decode().split()]

    images = spark.createDataFrame([(1, 0, bytearray(b"12.5 !"), "x"), (2, 0, None, "x")], "doc_id long, page_num int, image binary, text string")
    out = sources.from_corners(pipeline.read_images(images, engine)).collect()
    assert [(r.doc_id, r.seq, r.text, r.score, r.x1) for r in out] == [(1, 0, "12.5", 0.5, 9.0)]


def test_sheets_settings_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a & b", 0, 1.5, 10.0), ("c", 1, 2.5, None)], "raw_text string, page int, nominal double, x double").selectExpr("*", "'' as qty", "'' as prefix", "'' as nominal_str", "'+1' as upper_tol", "'-1' as lower_tol", "'local' as tol_type", "'' as full_callout", "x as y", "x as w", "x as h")
    data = stores.sheet_workbook(results.export_rows(rows, ["raw_text"], missing="-"), "Drawing", "rules")
    sheet = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="A5"><v>1</v></c>' in sheet and "a &amp; b" in sheet and ">P1: X=10 Y=10 W=10 H=10<" in sheet and '<c r="J6" t="inlineStr"><is><t xml:space="preserve">-</t>' in sheet and "STT" in sheet
    path = str(tmp_path / "settings")
    assert stores.read_settings(spark, path, {"model": "m"}) == {"model": "m"}
    stores.write_settings(spark, {"api_key": "secret", "max_tokens": 5}, path)
    assert stores.read_settings(spark, path, {"model": "m"}) == {"model": "m", "max_tokens": 5}
    events = spark.createDataFrame([("2026-01-01 00:00:30", "m", 5)], "ts string, model string, tokens long").withColumn("ts", F.to_timestamp("ts"))
    for _ in range(2):
        stores.log_usage(events, str(tmp_path / "log"))
    assert metering.usage(spark.read.parquet(str(tmp_path / "log")), "1 day").first().tokens == 10
    table = str(tmp_path / "table")
    assert stores.load_version(spark, table) is None and stores.undo(spark, table) is None
    for n in range(4):
        assert stores.save_version(spark.range(n + 1), table, keep=2) == n
    assert [stores.load_version(spark, table, b).count() for b in range(3)] == [4, 3, 2] and stores.load_version(spark, table, 3) is None
    assert stores.undo(spark, table).count() == 3 and stores.load_version(spark, table).count() == 3
    memo = stores.Memo()
    assert memo.get("a", lambda: spark.range(3)).count() == memo.get("a", lambda: spark.range(5)).count() == 3
    memo.clear()
    assert memo.get("a", lambda: spark.range(5)).count() == 5


def test_empty_tables_and_own_columns(spark):
    none = spark.createDataFrame([], sources.BOXES)
    assert cluster.cluster_lines(none, ["doc_id"]).count() == cluster.cluster_boxes(none).count() == cluster.suppress_overlaps(none.withColumnRenamed("text", "raw_text")).count() == 0
    size = spark.createDataFrame([(2.0, "k"), (None, "k")], "size double, lo string")
    assert sorted(str(r.tol) + r.lo for r in band_join(size, "size", "f", spark).collect()) == ["0.05k", "Nonek"]
    keep = spark.createDataFrame([box(1, "ab", 0, 0, 20, 10)], sources.BOXES).withColumnRenamed("text", "raw_text").withColumn("extra", F.struct(F.lit(1).alias("a")))
    assert cluster.suppress_overlaps(keep).first().extra.a == 1


def test_entry_without_the_optional_part():
    code = "import sys; sys.modules['sentencepiece'] = None; import __spark_entry__ as e; q = e.queries(); assert 'callout_parse' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the shared tables are not here")
@pytest.mark.parametrize("name", ["union_find", "nms", "line_cluster", "callout_forms", "damaged_numbers", "cluster_bbox", "arbitrate_readings", "general_modes", "template_hits", "extract_crops", "shown_counts", "coordinates", "global_decimals", "iso2768_band", "exact_rule_lookup", "center_in_crop", "box_pairs_proximity", "fragment_suppress", "overlap_upsert", "best_pass", "quota_report"])
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part", "events", "orders"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, DATA)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    plain = lambda rows: sorted([tuple("" if v is None else str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows])
    assert plain(map(tuple, got.select(*[f"`{c}`" for c in order]).collect())) == plain(want.project(", ".join(f'"{c}"' for c in order)).fetchall())


def test_page_scan_reads_its_boxes_once(spark, tmp_path):
    spark.createDataFrame([box(i, "12.5", 200 * i, 100, 200 * i + 30, 112) for i in (1, 2)], sources.BOXES).write.parquet(str(tmp_path / "boxes"))
    boxes, pages = spark.read.parquet(str(tmp_path / "boxes")), spark.createDataFrame([(1, 0, 1000.0, 700.0)], sources.PAGES)
    found = pipeline.detect_dimensions(boxes, pages, scans=boxes)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert [(r.seq, r.stt) for r in found.collect()] == [(1, 1), (2, 2)]


def test_clusters_of_whole_pages(spark):
    rng = random.Random(5)
    texts = ["12.5", "7.25", "3", "±0.1", "+0.1", "-0.05", "Ø8", "R4", "TYP", "x", "12.5 ±0.1", "0.37"]
    rows = []
    for doc in range(60):
        for seq in range(rng.choice([1, 4, 30])):
            x, y = rng.randrange(150), rng.randrange(90)
            rows.append((doc, 0, seq * 3, rng.choice(texts), float(x), float(y), x + rng.choice([6.0, 30.0, 90.0]), y + rng.choice([5.0, 12.0, 40.0]), 0.5, rng.choice([0, 0, 0, 90])))
    boxes = spark.createDataFrame(rows, sources.BOXES)
    keys = ["doc_id", "page_num"]
    for scanned in (False, True):
        kept = spatial.suppress_fragments(boxes) if scanned else boxes
        want = {(r.doc_id, r.seq): r.cluster for r in cluster.cluster_boxes(kept, scanned).collect()}
        row = F.struct("seq", "orientation", *[v.alias(c) for c, v in cluster.traits().items()])
        whole = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("boxes")).withColumn("scanned", F.lit(scanned))
        got = {(r.doc_id, r.boxes[i].seq): r.boxes[at[0]].seq for r in cluster.cluster_pages(whole).collect() for at in r.clusters for i in at}
        assert got == want and len(set(want.items())) > len({(d, c) for (d, _), c in want.items()})
        lines = {(r.doc_id, r.cluster, r.orientation): (r.lines, r.x0, r.y1) for r in cluster.cluster_lines(kept.join(cluster.cluster_boxes(kept, scanned), [*keys, "orientation", "seq"]), [*keys, "orientation", "cluster"]).collect()}
        assert {(r.doc_id, r.seq, r.orientation): (r.lines, r.x0, r.y1) for r in cluster.page_lines(whole, keys).collect()} == lines


def test_pairs_are_met_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    group, low = rng.integers(0, 4, 200).astype(float), rng.integers(0, 900, 200).astype(float)
    high, reach = low + rng.integers(1, 80, 200), np.full(200, 12.0)
    want = {(i, j) for i in range(200) for j in range(i) if group[i] == group[j] and max(low[i], low[j]) <= (high[i] if low[i] < low[j] else high[j]) + 12 and low[i] != low[j]}
    want |= {(i, j) for i in range(200) for j in range(i) if group[i] == group[j] and low[i] == low[j]}
    for size in (7, 1 << 21):
        monkeypatch.setattr(cluster, "PAIRS", size)
        found = [(max(i, j), min(i, j)) for a, b in cluster._meeting(group, low, high, reach) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == want
    assert list(cluster._meeting(group[:0], low[:0], high[:0], reach[:0])) == []


def test_repeated_texts_are_parsed_once_for_all(spark, monkeypatch):
    monkeypatch.setattr(rules, "TOGETHER", 3)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["12.5 ±0.1", "Ø12 TYP", None, "R9", ""] * 20)], "id long, raw_text string")
    want = {r.id: r for r in rules.parse_callouts(df).select("id", "raw_text", "dim", "source").collect()}
    got = rules.parse_repeated(df, "raw_text", ["id"]).collect()
    assert len(got) == 100 and {r.id: r for r in got} == want


def test_title_words_in_any_spelling(spark):
    df = spark.createDataFrame([("Finish",), ("ﬁnish",), ("rev.B",), ("do not  scale",), ("12.5 scale",), ("RE V",), ("Ø12 TYP",), ("maßstab",)], "text string")
    assert [r[0] for r in df.select(filters.has_title_word(F.col("text"))).collect()] == [True, True, True, True, True, False, False, False]
    assert [r[0] for r in df.select(filters.has_title_word(F.col("text"), False)).collect()] == [True, True, True, True, False, False, False, False]
