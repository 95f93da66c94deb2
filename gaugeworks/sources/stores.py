"""Rule stores as JSON, and result sheets as CSV."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.results import EXPORT
from gaugeworks.operators.rules import ANGLE_RULE, EXACT, valid_rules

EMPTY = {"exact_matches": {}, "generalized_rules": [], "char_replacements": {}}
MOST_SHEET_ROWS = 1_000_000


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict], dict[str, str]]:
    """Exact rules as a table, patterns in order, and character replacements of a JSON store.

    The store is one object; ``nominal`` may be a number or text, of which only
    numbers become the number, the text is in ``nominal_str``.
    """
    whole = spark.read.text(path, wholetext=True).first()
    store = {**EMPTY, **(json.loads(whole[0]) if whole and whole[0].strip() else {})}
    rows = []
    for key, r in store["exact_matches"].items():
        nominal = r.get("nominal")
        number = float(nominal) if isinstance(nominal, (int, float)) and not isinstance(nominal, bool) else None
        shown = str(r.get("nominal_str") or (nominal if nominal is not None else ""))
        text = {f: str(r.get(f) or "") for f in ("qty", "prefix", "upper_tol", "lower_tol", "tol_type", "suffix", "full_callout")}
        rows.append((key.strip(), text["qty"], text["prefix"], number, shown, text["upper_tol"], text["lower_tol"], text["tol_type"] or "user_defined", text["suffix"], text["full_callout"], bool(r.get("user_verified", False))))
    return spark.createDataFrame(rows, EXACT), valid_rules(store["generalized_rules"]), dict(store["char_replacements"])


def write_rules(exact: DataFrame, general: list[dict], replacements: dict[str, str], path: str) -> None:
    """The store as one JSON object, through Spark's writer; rules are corrections made by hand and few."""
    rows = {r["raw_text"]: {k: v for k, v in r.asDict().items()} for r in exact.toLocalIterator()}
    text = json.dumps({"exact_matches": rows, "generalized_rules": general, "char_replacements": replacements}, ensure_ascii=False)
    exact.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def default_rules() -> list[dict]:
    return [dict(ANGLE_RULE)]


def write_sheets(rows: DataFrame, path: str) -> None:
    """Exported rows as CSV with a header, in parts, in any store that Spark reaches."""
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def sheet_text(rows: DataFrame, order: str = "STT") -> str:
    """One drawing's sheet with a byte-order mark, for a download; more than ``MOST_SHEET_ROWS`` rows are an error."""
    found = rows.select(*EXPORT).orderBy(order).limit(MOST_SHEET_ROWS + 1).collect()
    if len(found) > MOST_SHEET_ROWS:
        raise ValueError("too many rows for one sheet; write_sheets has no limit")
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerow(EXPORT)
    writer.writerows([list(r) for r in found])
    return "\ufeff" + out.getvalue()


def badge_counts(rows: DataFrame, shown: DataFrame, exact: DataFrame, general: list[dict]) -> DataFrame:
    """Rows shown and in all, and the number of rules."""
    parts = [df.agg(*[F.count("*").alias(n) if n == name else F.lit(0).cast("long").alias(n) for n in ("total", "shown", "exact")]) for df, name in ((rows, "total"), (shown, "shown"), (exact, "exact"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(*[F.sum(n).alias(n) for n in ("total", "shown", "exact")])
    return out.withColumn("rules", F.col("exact") + F.lit(len(general)))


# The headings of the workbook, and the name of its sheet.
WORKBOOK = ["STT", "Số Lượng", "Ký Hiệu", "Nominal (Danh nghĩa)", "Dung Sai Trên (+)", "Dung Sai Dưới (-)", "Loại Dung Sai", "Kích Thước Đầy Đủ (Callout)", "Raw Text (OCR)", "Tọa Độ Crop (X, Y, W, H)"]
SHEET = "DungSaiKichThuoc"
_OFFICE = "http://schemas.openxmlformats.org"


def sheet_workbook(rows: DataFrame, title: str, subtitle: str = "", order: str = "STT") -> bytes:
    """One drawing's sheet as a workbook: title, subtitle, headings in row 4, rows from row 5; without styles.

    ``rows`` are those of ``export_rows(..., missing="-")``; more than
    ``MOST_SHEET_ROWS`` are an error, as in :func:`sheet_text`.
    """
    found = rows.select(*EXPORT).orderBy(order).limit(MOST_SHEET_ROWS + 1).collect()
    if len(found) > MOST_SHEET_ROWS:
        raise ValueError("too many rows for one sheet; write_sheets has no limit")

    def row(n: int, values: list) -> str:
        cell = lambda k, v: f'<c r="{chr(65 + k)}{n}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f'<row r="{n}">' + "".join(cell(k, v) for k, v in enumerate(values) if v is not None) + "</row>"

    body = [row(1, [title]), row(2, [subtitle]), row(4, WORKBOOK), *[row(5 + i, list(r)) for i, r in enumerate(found)]]
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_OFFICE}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_OFFICE}/package/2006/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_OFFICE}/spreadsheetml/2006/main" xmlns:r="{_OFFICE}/officeDocument/2006/relationships"><sheets><sheet name="{SHEET}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_OFFICE}/package/2006/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_OFFICE}/spreadsheetml/2006/main"><sheetData>{"".join(body)}</sheetData><mergeCells count="2"><mergeCell ref="A1:J1"/><mergeCell ref="A2:J2"/></mergeCells></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, head + text)
    return out.getvalue()


#: Settings that are never written.
SECRET_SETTINGS = frozenset(("key", "apikey", "token", "password", "secret"))


def read_settings(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """The settings of a JSON object over ``defaults``; a folder that is not there gives these."""
    try:
        found = spark.read.text(path, wholetext=True).first()
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        found = None
    return {**(defaults or {}), **(json.loads(found[0]) if found and found[0].strip() else {})}


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """The settings as one JSON object, without secrets."""
    open_ = {k: v for k, v in settings.items() if not SECRET_SETTINGS.intersection(k.lower().split("_"))}
    spark.createDataFrame([(json.dumps(open_, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def log_usage(events: DataFrame, path: str) -> None:
    """Appends ``(ts, model, tokens)`` to the usage log, a folder per day, which :mod:`gaugeworks.operators.metering` counts."""
    events.select("ts", "model", "tokens").withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


KEPT_VERSIONS = 50


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(folder)] if store.exists(folder) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def save_version(rows: DataFrame, path: str, keep: int = KEPT_VERSIONS) -> int:
    """Writes ``rows`` as the next version of a table and gives its number; of older versions the last ``keep`` stay, to be undone to."""
    spark = rows.sparkSession
    known = _versions(spark, path)
    number = known[-1] + 1 if known else 0
    rows.write.parquet(f"{path}/version={number:012d}")
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in known[: max(0, len(known) - keep)]:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={old:012d}"), True)
    return number


def load_version(spark: SparkSession, path: str, back: int = 0) -> DataFrame | None:
    """The table's last version, or the one ``back`` steps before it; None if it goes back further than is kept."""
    known = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={known[-1 - back]:012d}") if back < len(known) else None


def undo(spark: SparkSession, path: str) -> DataFrame | None:
    """Drops the last version and gives the one before it; None, and nothing is dropped, if there is none."""
    known = _versions(spark, path)
    if len(known) < 2:
        return None
    last = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={known[-1]:012d}")
    last.getFileSystem(spark._jsc.hadoopConfiguration()).delete(last, True)
    return load_version(spark, path)


class Memo:
    """Results of scans by key, persisted until they are cleared (as when the reader changes)."""

    def __init__(self) -> None:
        self.known: dict[str, DataFrame] = {}

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.known:
            self.known[key] = make().persist()
        return self.known[key]

    def clear(self) -> None:
        for df in self.known.values():
            df.unpersist()
        self.known.clear()
