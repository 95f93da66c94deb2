"""Sources of positioned text, and the tables that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOXES = "doc_id long, page_num int, seq long, text string, x0 double, y0 double, x1 double, y1 double, score double, orientation int"
PAGES = "doc_id long, page_num int, width double, height double"


def from_vector_lines(lines: DataFrame) -> DataFrame:
    """Vector text ``(doc_id, page_num, seq, text, x0, y0, x1, y1, dir_y)``: sure, and vertical where the direction is."""
    return lines.withColumn("score", F.lit(1.0)).withColumn("orientation", F.when(F.abs("dir_y") > 0.7, 90).otherwise(0)).drop("dir_y")


def from_corners(rows: DataFrame) -> DataFrame:
    """Scanned text with ``corners array<struct<x,y>>``: the box around them, the mean of the corners as ``cx, cy``; texts without ink go."""
    xs, ys = F.transform("corners", lambda p: p["x"]), F.transform("corners", lambda p: p["y"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    out = rows.withColumns({"text": F.trim("text"), "x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys), "cx": mean(xs), "cy": mean(ys)})
    return out.where(F.col("text").rlike("[0-9°ØøA-Za-z。]")).drop("corners")


def to_page_pixels(rows: DataFrame) -> DataFrame:
    """Boxes scanned on a page turned a quarter counter-clockwise (``width`` of the upright page): x = width - 1 - y, y = x."""
    return rows.select(*[c for c in rows.columns if c not in ("x0", "y0", "x1", "y1")], (F.col("width") - 1 - F.col("y1")).alias("x0"), F.col("x0").alias("y0"), (F.col("width") - 1 - F.col("y0")).alias("x1"), F.col("x1").alias("y1"))


def page_info(pages: DataFrame) -> DataFrame:
    """Per document its page count and its pages in order."""
    each = F.struct((F.col("page_num") + 1).alias("page_number"), "width", "height")
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.array_sort(F.collect_list(each)).alias("pages"))


def find_files(wanted: DataFrame, registry: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted(file_id)`` with a path: from the registry, else a file whose name begins with the id, else one of that name.

    ``files(name, path)``; ids are the text before the first ``_`` of a name.
    """
    first = files.groupBy(F.substring_index("name", "_", 1).alias("file_id")).agg(F.min("path").alias("by_prefix"))
    exact = files.groupBy(F.col("name").alias("file_id")).agg(F.min("path").alias("by_name"))
    out = wanted.join(registry.select("file_id", F.col("path").alias("known")), "file_id", "left").join(first, "file_id", "left").join(exact, "file_id", "left")
    return out.select("file_id", F.coalesce("known", "by_prefix", "by_name").alias("path"))


ANSWER = "struct<dimensions:array<struct<box_2d:array<double>,label:string>>>"


def unfenced(answer: Column) -> Column:
    """The JSON of a model's answer, out of a fenced block if there is one."""
    block = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(block != "", block).otherwise(answer))


def decode_vision(answers: DataFrame, json_col: str = "answer") -> DataFrame:
    """Boxes of a vision model's answer, ``[ymin, xmin, ymax, xmax]`` in thousandths, as shares of the page and as pixels.

    ``answers`` has ``width`` and ``height``; boxes narrower than 0.005 or wider
    than 0.6 of the page, and answers that are no JSON, give no row.
    """
    found = F.from_json(unfenced(F.col(json_col)), ANSWER)["dimensions"]
    item = answers.select(*[c for c in answers.columns if c != json_col], F.posexplode(found).alias("item_no", "_d"))
    box = F.col("_d.box_2d")
    at = lambda i: F.get(box, F.lit(i))
    out = item.where(F.size(box) == 4).withColumns({"crop_x": F.greatest(F.lit(0.0), at(1) / 1000), "crop_y": F.greatest(F.lit(0.0), at(0) / 1000), "crop_width": F.least(F.lit(1.0), (at(3) - at(1)) / 1000), "crop_height": F.least(F.lit(1.0), (at(2) - at(0)) / 1000)})
    out = out.where("crop_width between 0.005 and 0.6 and crop_height between 0.005 and 0.6").withColumn("label", F.coalesce("_d.label", F.lit("")))
    return out.withColumns({"x": F.col("crop_x") * F.col("width"), "y": F.col("crop_y") * F.col("height"), "w": F.col("crop_width") * F.col("width"), "h": F.col("crop_height") * F.col("height")}).drop("_d")
