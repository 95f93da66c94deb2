"""Which boxes, texts and results count."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a drawing's title block; the second list only where text comes as vectors.
TITLE_WORDS = ["SCALE", "DATE", "DRAWN", "CHECKED", "APPROVED", "REV", "REVISION", "SHEET", "MATERIAL", "FINISH", "TOLERANCE", "UNLESS", "TITLE", "DWG", "WEIGHT", "THIRD", "ANGLE", "PROJECTION", "SIZE", "DO NOT SCALE", "PARTS NO", "PRODUCT NO", "TREATMENT", "HARDNESS"]
VECTOR_WORDS = ["UNIT", "DETAIL", "SYMMETRICAL"]


def has_ink(text: Column, sign: bool = False) -> Column:
    """A letter, digit or drawing symbol; with ``sign`` a bare sign counts too."""
    return text.rlike("[0-9°ØøA-Za-z。±+-]" if sign else "[0-9°ØøA-Za-z。]")


def in_title_block(x0: Column, y0: Column, width: Column, height: Column, vector: bool = True) -> Column:
    return (x0 > width * (0.50 if vector else 0.52)) & (y0 > height * (0.68 if vector else 0.70))


def in_note_strip(y0: Column, height: Column, vector: bool = True) -> Column:
    return y0 > height * (0.96 if vector else 0.962)


def is_border_label(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    edge = (x0 < width * 0.035) | (x1 > width * 0.965) | (y0 < height * 0.035) | (y1 > height * 0.965)
    return edge & (F.length(F.trim(text)) <= 2)


def has_title_word(text: Column, vector: bool = True) -> Column:
    """Holds a title word; of scanned text one with a decimal number is kept."""
    # every word has three letters on end, which few callouts have; one pattern, so the upper case is made once
    hit = text.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]{3}") & F.upper(text).rlike("|".join(re.escape(w) for w in TITLE_WORDS + VECTOR_WORDS * vector))
    return hit if vector else hit & ~text.rlike(r"[0-9]+\.[0-9]+")


def is_formula(text: Column, vector: bool = True) -> Column:
    return F.contains(text, F.lit("=")) & text.rlike("[+-]" if vector else "[±+-]")


def is_part_number(text: Column, numbers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.upper(text), F.lit(n.upper())) for n in numbers], F.lit(False))


def looks_like_dimension(text: Column) -> Column:
    return text.rlike(r"[0-9]+\.[0-9]+|[°Øø±]|(?i:^(?:[1-9][0-9]*[xX\-_])?(?:M|G|R|C|SR|DIA)\s*[0-9]+)|(?<![A-Za-z0-9_])[1-9][0-9]*(?![A-Za-z0-9_])")


def is_lone_digit(text: Column) -> Column:
    return F.trim(text).rlike("^[1-9]$")


def is_box_size(w: Column, h: Column, orientation: Column, vector: bool = False) -> Column:
    if vector:
        return (w >= 6) & (h >= 6)
    flat = (w >= 12) & (w <= 360) & (h >= 8) & (h <= 180)
    tall = (w >= 8) & (w <= 180) & (h >= 12) & (h <= 360)
    return F.when(orientation == 0, flat).otherwise(tall)


def can_be_dimension(vector: bool = True, part_numbers: list[str] | None = None) -> Column:
    """Of a box with the ``width`` and ``height`` of its page."""
    c = F.col
    keep = has_ink(c("text")) & ~in_title_block(c("x0"), c("y0"), c("width"), c("height"), vector) & ~in_note_strip(c("y0"), c("height"), vector)
    keep &= ~is_border_label(c("text"), c("x0"), c("y0"), c("x1"), c("y1"), c("width"), c("height")) & ~has_title_word(c("text"), vector) & ~is_formula(c("text"), vector)
    return keep & ~is_part_number(c("text"), part_numbers or [])


def page_filter(boxes: DataFrame, pages: DataFrame, vector: bool = True, part_numbers: list[str] | None = None) -> DataFrame:
    """Boxes of a page (``width``, ``height`` from ``pages``) that can be dimensions; page sizes stay as columns."""
    df = boxes.join(pages.select("doc_id", "page_num", "width", "height"), ["doc_id", "page_num"])
    return df.where(can_be_dimension(vector, part_numbers))


def enough_boxes(boxes: DataFrame, least: int = 3) -> DataFrame:
    """Boxes of pages with at least ``least`` of them; the others are left to scanning."""
    pages = boxes.groupBy("doc_id", "page_num").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return boxes.join(pages, ["doc_id", "page_num"], "left_semi")


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, joined by blanks, hold the query, whatever the case; an empty query gives all."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    return df.where(F.contains(text, F.lit(query.strip().lower())))


def find_text(boxes: DataFrame, query: str, exact: bool = False, case: bool = False, least: float = 0.5) -> DataFrame:
    """Boxes that hold (or are) the query with ``score`` of at least ``least``, the surest first."""
    text, wanted = (F.trim("text"), query) if case else (F.lower(F.trim("text")), query.lower())
    return boxes.where((F.col("score") >= least) & (text == wanted if exact else F.contains(text, F.lit(wanted)))).orderBy(F.desc("score"), "doc_id", "page_num", "seq")


def find_first(boxes: DataFrame, query: str, **how) -> DataFrame:
    return find_text(boxes, query, **how).limit(1)
