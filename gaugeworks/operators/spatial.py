"""Joins of boxes on a page by place.

Catalyst has no spatial join; a theta join on one page's boxes is a nested loop
over the page, which a busy page makes quadratic.  Here both sides go to the
grid cells that they reach, the join is an equi-join on page and cell, and a
pair that meets in several cells is kept in one: that of the greater of the two
left and of the two upper edges.  No distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.geometry import Rect, containment, gap, holds, iou, overlap

CELL = 64.0


def grid_join(left: DataFrame, right: DataFrame, on: list[str], reach: float | Column = 0.0, cell: float = CELL) -> DataFrame:
    """Pairs whose boxes, the left ones grown by ``reach`` to all sides, meet.

    Both sides have ``x0, y0, x1, y1``; columns come out with ``a_`` and ``b_``
    in front, those of ``on`` as they are.  ``reach`` is a number or, for each
    left row its own, an expression of left columns.  A residual condition is
    the caller's.
    """
    edge = lambda c, d: F.floor((F.col(c) + d) / cell).cast("int")

    def spread(df: DataFrame, side: str, r: Column) -> DataFrame:
        df = df.withColumn("_reach", r.cast("double"))
        r = F.col("_reach")
        df = df.withColumn("_gx", F.explode(F.sequence(edge("x0", -r), edge("x1", r)))).withColumn("_gy", F.explode(F.sequence(edge("y0", -r), edge("y1", r))))
        return df.select(*on, "_gx", "_gy", *[F.col(c).alias(side + c) for c in df.columns if c not in (*on, "_gx", "_gy")])

    pairs = spread(left, "a_", reach if isinstance(reach, Column) else F.lit(reach)).join(spread(right, "b_", F.lit(0.0)).drop("b__reach"), [*on, "_gx", "_gy"])
    r = F.col("a__reach")
    first = lambda c: F.greatest(F.floor((F.col("a_" + c) - r) / cell), F.floor(F.col("b_" + c) / cell))
    touch = (F.col("a_x0") - r <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1") + r) & (F.col("a_y0") - r <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1") + r)
    return pairs.where((F.col("_gx") == first("x0")) & (F.col("_gy") == first("y0")) & touch).drop("_gx", "_gy", "a__reach")


A, B = Rect.of("a_"), Rect.of("b_")
PAGE = ["doc_id", "page_num"]


def in_crop(boxes: DataFrame, crops: DataFrame, margin: float = 8.0) -> DataFrame:
    """Boxes whose centre lies in a crop, its edges moved out by ``margin``: (crop's ``a_`` columns, box's ``b_``)."""
    return grid_join(crops, boxes, PAGE, margin).where(holds(A, B.cx, B.cy, margin))


def meets_crop(boxes: DataFrame, crops: DataFrame) -> DataFrame:
    """Boxes that a clip rectangle touches."""
    return grid_join(crops, boxes, PAGE)


# What begins a dimension of its own, and what has a tolerance already.
HAS_PREFIX = r"(?i)^[0-9]*[xX\-_]?(?:M|G|R|C|SR|DIA|Ø)"
HAS_TOLERANCE = r"±|\+[0-9].*-[0-9]"


def _distances() -> tuple[Column, Column]:
    return gap(A.x0, A.x1, B.x0, B.x1), gap(A.y0, A.y1, B.y0, B.y1)


def near_pairs_vector(boxes: DataFrame) -> DataFrame:
    """Pairs of boxes of one page and orientation, the earlier ``seq`` first, that may be one dimension; ``dist`` is dx + dy.

    On one line: dx < 1.5 h and dy < 0.45 h; stacked: dy < 1.2 h and dx < 0.8 h,
    with h the lesser height, 8 at least.  Not if both begin with a symbol, nor
    if either has a whole tolerance.  A box reaches as far as its own height
    allows, which is no less than h, so no pair is missed.
    """
    dx, dy = _distances()
    h = F.greatest(F.lit(8), F.least(A.y1 - A.y0, B.y1 - B.y0))
    own = lambda side: F.trim(F.col(f"{side}_text"))
    veto = own("a").rlike(HAS_PREFIX) & own("b").rlike(HAS_PREFIX) | own("a").rlike(HAS_TOLERANCE) | own("b").rlike(HAS_TOLERANCE)
    near = (dx < h * 1.5) & (dy < h * 0.45) | (dy < h * 1.2) & (dx < h * 0.8)
    reach = F.greatest(F.lit(8), F.col("y1") - F.col("y0")) * 1.5
    pairs = grid_join(boxes, boxes, [*PAGE, "orientation"], reach).where(F.col("a_seq") < F.col("b_seq"))
    return pairs.where(near & ~veto).withColumn("dist", dx + dy)


def near_pairs_scanned(boxes: DataFrame) -> DataFrame:
    """As :func:`near_pairs_vector` for scanned text: 1.5 and 0.35, 0.90 and 0.60, 10 at least; at 90 degrees the axes change places."""
    dx, dy = _distances()
    h, w = F.greatest(F.lit(10), F.least(A.y1 - A.y0, B.y1 - B.y0)), F.greatest(F.lit(10), F.least(A.x1 - A.x0, B.x1 - B.x0))
    flat = (dx < h * 1.5) & (dy < h * 0.35) | (dy < h * 0.90) & (dx < h * 0.60)
    turned = (dy < w * 1.5) & (dx < w * 0.35) | (dx < w * 0.90) & (dy < w * 0.60)
    reach = F.greatest(F.lit(10), F.when(F.col("orientation") == 0, F.col("y1") - F.col("y0")).otherwise(F.col("x1") - F.col("x0"))) * 1.5
    pairs = grid_join(boxes, boxes, [*PAGE, "orientation"], reach).where(F.col("a_seq") < F.col("b_seq"))
    return pairs.where(F.when(F.col("orientation") == 0, flat).otherwise(turned)).withColumn("dist", dx + dy)


def suppress_fragments(boxes: DataFrame, least: float = 0.50, longest: int = 2) -> DataFrame:
    """``boxes`` without those of up to two characters that lie by more than half in a longer box of the other orientation.

    Both directions judge against all boxes of the other side.
    """
    short = boxes.where(F.length("text") <= longest)
    other = boxes.withColumnRenamed("orientation", "turn")
    small = short.withColumn("turn", F.when(F.col("orientation") == 0, 90).otherwise(0))
    hit = grid_join(small, other, [*PAGE, "turn"]).where((F.length("b_text") > F.length("a_text")) & (containment(A, B) > least))
    return boxes.join(hit.select(*PAGE, F.col("a_seq").alias("seq")).distinct(), [*PAGE, "seq"], "left_anti")


def overlapping(left: DataFrame, right: DataFrame, measure=overlap, least: float = 0.0) -> DataFrame:
    """Pairs of one page with ``score`` above ``least`` by the measure (:func:`iou`, :func:`overlap` or :func:`containment`)."""
    return grid_join(left, right, PAGE).withColumn("score", measure(A, B)).where(F.col("score") > least)


def iou_pairs(boxes: DataFrame, least: float = 0.30) -> DataFrame:
    return overlapping(boxes, boxes, iou, least).where(F.col("a_seq") < F.col("b_seq"))


def upsert(table: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """``table(doc_id, page_num, id, x0.., value)`` with rows of ``new`` (``seq`` for ``id``): each updates the row that it overlaps, else it is appended.

    A new row goes to the row of smallest id among those with an overlap above
    ``least``; a row that several new ones meet takes the last.  Appended rows
    are numbered on, after the largest id of their document.  The page's order
    is kept inside a document, so a document is the unit of work.
    """
    hits = overlapping(new.select(*PAGE, "seq", "x0", "y0", "x1", "y1"), table.select(*PAGE, "id", "x0", "y0", "x1", "y1"), overlap, least)
    to = hits.groupBy(*PAGE, F.col("a_seq").alias("seq")).agg(F.min("b_id").alias("id"))
    placed = new.join(to, [*PAGE, "seq"], "left")
    last = placed.where("id is not null").groupBy(*PAGE, "id").agg(F.max_by(F.struct("x0", "y0", "x1", "y1", "value"), "seq").alias("n"))
    kept = table.join(last, [*PAGE, "id"], "left").select(*PAGE, "id", *[F.coalesce(F.col("n." + c), F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1", "value")], F.when(F.col("n").isNotNull(), "updated").otherwise("kept").alias("action"))
    from pyspark.sql import Window

    top = table.groupBy("doc_id").agg(F.max("id").alias("top"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    added = placed.where("id is null").drop("id").join(top, "doc_id", "left").withColumn("id", F.coalesce("top", F.lit(0)) + number)
    return kept.unionByName(added.select(*PAGE, "id", "x0", "y0", "x1", "y1", "value", F.lit("added").alias("action")))


def absorb(moved: DataFrame, table: DataFrame, least: float = 0.6) -> DataFrame:
    """Rows of ``table`` that a moved row (by ``seq``) swallows."""
    return overlapping(moved, table, overlap, least).where(F.col("a_seq") != F.col("b_seq"))


def latest_hit(drawn: DataFrame, table: DataFrame, least: float = 0.5) -> DataFrame:
    """For each drawn box the overlapping row with the largest ``seq``."""
    return overlapping(drawn, table, overlap, least).groupBy(*PAGE, F.col("a_seq").alias("seq")).agg(F.max("b_seq").alias("hit"))


def attach_signs(boxes: DataFrame) -> DataFrame:
    """Each box that is only a sign with the nearest box at its right on the same line.

    Same line: centres nearer than three quarters of the greater height; at the
    right: 0 up to 1.5 heights, 10 at least.  The least difference of centres
    wins, then ``seq``.  Comes out: the sign's ``seq``, the partner's, and the
    joined box with the mean score.  The greater height may be either's, so signs
    reach for boxes and boxes for signs, each as far as its own height allows; a
    pair that is found twice counts once.
    """
    signs = boxes.where(F.trim("text").isin("-", "+", "±", "—", "–", "−"))
    dx, dy, h = B.x0 - A.x1, F.abs(A.cy - B.cy), F.greatest(A.y1 - A.y0, B.y1 - B.y0)
    reach = F.greatest(F.lit(10.0), (F.col("y1") - F.col("y0")) * 1.5)
    one, two = grid_join(signs, boxes, PAGE, reach), grid_join(boxes, signs, PAGE, reach)
    turned = [F.col(c).alias({"a_": "b_", "b_": "a_"}[c[:2]] + c[2:]) for c in two.columns if c[:2] in ("a_", "b_")]
    pairs = one.unionByName(two.select(*PAGE, *turned)).where((F.col("a_seq") != F.col("b_seq")) & (dy < h * 0.75) & (dx >= 0) & (dx <= F.greatest(F.lit(10.0), h * 1.5)))
    best = pairs.groupBy(*PAGE, "a_seq").agg(F.min_by(F.struct(*[c for c in pairs.columns if c[:2] in ("a_", "b_")]), F.struct(dy, F.col("b_seq"))).alias("p"))
    best = best.select(*PAGE, "p.*")
    sign = F.when(F.trim("a_text").isin("-", "—", "–", "−"), "-").otherwise(F.trim("a_text"))
    return best.select(*PAGE, F.col("a_seq").alias("seq"), F.col("b_seq").alias("partner"), F.concat(sign, F.ltrim(F.col("b_text"), F.lit("+-"))).alias("text"), F.col("a_x0").alias("x0"), F.least("a_y0", "b_y0").alias("y0"), F.col("b_x1").alias("x1"), F.greatest("a_y1", "b_y1").alias("y1"), ((F.col("a_score") + F.col("b_score")) / 2).alias("score"))
