"""Result rows: choosing among readings, numbering, merging, edits and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPLETE = ["local", "local_stacked", "angle"]


def quality(score: Column, nominal: Column, tol_type: Column, upper: Column, lower: Column) -> Column:
    """Mean confidence, +1 with a nominal, then +1 for a tolerance of its own, +0.5 if both sides are given and +1 more if neither is 0."""
    both = (upper != "") & (lower != "")
    more = F.when(tol_type.isin(*COMPLETE, "local_limit"), 1.0).otherwise(0.0) + F.when(both, 0.5).otherwise(0.0) + F.when(both & (upper != "0") & (lower != "0"), 1.0).otherwise(0.0)
    return F.coalesce(score, F.lit(0.0)) + F.when(nominal.isNotNull(), 1.0 + more).otherwise(0.0)


def is_complete(nominal: Column, tol_type: Column, upper: Column, lower: Column) -> Column:
    return nominal.isNotNull() & tol_type.isin(*COMPLETE) & ~upper.isin("", "0") & ~lower.isin("", "0")


def best_pass(passes: DataFrame, keys: list[str]) -> DataFrame:
    """The best of several readings of one thing, one row per ``keys``.

    Readings up to the first complete one, in order of ``pass_no``, count; of
    those the highest quality wins, the earlier at a tie.  One exchange: the
    window and the aggregate are by the same keys.
    """
    c = F.col
    rows = passes.withColumn("quality", quality(c("score"), c("nominal"), c("tol_type"), c("upper_tol"), c("lower_tol"))).withColumn("_full", is_complete(c("nominal"), c("tol_type"), c("upper_tol"), c("lower_tol")))
    others = [x for x in rows.columns if x not in (*keys, "_full")]
    stop = F.min(F.when(c("_full"), c("pass_no"))).over(Window.partitionBy(*keys))
    kept = rows.withColumn("_stop", stop).where(c("_stop").isNull() | (c("pass_no") <= c("_stop")))
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("quality", -c("pass_no"))).alias("b")).select(*keys, "b.*")


def arbitrate(page: DataFrame, crop: DataFrame, key: str = "crop_id") -> DataFrame:
    """A crop's reading from the page's scan and from its own, ``dim`` of either may be null.

    A tall crop's own reading wins.  Else the page's, replaced by the crop's if
    the nominals agree within 0.05 and the crop has both tolerances, or the page
    has neither and the crop's is local.  Else the crop's.
    """
    both = page.select(key, F.col("dim").alias("p")).join(crop.select(key, "tall", F.col("dim").alias("c")), key, "full")
    p, c = F.col("p"), F.col("c")
    agree = F.abs(p["nominal"] - c["nominal"]) <= 0.05
    full = (c["upper_tol"] != "") & (c["lower_tol"] != "")
    bare = (p["upper_tol"] == "") & (p["lower_tol"] == "") & F.startswith(c["tol_type"], F.lit("local"))
    take = F.coalesce(F.col("tall"), F.lit(False)) & c.isNotNull() | p.isNull() | F.coalesce(agree & (full | bare), F.lit(False))
    return both.select(key, F.when(take, c).otherwise(p).alias("dim"), F.when(take & c.isNotNull(), "crop").when(p.isNotNull(), "page").otherwise("none").alias("source"))


def overlay(base: DataFrame, top: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``base`` with each field that ``top`` has, not null and not empty, put over it."""
    new = top.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return base.join(new, key, "left").select(*[c for c in base.columns if c not in fields], *[F.coalesce(F.nullif(F.col(f"_{f}").cast("string"), F.lit("")).cast(base.schema[f].dataType), F.col(f)).alias(f) for f in fields])


def number(rows: DataFrame, order: list, by: list[str] | None = None, name: str = "stt") -> DataFrame:
    """Rows numbered from 1 in order, within ``by`` (a document, say); without it the whole table is one sequence in one task."""
    window = Window.partitionBy(*(by or [])).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(window))


def last_rows(rows: DataFrame, order: Column, k: int, by: list[str]) -> DataFrame:
    """The last ``k`` rows of each ``by``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order.desc()))).where(F.col("_n") <= k).drop("_n")


def reading_order() -> list[Column]:
    return [F.col("y0").asc(), F.col("x0").asc()]


def by_id(rows: DataFrame, newest_first: bool = True, id_col: str = "id") -> DataFrame:
    """The result table as it is shown: by id, the newest on top unless turned round."""
    return rows.orderBy(F.col(id_col).desc() if newest_first else F.col(id_col).asc())


def delete_rows(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def rotate(rows: DataFrame, column: str = "crop_rotation") -> DataFrame:
    """A quarter turn further."""
    return rows.withColumn(column, F.pmod(F.col(column) + 90, F.lit(360)))


def is_angle(tol_type: Column, nominal_str: Column) -> Column:
    return F.coalesce(tol_type, F.lit("")).isin("angle", "angle_tol") | F.coalesce(nominal_str, F.lit("")).rlike("[°'\"]")


# The column names of the sheet.
EXPORT = ["STT", "So Luong", "Ky Hieu", "Nominal", "Dung Sai Tren (+)", "Dung Sai Duoi (-)", "Loai Dung Sai", "Full Callout", "Raw Text", "Toa Do Crop (X,Y,W,H)"]


def export_rows(rows: DataFrame, order: list, by: list[str] | None = None, missing: str = "") -> DataFrame:
    """The ten columns of a sheet, in order.

    Angles show their text, other rows the number; the page counts from 0 in
    the rows and from 1 in the sheet; ``missing`` stands for a box that is not
    there (the workbook has ``-``).
    """
    shown = F.when(is_angle(F.col("tol_type"), F.col("nominal_str")), F.col("nominal_str")).otherwise(F.coalesce(F.col("nominal").cast("string"), F.lit("")))
    spot = F.when(F.col("x").isNull(), missing).otherwise(F.format_string("P%d: X=%d Y=%d W=%d H=%d", F.col("page") + 1, F.col("x").cast("long"), F.col("y").cast("long"), F.col("w").cast("long"), F.col("h").cast("long")))
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    values = [F.col("STT"), none("qty"), none("prefix"), shown, none("upper_tol"), none("lower_tol"), none("tol_type"), none("full_callout"), none("raw_text"), spot]
    return number(rows, order, by, "STT").select(*(by or []), *[v.alias(n) for v, n in zip(values, EXPORT, strict=True)])


def client_callout(qty: Column, prefix: Column, nominal: Column, upper: Column, lower: Column) -> Column:
    """The callout as the result table shows it: without suffix, the tolerance only where one is given."""
    from gaugeworks.functions.callout import spoken, tolerance_text

    tolerance = F.when((upper != "") | (lower != ""), tolerance_text(F.when(upper == "", "0").otherwise(upper), F.when(lower == "", "0").otherwise(lower)))
    return spoken(qty, prefix, nominal, F.coalesce(tolerance, F.lit("")))
