"""General tolerances: what a dimension without one of its own gets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.columns import free_name

# Tolerance by number of decimals, and ISO 2768-1 bands (upper bound in mm; fine, medium, coarse).
DECIMALS = {0: 0.2, 1: 0.1, 2: 0.05, 3: 0.01, 4: 0.005, 5: 0.001}
BANDS = [(3.0, 0.05, 0.1, 0.2), (6.0, 0.05, 0.1, 0.3), (30.0, 0.1, 0.2, 0.5), (120.0, 0.15, 0.3, 0.8), (400.0, 0.2, 0.5, 1.2), (float("inf"), 0.3, 0.8, 2.0)]
GRADES = ("f", "m", "c")


@dataclass(frozen=True)
class Constraints:
    """``mode``: decimals, fixed, or iso2768_f, _m or _c; any other gives 0.1."""

    mode: str = "decimals"
    fixed_value: float = 0.1
    decimals: dict[int, float] = field(default_factory=lambda: dict(DECIMALS))

    @classmethod
    def of(cls, settings: dict | None) -> Constraints:
        """From settings whose keys of ``decimals`` may be strings."""
        settings = settings or {}
        table = {int(k): float(v) for k, v in (settings.get("decimals") or DECIMALS).items()}
        return cls(settings.get("mode", "decimals"), float(settings.get("fixed_value", 0.1)), table)


def decimals_of(nominal_str: Column) -> Column:
    """Characters behind the first point."""
    return F.when(F.instr(nominal_str, ".") > 0, F.length(F.element_at(F.split(nominal_str, r"\.", 3), 2))).otherwise(0)


def by_decimals(nominal_str: Column, table: dict[int, float] | None = None) -> Column:
    n, out = decimals_of(nominal_str), F.lit(None).cast("double")
    for k, v in (DECIMALS if table is None else table).items():
        out = F.when(n == k, F.lit(float(v))).otherwise(out)
    return F.coalesce(out, F.when(n >= 5, 0.001).when(n == 4, 0.005).otherwise(0.1))


def by_band(nominal: Column, grade: str) -> Column:
    """ISO 2768 linear tolerance of a size; an unknown grade counts as medium."""
    at = 1 + (GRADES.index(grade) if grade in GRADES else 1)
    out = F.lit(BANDS[-1][at])
    for band in reversed(BANDS[:-1]):
        out = F.when(F.abs(nominal) <= band[0], band[at]).otherwise(out)
    return out


def general_tolerance(nominal: Column, nominal_str: Column, constraints: Constraints) -> Column:
    if constraints.mode == "decimals":
        return by_decimals(nominal_str, constraints.decimals)
    if constraints.mode == "fixed":
        return F.lit(constraints.fixed_value)
    if constraints.mode.startswith("iso2768"):
        return by_band(nominal, constraints.mode.rsplit("_", 1)[-1])
    return F.lit(0.1)


def band_table(spark: SparkSession) -> DataFrame:
    """``(grade, lo, hi, tol)``, 18 rows: sizes above ``lo`` up to ``hi``."""
    rows, lo = [], -1.0
    for hi, *tols in BANDS:
        rows += [(g, lo, hi, t) for g, t in zip(GRADES, tols, strict=True)]
        lo = hi
    return spark.createDataFrame(rows, "grade string, lo double, hi double, tol double")


def band_join(df: DataFrame, size_col: str, grade: str, spark: SparkSession) -> DataFrame:
    """``df`` with ``tol`` from the band table: a range join against a broadcast of six rows.

    A null size has no tolerance; a column ``tol`` is replaced.
    """
    lo, hi = free_name(df, "lo"), free_name(df, "hi")
    bands = band_table(spark).where(F.col("grade") == (grade if grade in GRADES else "m")).select(F.col("lo").alias(lo), F.col("hi").alias(hi), "tol")
    size = F.abs(F.col(size_col))
    return df.drop("tol").join(F.broadcast(bands), (size > F.col(lo)) & (size <= F.col(hi)), "left").drop(lo, hi)


def plausible(tolerance: Column, nominal: Column) -> Column:
    """A quarter of the nominal at most; of a nominal below one, less than it."""
    return F.when(nominal < 1, F.abs(tolerance) < nominal).otherwise(F.abs(tolerance) <= nominal * 0.25)
