"""Temporary columns beside a caller's own, and a setting for long chains of expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_METHODS, _SPARKS, _HOTSPOTS = "spark.sql.codegen.hugeMethodLimit", "65535", "8000"


def compile_small(spark: SparkSession) -> None:
    """Lets Spark split generated methods that HotSpot would not compile.

    HotSpot interprets methods above 8000 bytes, at a third of the speed; Spark's
    documentation names that value for it.  A session that sets the limit
    itself keeps its own.
    """
    if not spark.sparkContext.getConf().contains(_METHODS) and spark.conf.get(_METHODS) == _SPARKS:
        spark.conf.set(_METHODS, _HOTSPOTS)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def shield(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns whose names begin with an underscore renamed (or with those that renaming gives), and the new name of each column.

    Temporaries begin with an underscore and so meet no column of the caller's;
    :func:`unshield` gives the old names back.
    """
    names = {c: f"own{i}_{c}" if c.lower().startswith(("_", "own")) else c for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def unshield(df: DataFrame, names: dict[str, str], **more) -> DataFrame:
    """The caller's columns under their own names, and ``more``, which take the place of columns of the same name."""
    return df.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items() if c not in more], *[v.alias(k) for k, v in more.items()])
