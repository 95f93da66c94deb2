"""Usage counters by minute and day, and what of the quota is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Price of a million tokens; level from which usage is shown as high and as critical.
COST_PER_MILLION, AMBER, RED = 0.075, 70, 90
MOST_PROFILES = 1000
PROFILE = "tier string, rpd long, rpm long, tpm long"


def usage(events: DataFrame, every: str, by: list[str] | None = None) -> DataFrame:
    """Requests and tokens per bucket of event time (``1 minute``, ``1 day``); ``events(ts, model, tokens)``.  Also on streams with a watermark."""
    out = events.groupBy(F.window("ts", every), *(by or [])).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return out.select(F.col("window.start").alias("bucket"), *(by or []), "requests", "tokens")


def recent(minutes: DataFrame, keep: int = 10) -> DataFrame:
    """Of minute counters the current one and the ``keep`` before it, by the latest bucket; a broadcast of one row."""
    last = F.broadcast(minutes.agg(F.max("bucket").alias("_last")))
    return minutes.join(last, F.col("bucket") >= F.col("_last") - F.expr(f"interval {keep} minutes")).drop("_last")


def quota_report(daily: DataFrame, profile: DataFrame) -> DataFrame:
    """Per day and profile: used, remaining, percent and cost; level is red from 90, amber from 70.

    Every day is held against every profile, of which there are
    ``MOST_PROFILES`` at most; more are an error.
    """
    rows = [r.asDict() for r in profile.limit(MOST_PROFILES + 1).collect()]
    if len(rows) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    each = F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in profile.schema]) for r in rows])
    both = daily.select("*", F.inline(each)) if rows else daily.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in profile.schema]).limit(0)
    percent = F.least(F.lit(100.0), F.round(F.col("requests") * 100.0 / F.col("rpd"), 1))
    out = both.withColumn("remaining", F.greatest(F.lit(0), F.col("rpd") - F.col("requests"))).withColumn("percent", percent)
    return out.withColumn("cost", F.round(F.col("tokens") / 1e6 * COST_PER_MILLION, 4)).withColumn("level", F.when(F.col("percent") >= RED, "red").when(F.col("percent") >= AMBER, "amber").otherwise("normal"))


def profiles(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """Quota profiles; a handful of rows by nature."""
    return spark.createDataFrame(rows or [("free", 1500, 15, 1_000_000), ("paid", 10_000, 1000, 4_000_000)], PROFILE)


def try_order(preferred: str, models: list[str]) -> list[str]:
    """The preferred model, then the others in order."""
    return [preferred, *[m for m in dict.fromkeys(models) if m != preferred]]
