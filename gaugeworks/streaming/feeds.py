"""Usage metering and learned corrections as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gaugeworks.operators.metering import usage
from gaugeworks.operators.rules import learn
from gaugeworks.sources.stores import _versions, read_settings, write_settings


def usage_stream(events: DataFrame, every: str = "1 minute", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Requests and tokens per bucket of event time over a stream ``(ts, model, tokens)``.

    Events up to ``late`` behind the latest still count; a bucket is written
    once, when the watermark has passed it, and its state is then dropped, so
    state holds ``late`` worth of buckets however long the stream runs.
    """
    return usage(events.withWatermark("ts", late), every, by)


def start_usage(events: DataFrame, table: str, checkpoint: str, every: str = "1 minute", late: str = "10 minutes", by: list[str] | None = None) -> StreamingQuery:
    """Writes finished buckets to a table, from where the last run stopped."""
    out = usage_stream(events, every, late, by)
    return out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table)


def start_corrections(corrections: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Puts each batch of corrections ``(ts, raw_text, ...)`` into the rule table at ``path``; the last of a text wins.

    Each batch writes a new version folder and only then the next batch starts;
    a batch that is run again after a failure overwrites its own version.
    Numbers go on from the versions that are there when the stream starts for
    the first time, which a table beside the checkpoint keeps.
    """
    spark = corrections.sparkSession
    first = read_settings(spark, f"{checkpoint}/first").get("first")
    if first is None:
        known = _versions(spark, path)
        first = known[-1] + 1 if known else 0
        write_settings(spark, {"first": first}, f"{checkpoint}/first")

    def put(batch: DataFrame, number: int) -> None:
        number += first
        spark = batch.sparkSession
        old = latest_rules(spark, path, number)
        new = learn(old, batch) if old is not None else learn(spark.createDataFrame([], _schema(batch)), batch)
        new.write.mode("overwrite").parquet(f"{path}/version={number:012d}")

    return corrections.writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def _schema(batch: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in batch.dtypes if c != "ts") + ", user_verified boolean"


def latest_rules(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rule table's last version (below ``before``), or None while there is none.  Only folder names are listed."""
    known = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version={known[-1]:012d}") if known else None
