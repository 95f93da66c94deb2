"""Callouts, boxes and settings made from the shared tables, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A page holds the lines of three orders, so pages grow in number with the table and not in size.
ORDERS_A_PAGE = 3
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files give fewer tasks than there are cores; what is parsed costs far more than the exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _two(c) -> F.Column:
    return F.lpad(c.cast("string"), 2, "0")


def callouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` keys with ``fam`` and ``raw_text``, one of eight forms."""
    line = spread(table(spark, sf_dir, "lineitem").select(*KEYS))
    n, dd, t = 10 + F.col("l_partkey") % 90, _two(F.col("l_suppkey") % 100), 1 + F.col("l_linenumber") % 9
    n, t = n.cast("string"), t.cast("string")
    fam = ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).cast("int")
    mm, ss = F.col("l_suppkey") % 60, F.col("l_partkey") % 60
    forms = [
        F.concat(n, F.lit("."), dd, F.lit(" ±0.0"), t),
        F.concat(n, F.lit("."), dd, F.lit(" +0.1"), t, F.lit(" -0.0"), t),
        F.concat(n, F.lit("."), dd, F.lit(" +0.0"), t, F.lit(" / 0")),
        F.concat(n, F.lit("."), dd, F.lit(" 0 / -0.0"), t),
        F.concat(F.lit("Ø"), n, F.lit("."), dd),
        F.concat(n, F.lit("°"), _two(mm), _two(ss)),
        F.concat(F.lit("4x R"), n, F.lit("."), t),
        F.concat(n, F.lit("."), dd, F.lit(" -0.0"), t, F.lit(" -0.1"), t),
    ]
    text = forms[0]
    for k, form in enumerate(forms[1:], 1):
        text = F.when(fam == k, form).otherwise(text)
    return line.withColumn("fam", fam).withColumn("raw_text", text)


#: What the forms mean, by arithmetic on the same columns.
CALLOUTS_SQL = """
c as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_orderkey + l_linenumber) % 8 as fam,
         cast(10 + l_partkey % 90 as varchar) as n, lpad(cast(l_suppkey % 100 as varchar), 2, '0') as dd, cast(1 + l_linenumber % 9 as varchar) as t,
         lpad(cast(l_suppkey % 60 as varchar), 2, '0') as mm, lpad(cast(l_partkey % 60 as varchar), 2, '0') as ss
  from lineitem),
e as (
  select *, case fam when 4 then 'Ø' when 6 then 'R' else '' end as prefix, case fam when 6 then '4x' else '' end as qty,
         case fam when 5 then n || '°' || mm || '''' || ss || '"' when 6 then n || '.' || t else n || '.' || dd end as nominal_str,
         case fam when 0 then '+0.0' || t when 1 then '+0.1' || t when 2 then '+0.0' || t when 3 then '0' when 4 then '+0.05' when 5 then '' when 6 then '+0.1' else '-0.0' || t end as upper_tol,
         case fam when 0 then '-0.0' || t when 1 then '-0.0' || t when 2 then '0' when 3 then '-0.0' || t when 4 then '-0.05' when 5 then '' when 6 then '-0.1' else '-0.1' || t end as lower_tol,
         case fam when 4 then 'global' when 6 then 'global' when 5 then 'angle' else 'local' end as tol_type
  from c),
p as (
  select *, case when fam = 5 then nominal_str
                 else trim(qty || ' ' || prefix) || case when prefix = '' then '' else ' ' end || nominal_str || ' ' ||
                      case when upper_tol = replace(lower_tol, '-', '+') then '±' || replace(upper_tol, '+', '') else upper_tol || '/' || lower_tol end end as full_callout
  from e)
"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on pages of 1000 x 700, from ``lineitem``; ``seq`` is a number that is unique and follows the keys."""
    k = {name: F.col(name) for name in KEYS}
    line = table(spark, sf_dir, "lineitem").select(*KEYS)
    x0 = (k["l_partkey"] * 7 + k["l_linenumber"] * 131) % 900
    y0 = (k["l_suppkey"] * 13 + k["l_partkey"] * 3) % 640
    n, dd = (1 + k["l_partkey"] % 98).cast("string"), _two(k["l_suppkey"] % 100)
    text = F.when(k["l_partkey"] % 7 == 0, n).when(k["l_partkey"] % 11 == 0, "-").when(k["l_partkey"] % 13 == 0, F.concat(F.lit("±0."), dd)).when(k["l_partkey"] % 5 == 0, F.concat(F.lit("Ø"), n)).otherwise(F.concat(n, F.lit("."), dd))
    out = line.select(
        F.floor(k["l_orderkey"] / ORDERS_A_PAGE).cast("long").alias("doc_id"), F.lit(0).alias("page_num"), (((k["l_orderkey"] * 10 + k["l_linenumber"]) * 100000 + k["l_partkey"]) * 10000 + k["l_suppkey"]).alias("seq"), text.alias("text"),
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 12 + k["l_partkey"] % 70).cast("double").alias("x1"), (y0 + 9 + k["l_suppkey"] % 24).cast("double").alias("y1"),
        (0.5 + (k["l_linenumber"] % 5) / 10.0).alias("score"), F.when((k["l_partkey"] + k["l_linenumber"]) % 4 == 0, 90).otherwise(0).alias("orientation"),
    )
    return out


BOXES_SQL = """
b as (
  select l_orderkey // 3 as doc_id, cast(0 as int) as page_num, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey as seq,
         case when l_partkey % 7 = 0 then cast(1 + l_partkey % 98 as varchar) when l_partkey % 11 = 0 then '-'
              when l_partkey % 13 = 0 then '±0.' || lpad(cast(l_suppkey % 100 as varchar), 2, '0')
              when l_partkey % 5 = 0 then 'Ø' || cast(1 + l_partkey % 98 as varchar)
              else cast(1 + l_partkey % 98 as varchar) || '.' || lpad(cast(l_suppkey % 100 as varchar), 2, '0') end as text,
         cast((l_partkey * 7 + l_linenumber * 131) % 900 as double) as x0, cast((l_suppkey * 13 + l_partkey * 3) % 640 as double) as y0,
         cast((l_partkey * 7 + l_linenumber * 131) % 900 + 12 + l_partkey % 70 as double) as x1, cast((l_suppkey * 13 + l_partkey * 3) % 640 + 9 + l_suppkey % 24 as double) as y1,
         0.5 + (l_linenumber % 5) / 10.0::double as score, case when (l_partkey + l_linenumber) % 4 = 0 then 90 else 0 end as orientation
  from lineitem)
"""


def crops(boxes_: DataFrame) -> DataFrame:
    """A crop of 120 x 80 at each box."""
    return boxes_.select("doc_id", "page_num", F.col("seq").alias("crop_id"), "x0", "y0", (F.col("x0") + 120).alias("x1"), (F.col("y0") + 80).alias("y1"))


def pages(boxes_: DataFrame) -> DataFrame:
    return boxes_.select("doc_id", "page_num").distinct().select("doc_id", "page_num", F.lit(1000.0).alias("width"), F.lit(700.0).alias("height"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ts, model, tokens)``: a request per event."""
    return table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), F.floor(F.col("value") * 100).cast("long").alias("tokens"))


EVENTS_SQL = "u as (select ts, event_type as model, cast(floor(value * 100) as bigint) as tokens from events)"
