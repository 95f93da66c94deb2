"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source gets a target number of words: the weights (5, 2, 1, repeating over
sources in order of their names, null last) share 150 % of all words, no target
above twice its source, the excess reshared by weight.

A source's documents are cut into blocks by a hash of their ids, and its blocks
stand in an order drawn by a hash of source and block: a permutation.  The mix
draws blocks in that order, all of them as often as the target holds the source
whole, and then once more up to the target: the last block is drawn in part,
document by document in hash order, and of its last document the first words.
The number of draws is the source's exact quota.

The quotas are split among output shards by a binary tree: each node draws, by
the multivariate hypergeometric distribution, how many draws of each source its
left half gets.  A shard takes a stretch of each source's draws, so shards are
disjoint and together complete, and a draw that no shard takes is not in the
mix.  Inside a shard rows stand in hash order.

What comes to the driver is one row per source (``most_sources`` at most).  A
source's running sum is over at most ``MOST_BLOCKS`` blocks; rows are ordered
only inside the one block that the target cuts.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm._store import fresh, settle

WEIGHTS, SHARE, MOST_TIMES = (5, 2, 1), Fraction(3, 2), 2
BLOCK_WORDS, MOST_BLOCKS, SHARDS, MOST_SOURCES = 50_000, 4096, 16, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_TIMES) -> list[Fraction]:
    """The target of each source, in the order given: proportional to weight, ``most`` times the size at most."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_weight = share * sum(sizes), sum(weight)
    out = [Fraction(0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(most * sizes[i], weight[i])):
        out[i] = min(Fraction(most * sizes[i]), left * weight[i] / open_weight)
        left -= out[i]
        open_weight -= weight[i]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """``shards`` x sources: block counts whose columns sum to ``quotas``.

    The tree halves the shards; a node's blocks go left in proportion to the
    shards on the left, which sources they are of is drawn without replacement.
    """
    if shards == 1:
        return quotas[None, :]
    half, total = shards // 2, int(quotas.sum())
    draw = np.random.default_rng(np.random.SeedSequence([seed, shards]))
    left = draw.multivariate_hypergeometric(quotas, total * half // shards, method="marginals")
    return np.concatenate([split_quotas(left, half, 2 * seed + 1), split_quotas(quotas - left, shards - half, 2 * seed + 2)])


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, shards: int = SHARDS, split_last: bool = True, most_sources: int = MOST_SOURCES) -> DataFrame:
    """One row per row of ``df``: ``id, source, size, source_size, target, copies, taken, part, shards``.

    ``taken`` is the number of words that the mix takes; it sums to the rounded
    target of each source.  With ``split_last`` false the document that the
    target cuts is taken whole or not, whichever is nearer.  ``copies`` is how
    often the document is in the mix, the one in part included; ``part`` is how
    many words that one has (null: none is in part); ``shards`` has the shard of
    each copy, the one in part last.  Null texts have size 0; rows without words
    are never taken; a null source is a source; rows of one id stand together,
    by size.  The same rows give the same mix, however they are stored.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    drawn = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("long")
    own = settle(own.withColumn("at", drawn(F.coalesce(F.col("id").cast("string"), F.lit("")))), "sizes")
    per = own.groupBy("source").agg(F.sum("size").alias("size")).limit(most_sources + 1).collect()
    if len(per) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    per.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes, spark, rows = [r["size"] for r in per], df.sparkSession, []
    for rank, (r, target) in enumerate(zip(per, targets(sizes), strict=True)):
        whole, rest = divmod(round(target), r["size"]) if r["size"] else (0, 0)
        rows.append((rank, r["source"], r["size"], float(target), whole, rest, max(1, min(MOST_BLOCKS, -(-r["size"] // BLOCK_WORDS)))))
    kind = "rank int, source string, source_size long, target double, whole int, rest long, blocks int"
    known = F.broadcast(spark.createDataFrame(rows, kind))  # a row per source
    placed = own.join(known, own["source"].eqNullSafe(known["source"])).drop(known["source"])
    placed = placed.withColumn("block", F.floor(F.col("at") / F.lit(float(16**13)) * F.col("blocks")).cast("int"))
    words = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"))
    # every block of every source, those without a row too, in drawn order
    every = known.select("rank", "rest", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    order = Window.partitionBy("rank").orderBy(drawn(F.col("rank").cast("string"), F.col("block").cast("string")), "block")
    every = every.join(words, ["rank", "block"], "left").withColumn("words", F.coalesce("words", F.lit(0))).withColumns({"place": F.row_number().over(order) - 1, "end": F.sum("words").over(order)})
    blocks = settle(every.select("rank", "block", "place", (F.col("end") - F.col("words")).alias("begin"), "end", "rest"), "blocks")  # MOST_BLOCKS rows a source at most
    # of the last pass a source draws the blocks that begin before its rest is used up
    more = {r["rank"]: r["n"] for r in blocks.where("begin < rest").groupBy("rank").agg((F.max("place") + 1).cast("int").alias("n")).collect()}
    quotas = np.array([r[4] * r[6] + more.get(r[0], 0) for r in rows], np.int64)
    split = np.cumsum(split_quotas(quotas, shards, seed), axis=0).T if rows else np.empty((0, shards))
    ends = F.broadcast(spark.createDataFrame([(r[0], [int(x) for x in e]) for r, e in zip(rows, split, strict=True)], "rank int, ends array<long>"))
    places = blocks.select("rank", "block", "place", F.greatest(F.lit(0), F.col("rest") - F.col("begin")).alias("room"), (F.col("end") > F.col("rest")).alias("cut"))
    placed = placed.join(ends, "rank").join(places, ["rank", "block"])
    shard = lambda k: F.size(F.filter(F.col("ends"), lambda e: e <= k * F.col("blocks") + F.col("place")))
    placed = placed.withColumn("shards", F.filter(F.transform(F.sequence(F.lit(0), F.col("whole")), shard), lambda s: s < shards))
    last = F.size("shards") > F.col("whole")  # the tree hands out the block once more
    before = F.coalesce(F.sum("size").over(Window.partitionBy("rank").orderBy("at", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("room") - before))
    if not split_last:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    inside = placed.where(last & F.col("cut")).withColumn("more", part)
    beside = placed.where(~(last & F.col("cut"))).withColumn("more", F.when(last, F.col("size")).otherwise(F.lit(0)))
    out = inside.unionByName(beside).withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("more") > 0, 1).otherwise(0)).otherwise(0).cast("int"))
    taken, cut = (F.col("whole") * F.col("size") + F.col("more")).cast("long"), (F.col("more") > 0) & (F.col("more") < F.col("size"))
    return out.select("id", "source", "size", "source_size", "target", "copies", taken.alias("taken"), F.when(cut, F.col("more")).alias("part"), F.slice("shards", 1, F.col("copies")).alias("shards"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, shards: int = SHARDS, split_last: bool = True) -> DataFrame:
    """The mix that :func:`plan` draws: rows of ``df``, all columns, as often as drawn; ``shard`` is added.

    With ``split_last`` one row per source at most has a text cut behind its
    last word taken, its words joined by one space; without, documents are whole.  Rows are dealt by shard, a
    large shard to several partitions, and stand in hash order inside.  A column
    of ``df`` named ``shard`` is replaced.  Where rows share an id, each is
    taken as often as the most taken of them.
    """
    key, copy, found = (fresh(df, c) for c in ("key", "copy", "found"))
    times = plan(df, id_col, text_col, source_col, seed, shards, split_last).where("copies > 0").groupBy(F.col("id").alias(key)).agg(F.max(F.struct("copies", "shards", "part")).alias(found))
    names = [c for c in df.columns if c.lower() != "shard"]
    out = df.select(*names).join(times, F.col(id_col).eqNullSafe(F.col(key)))
    out = out.select(*names, F.col(found)["copies"].alias(key), F.col(found)["part"].alias(found), F.posexplode(F.col(found)["shards"]).alias(copy, "shard"))
    if split_last:
        cut = (F.col(copy) == F.col(key) - 1) & F.col(found).isNotNull()
        head = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, F.col(found).cast("int")), " ")
        out = out.withColumn(text_col, F.when(cut, head).otherwise(F.col(text_col)))
    return out.select(*names, copy, "shard").hint("rebalance", "shard").sortWithinPartitions("shard", F.xxhash64(F.col(id_col), F.col(copy), F.lit(seed))).drop(copy)
