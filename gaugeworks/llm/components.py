"""Connected components of an edge table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm._store import discard, settle


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node long, root long)``, one row per node of an edge.

    ``root`` is the smallest node that the edges reach.  Each round takes the
    smallest label among the neighbours (a partial aggregate before the
    shuffle, so a hub costs one row per task) and then the label's own label,
    so a path of n edges needs about log2 n rounds.  Labels live in a table in
    the shared folder, the last one only; nothing is brought to the driver but
    one answer a round.
    An empty table gives an empty table; loops and repeated edges are harmless;
    edges with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null")
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    both = settle(both.distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        out = step.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("root"))
        out = settle(out, "labels")
        discard(labels)
        labels = out.select("node", "root")
        labels.settled_at = out.settled_at
        if out.where("old <> root").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"no fixed point in {most_rounds} rounds")
