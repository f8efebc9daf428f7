"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import cut

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the least node of its component) of every node of edges (a, b; longs, no nulls).

    Each round a node takes the least label of its neighbours, then its label's label; paths shorten by half or better. The
    labels are written to the shared folder each round. They are joined by shuffles alone: a broadcast in each round, of labels
    near Spark's bound for one, would hold as many copies of them in the driver. No edges, no rows; loops and repeated edges do no harm.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("node"), "comp"))
    for _ in range(ROUNDS):
        near = both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near.hint("merge"), labels["node"] == near["a"], "left").select("node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("comp").alias("up"))
        step = cut(step.join(up.hint("merge"), "next", "left").select("node", "comp", F.least("next", F.coalesce("up", "next")).alias("new")))
        changed = step.where("new <> comp").limit(1).count()
        labels = step.select("node", F.col("new").alias("comp"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
