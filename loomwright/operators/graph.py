"""Connected parts of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, part: every node of ``edges`` with the least node that it can reach.

    Each round a node and its parent take the least parent among the node's neighbours, and then their parent's
    parent, so trees halve their height while they grow together. Minima are partial aggregates, and
    every round is checkpointed. Edges with a null end don't count.
    """
    own = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("node"), F.col(b).alias("next"))
    both = settled(own.unionByName(own.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct())
    now = settled(both.groupBy("node").agg(F.least("node", F.min("next")).alias("part")))
    while True:
        near = both.join(now.select(F.col("node").alias("next"), "part"), "next").groupBy("node").agg(F.min("part").alias("least"))
        offers = now.join(near, "node").select(F.explode(F.array(F.struct("node", "least"), F.struct(F.col("part").alias("node"), "least"))).alias("o")).groupBy("o.node").agg(F.min("o.least").alias("least"))
        hooked = now.join(offers, "node").select("node", F.least("part", "least").alias("part"), F.col("part").alias("old"))
        hooked = settled(hooked)
        up = hooked.select(F.col("node").alias("part"), F.col("part").alias("above"))
        now = settled(hooked.join(up, "part").select("node", F.least("part", "above").alias("part"), "old"))
        done = now.filter("part != old").isEmpty()
        now = now.select("node", "part")
        if done:
            return now
