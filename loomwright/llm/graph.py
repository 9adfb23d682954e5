"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot_apart, stored

ONE_TASK_EDGES = 2_000_000


class Forest:
    """Union-find with the least key as root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def rows(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up)]


def _in_one_task(batches):
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            forest.join(x, y)
    rows = forest.rows()
    for k in range(0, len(rows), 100_000):
        nodes, roots = zip(*rows[k : k + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """node, root: every node that an edge joins to another, with the least node it can reach.

    Alternating large-star and small-star steps: each links a node's neighbours to the least of them,
    and a logarithmic number of rounds leaves stars. Minima are partial aggregates and are joined back, so a
    node with very many neighbours isn't gathered anywhere. Every round is stored. Up to ``one_task_edges`` edges
    (they are counted) are instead solved by union-find in one task, which takes seconds.
    """
    g = stored(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    if g.count() <= one_task_edges:
        return g.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    before = None
    while True:
        both = g.unionByName(g.select(F.col("v").alias("u"), F.col("u").alias("v")))
        both = stored(both, "edges-both")
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edges-least")
        large = join_hot_apart(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "edges-large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "edges-least")
        small = join_hot_apart(large, least, ["u"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        g = stored(small, "edges")
        now = tuple(g.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return g.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
