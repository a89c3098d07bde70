"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.session import written


class Forest:
    """Union-find over the links of one batch; only the links of its trees are sent on."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, node: int) -> int:
        root = node
        while (above := self.parent.setdefault(root, root)) != root:
            root = above
        while self.parent[node] != root:
            self.parent[node], node = root, self.parent[node]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def links(self) -> tuple[list[int], list[int]]:
        nodes = [node for node in self.parent if self.find(node) != node]
        return nodes, [self.find(node) for node in nodes]


def _contracted(batches):
    """The links of a partition as stars around their smallest node, one Arrow batch at a time."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.link(a, b)
        nodes, roots = forest.links()
        if nodes:
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])


def _smallest(frame: DataFrame) -> DataFrame:
    return frame.groupBy("a").agg(F.min("b").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): every linked node with the smallest node it is connected to.

    ``links`` holds pairs (a, b) of longs in any order; repeated pairs and loops do
    no harm. Each round joins every node to the smallest of its neighbours, first
    those above it (large star), then those below it (small star), until nothing
    changes: a logarithmic number of rounds. The state of a round is a table in
    the shared folder.
    """
    links = links.where(F.col("a") != F.col("b"))
    stars = written(links.mapInArrow(_contracted, "a long, b long").distinct(), "links")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = _smallest(both).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a != b").distinct()
        lows = _smallest(large)
        small = large.join(lows, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("l")
        ).select("l.*")
        stars = written(small.where("a != b").distinct(), "stars")
        now = stars.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        ).first()
        if now == before:
            break
        before = now
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


