"""Connected components of a graph held as an edge table: distributed union-find.

Each round first unites the edges of a partition in memory-bounded chunks (an
ordinary union-find with path halving; an edge becomes a link to the chunk's
smallest member), then hangs every node below the smallest neighbour of its
neighbours (large-star) and of its smaller neighbours (small-star).  The rounds
end when the edges are a forest of stars.  Nothing is collected; each round is
written to the shared folder.  A graph that has no more than one chunk of edges
needs one union-find in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import keep, ship

#: Edges that one union-find holds at a time.
CHUNK = 500_000


def union_find(edges: Iterator[tuple]) -> dict:
    """node -> smallest node of its component, for the nodes of ``edges``."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    return {x: root(x) for x in list(parent)}


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, held = None, []

    def stars() -> pa.RecordBatch:
        found = [(x, top) for x, top in union_find(iter(held)).items() if x != top]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([t for _, t in found], kind)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(held) > CHUNK:
            yield stars()
    if held:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the smallest node of its component.

    Loops and edges with a null end are ignored, repeated edges are one, and a
    table without edges gives an empty result.
    """
    ship(edges.sparkSession)
    kind = dict(edges.dtypes)["a"]
    schema = f"a {kind}, b {kind}"
    # b is the smaller end from here on
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = keep(edges.distinct())
    if edges.count() <= CHUNK:  # a size that one union-find holds
        stars = keep(edges.coalesce(1).mapInArrow(_unite, schema))
        return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    while True:
        edges = keep(edges.mapInArrow(_unite, schema).distinct())
        several = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        inner = edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if several.isEmpty() and inner.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # (a table of its own, so that the rows of a hub can be split over tasks)
        least = keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = keep(both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        edges = small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct()
