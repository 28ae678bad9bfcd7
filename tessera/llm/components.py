"""Connected components of an edge table by large-star and small-star steps.

Each step links the neighbours of a node to the smallest of them. Neighbours are never listed:
the smallest is an aggregate that is combined before the shuffle, and is joined back. Every
round is written to the shared folder, so lineage stays short; rounds end when the edges no
longer change, which an exact count and sum of hashes tell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import settle


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of any order: each node that has an edge (a), and the least node it reaches (b)."""
    edges = edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    edges, seen = settle(edges), None
    while True:
        mark = _mark(edges)
        if mark == seen or mark[0] == 0:
            return edges
        seen = mark
        both = edges.union(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("explode(array(struct(a AS a, m AS b), struct(b AS a, m AS b))) AS e").selectExpr("e.a", "e.b")
        edges = settle(small.where("a <> b").distinct())
