"""Connected components of a link table by alternating stars.

In a large-star step every vertex ties its larger neighbours to its smallest neighbour, in a
small-star step its smaller ones. Edges only ever point to smaller vertices, their number does
not grow, and after a logarithmic number of rounds every component is one star around its
smallest vertex. Each step is a minimum by vertex (combined before the shuffle) and a join,
whose hot vertices adaptive execution can split, since both of its sides are materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import Workspace, materialize


def _smallest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of every vertex `u`."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _mark(edges: DataFrame) -> tuple:
    """A checksum that does not depend on the order of rows."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`id` and `component` (the smallest id reachable) of every vertex that has a link.

    Repeated links and both directions are fine, links of a vertex to itself or to null are
    ignored, and no link gives an empty table.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    tables = Workspace(links.sparkSession)
    edges = tables.write(
        links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(u.alias("u"), v.alias("v")).distinct()
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = tables.write(
            both.filter("v > u").join(tables.write(_smallest(both)), "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        near = tables.write(_smallest(large))
        edges = tables.write(
            large.join(near, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        )
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    found = materialize(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots))
    tables.drop()
    return found
