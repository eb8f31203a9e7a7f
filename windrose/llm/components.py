"""Connected components of an edge table by alternating large-star and small-star steps, each an aggregation and a join.

No vertex's neighbours are ever gathered: a step needs only the smallest neighbour.  The number of rounds grows with the
logarithm of the longest shortest path; edges that are stars around their smallest vertex are recognised and need none.  Both
sides of a step's join stem from one edge table and are merged in the tasks: nothing is sent through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = near.join(low.hint("merge"), "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges (u > v) are stars around their smallest vertices: a large and a small star would return them as they are."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))))
    vertex = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return not vertex.agg(F.bool_or(F.col("ups") > F.col("low"))).first()[0]


def components(edges: DataFrame, rounds: int = 500) -> DataFrame:
    """(u, v) long edges -> (node, comp): comp is the smallest vertex reachable; vertices without an edge do not appear.

    Loops and repeated or reversed edges are allowed; null ends are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    done = _settled(e)
    for _ in range(rounds):
        if done:
            break
        e = cut_lineage(_star(_star(e, True), False))
        done = _settled(e)
    if not done:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
