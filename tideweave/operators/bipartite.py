"""Bipartiteness through the double cover.

Vertex v becomes v+ and v-; an edge (u, v) joins u+ with v- and u- with v+.  A
component holds an odd cycle (a loop is one) if and only if v+ and v- fall into
the same component of the cover for its vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideweave.operators.components import connected_components


def bipartite_sides(edges: DataFrame) -> DataFrame:
    """``(vertex, component, side, bipartite)``; the smallest vertex is on side true.

    Where the vertex's component holds an odd cycle, ``bipartite`` is false and
    ``side`` null.
    """
    s, d = F.col("src") * 2, F.col("dst") * 2
    cover = edges.select(
        F.explode(F.array(F.struct(s.alias("src"), (d + 1).alias("dst")), F.struct((s + 1).alias("src"), d.alias("dst")))).alias("e")
    ).select("e.*")
    labels = connected_components(cover)
    vertex, minus = F.shiftright("vertex", 1), F.col("vertex").bitwiseAND(F.lit(1).cast("long")) == 1
    per = labels.groupBy(vertex.alias("vertex")).agg(
        F.max(F.when(~minus, F.col("component"))).alias("plus"), F.max(F.when(minus, F.col("component"))).alias("minus")
    )
    odd = F.col("plus") == F.col("minus")
    # The cover's label is the smallest of 2v and 2v+1 in it: half of it is the smallest vertex.
    side = F.when(~odd, F.col("plus").bitwiseAND(F.lit(1).cast("long")) == 0)
    smallest = F.least(F.shiftright("plus", 1), F.shiftright("minus", 1))
    return per.select("vertex", smallest.alias("component"), side.alias("side"), (~odd).alias("bipartite"))


def is_bipartite(edges: DataFrame) -> DataFrame:
    """One row: whether the whole graph is bipartite (an empty one is)."""
    return bipartite_sides(edges).agg(F.coalesce(F.bool_and("bipartite"), F.lit(True)).alias("bipartite"))
