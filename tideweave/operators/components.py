"""Weakly connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.plans.lineage import drop_stash, stash


def _rank(vertex: str, turn: int) -> Column:
    """A pseudo-random order of the vertices, another one each round."""
    return F.struct(F.xxhash64(F.col(vertex), F.lit(turn)).alias("h"), F.col(vertex).alias("v"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(vertex, component)`` for every endpoint; the label is the smallest id.

    Each round sends every vertex to the first of itself and its neighbours in
    a pseudo-random order and keeps the distinct edges between the images.
    Whatever the graph's shape, a round leaves at most three quarters of the
    vertices on average, so rounds grow with the logarithm of the vertices (an
    order by id would need as many rounds as a path is long).  The rounds' maps
    are then composed from the last to the first.  Edge tables and maps are
    tables in the shared folder; nothing but whether edges are left reaches the
    driver.  Edges with a null endpoint are ignored, a loop yields its vertex.
    """
    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b"))
    pairs = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    live = stash(
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges"
    )
    maps: list[DataFrame] = []
    while not live.isEmpty():
        turn = len(maps)
        both = live.unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_rank("b", turn)).alias("m"))
        hop = stash(first.select(F.col("a").alias("vertex"), F.least("m", _rank("a", turn))["v"].alias("up")), "cc-map")
        maps.append(hop)
        left, right = hop.toDF("a", "x"), hop.toDF("b", "y")
        moved = live.join(left, "a").join(right, "b").where("x <> y")
        nxt = stash(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
        drop_stash(live)
        live = nxt
    if not maps:
        return live.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    roots = maps[-1].toDF("vertex", "root")
    for hop in reversed(maps[:-1]):
        deeper = roots.toDF("up", "root")
        roots = hop.join(deeper, "up", "left").select("vertex", F.coalesce("root", "up").alias("root"))
    roots = stash(roots, "cc-roots")
    for table in (live, *maps):
        drop_stash(table)
    smallest = roots.groupBy("root").agg(F.min("vertex").alias("component"))
    return roots.join(smallest, "root").select("vertex", "component")
