"""Exact and estimated triangle counts.

Edges are made simple and oriented from the endpoint of lower degree to that of
higher degree (ties by id), so a hub has few outgoing edges and the wedges of
two outgoing edges stay near m^1.5 whatever the skew.  The closing edge is found
by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.model import ARRIVAL
from tideweave.operators.metrics import running_total
from tideweave.operators.transforms import endpoints, simple_edges


def oriented(simple: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, lo, hi)``: each simple edge once, from lower to higher degree."""
    ends = simple.select(*keys, F.explode(F.array("a", "b")).alias("v"))
    degree = ends.groupBy(*keys, "v").agg(F.count("*").alias("d"))
    left = degree.toDF(*keys, "a", "da")
    right = degree.toDF(*keys, "b", "db")
    both = simple.join(left, [*keys, "a"]).join(right, [*keys, "b"])
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return both.select(
        *keys, F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi")
    )


def triangles(edges: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, a, b, c)`` with a < b < c, every triangle once per key.

    Keys may have any names but those of the result and of ``oriented``.
    """
    e = oriented(simple_edges(edges, *keys), *keys)
    one, two = e.toDF(*keys, "__u", "__v"), e.toDF(*keys, "__u", "__w")
    wedges = one.join(two, [*keys, "__u"]).where("__v < __w")
    ends = e.select(*keys, F.least("lo", "hi").alias("__v"), F.greatest("lo", "hi").alias("__w"))
    closed = wedges.join(ends, [*keys, "__v", "__w"])
    corners = F.array_sort(F.array("__u", "__v", "__w"))
    return closed.select(*keys, *(corners[i].alias(n) for i, n in enumerate(("a", "b", "c"))))


def triangle_count(edges: DataFrame, *keys: str, alias: str = "triangles") -> DataFrame:
    """The number of triangles, per key if keys are given."""
    found = triangles(edges, *keys)
    return (found.groupBy(*keys) if keys else found.groupBy()).agg(F.count("*").alias(alias))


def triangles_per_vertex(edges: DataFrame, total_vertex: int | None = -1) -> DataFrame:
    """``(vertex, triangles)``; the vertex ``total_vertex`` carries the total."""
    corners = [F.col(c) for c in ("a", "b", "c")]
    total = [] if total_vertex is None else [F.lit(total_vertex).cast("long")]
    rows = triangles(edges).select(F.explode(F.array(*corners, *total)).alias("vertex"))
    return rows.groupBy("vertex").agg(F.count("*").alias("triangles"))


def completed_triangles(edges: DataFrame) -> DataFrame:
    """``(a, b, c, valid_from, edge_id)``: triangles with the arrival that completes them.

    An edge arrives with its first repeat in either direction.
    """
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    first = edges.where("src <> dst").groupBy(*pair).agg(F.min(F.struct(*ARRIVAL)).alias("at"))
    out = triangles(first.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    for x, y in ("ab", "bc", "ac"):
        out = out.join(first.toDF(x, y, f"at_{x}{y}"), [x, y])
    last = F.greatest("at_ab", "at_bc", "at_ac").alias("at")
    return out.select("a", "b", "c", last).select("a", "b", "c", "at.valid_from", "at.edge_id")


def running_triangles(edges: DataFrame, total_vertex: int = -1) -> DataFrame:
    """``(vertex, edge_id, triangles)``: the running counters of vertices and of all.

    A row whenever an arrival completes triangles of the vertex; the vertex
    ``total_vertex`` counts all triangles.
    """
    corners = F.array(*(F.col(c) for c in ("a", "b", "c")), F.lit(total_vertex).cast("long"))
    rows = completed_triangles(edges).select(F.explode(corners).alias("vertex"), *ARRIVAL)
    made = rows.groupBy("vertex", *ARRIVAL).agg(F.count("*").alias("n"))
    done = running_total(made, F.col("n"), alias="triangles", by=("vertex",))
    return done.select("vertex", "edge_id", "triangles")


def triangles_per_partition(edges: DataFrame, owner: Column, alias: str = "partition_id") -> DataFrame:
    """Triangles by the owner of their smallest vertex; they add up to the total.

    ``owner`` is an expression over the column ``vertex``.
    """
    smallest = triangles(edges).select(F.col("a").alias("vertex"))
    return smallest.groupBy(owner.alias(alias)).agg(F.count("*").alias("triangles"))


def triangles_per_edge(edges: DataFrame) -> DataFrame:
    """``(lo, hi, t)``: the triangles on each simple edge that has any."""
    sides = F.array(*(F.struct(F.col(x).alias("lo"), F.col(y).alias("hi")) for x, y in ("ab", "ac", "bc")))
    per_edge = triangles(edges).select(F.explode(sides).alias("e")).groupBy("e.lo", "e.hi")
    return per_edge.agg(F.count("*").alias("t"))


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """``(src, dst, shared)``: how many neighbours the ends of each distinct edge share.

    Counted from the triangles on the edge, so a hub's neighbours are never
    moved to each of its edges.  A loop makes a vertex its own neighbour: it
    adds one for either end that has one, and on the loop itself all
    neighbours are shared.
    """
    pairs = edges.select("src", "dst").distinct()
    pairs = pairs.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})
    ends = endpoints(pairs.select("src", "dst")).where("other is not null")
    near = ends.join(pairs.where("src = dst").select(F.col("src").alias("vertex")), "vertex", "left_semi")
    near = near.groupBy("vertex").agg(F.count_distinct("other").alias("d"))
    rows = pairs.join(triangles_per_edge(pairs), ["lo", "hi"], "left")
    rows = rows.join(near.toDF("src", "ds"), "src", "left").join(near.toDF("dst", "dd"), "dst", "left")
    loops = F.col("ds").isNotNull().cast("long") + F.col("dd").isNotNull().cast("long")
    apart = F.when(F.col("src") != F.col("dst"), F.coalesce("t", F.lit(0)) + loops).otherwise(F.lit(0))
    return rows.select("src", "dst", F.when(F.col("src") == F.col("dst"), F.col("ds")).otherwise(apart).alias("shared"))


def closing_probability(shared: Column, du: Column, dv: Column) -> Column:
    """What one sampled edge contributes: ``|N(u) & N(v)| d(u) d(v) / (3 (d(u) + d(v)))``."""
    return shared * du * dv / (3.0 * (du + dv))


def sampled_edges(edges: DataFrame, keep_loops: bool = False) -> DataFrame:
    """``(u, v, du, dv, lam)`` for every directed edge of the symmetric graph.

    Shared neighbours are counted from the triangles on each edge, so wedges
    of hubs are never enumerated.  A loop makes a vertex its own neighbour: it
    adds one for either endpoint that has one.
    """
    there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = edges.select(F.explode(F.array(there, back)).alias("e"))
    adj = both.select(F.col("e.src").alias("u"), F.col("e.dst").alias("v")).distinct()
    adj = adj if keep_loops else adj.where("u <> v")
    degree = adj.groupBy("u").agg(
        F.count("*").cast("double").alias("du"), F.max((F.col("u") == F.col("v")).cast("double")).alias("lu")
    )
    per_edge = triangles_per_edge(edges).withColumn("t", F.col("t").cast("double"))
    rows = adj.withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")}).join(per_edge, ["lo", "hi"], "left")
    rows = rows.join(degree, "u").join(degree.toDF("v", "dv", "lv"), "v")
    shared = F.when(F.col("u") == F.col("v"), F.col("du")).otherwise(
        F.coalesce("t", F.lit(0.0)) + F.col("lu") + F.col("lv")
    )
    return rows.select("u", "v", "du", "dv", closing_probability(shared, F.col("du"), F.col("dv")).alias("lam"))


def estimate_expectation(edges: DataFrame, keep_loops: bool = False) -> DataFrame:
    """The estimator's expectation in closed form; exact on loop-free graphs."""
    rows = sampled_edges(edges, keep_loops)
    return rows.agg(F.round(F.sum(F.col("lam") / F.col("du")), 6).alias("triangles"))


def any_engine_hash(value: Column, seed: int) -> Column:
    """A multiplicative hash of a small non-negative id, in 32 bits; any SQL engine can compute it."""
    return (value + seed) * F.lit(2654435761) % F.lit(4294967296)


def estimate_sampled(edges: DataFrame, fraction: float = 0.1, seed: int = 7) -> DataFrame:
    """The estimate from a seeded sample of vertices and one neighbour each."""
    rows = sampled_edges(edges)
    pick = any_engine_hash(F.col("u"), seed) < int(fraction * 4294967296)
    order = F.struct(any_engine_hash(F.col("u") * 31 + F.col("v"), seed), F.col("v"))
    one = rows.where(pick).groupBy("u").agg(F.min_by("lam", order).alias("lam"))
    n = rows.select("u").distinct().agg(F.count("*").alias("n"))
    # Both sides are a single row.
    both = one.agg(F.avg("lam").alias("m"), F.count("*").alias("samples"), F.lit(1).alias("k")).join(
        n.withColumn("k", F.lit(1)), "k"
    )
    return both.select(F.round(F.coalesce(F.col("m") * F.col("n"), F.lit(0.0)), 6).alias("triangles"), "samples")
