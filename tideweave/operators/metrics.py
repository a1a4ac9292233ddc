"""Vertices, degrees, counts and neighbourhoods, final and running.

Running results have one row per arrival and need an order.  They are summed in
ranges of time first, so no task orders all rows, nor all rows of a hub
(:func:`running_total`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideweave.model import ARRIVAL
from tideweave.operators.transforms import endpoints
from tideweave.plans.lineage import stash


def vertices(edges: DataFrame) -> DataFrame:
    """``(vertex, valid_from)``: endpoints with their earliest edge."""
    return endpoints(edges).groupBy("vertex").agg(F.min("valid_from").alias("valid_from"))


def degrees(edges: DataFrame, direction: str = "all") -> DataFrame:
    """``(vertex, degree, valid_from)``; a loop counts twice in ``all``."""
    ends = endpoints(edges, direction)
    return ends.groupBy("vertex").agg(F.count("*").alias("degree"), F.min("valid_from").alias("valid_from"))


def running_degrees(edges: DataFrame, direction: str = "all") -> DataFrame:
    """A vertex's degree after each of its edges."""
    ends = endpoints(edges, direction).select("edge_id", "vertex", "side", "valid_from")
    done = running_total(ends, F.lit(1), (*ARRIVAL, "side"), "degree", by=("vertex",))
    return done.select("edge_id", "vertex", "side", "degree")


#: Rows of a key that one task orders at most.
TASK_ROWS = 1_000_000


def running_total(
    rows: DataFrame,
    amount: Column,
    order: tuple[str, ...] = ARRIVAL,
    alias: str = "total",
    by: tuple[str, ...] = (),
    grain: str = "hour",
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``rows`` with the sum of ``amount`` up to each in the order given, per ``by``.

    Keys of up to ``task_rows`` rows are windows of their own.  Rows of larger
    ones, or of the whole table, are summed per key and ``grain`` of time first;
    the running sum of the grains is one small row each, and within a grain a
    window orders only its own rows.  ``grain`` is what ``date_trunc`` takes:
    one whose rows fit a task.
    """
    if not by:
        return _by_grains(rows, amount, order, alias, by, grain)
    keys = [F.col(c).alias(f"__key_{c}") for c in by]
    sizes = rows.groupBy(*keys).count()
    own = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(amount.cast("long")).over(own)
    if (sizes.agg(F.max("count")).first()[0] or 0) <= task_rows:
        return rows.withColumn(alias, total)
    hubs = stash(sizes.where(F.col("count") > task_rows).drop("count"), "hubs")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__key_{c}"))
    light = rows.join(hubs, same, "left_anti").withColumn(alias, total)
    return light.unionByName(_by_grains(rows.join(hubs, same, "left_semi"), amount, order, alias, by, grain))


def _by_grains(
    rows: DataFrame, amount: Column, order: tuple[str, ...], alias: str, by: tuple[str, ...], grain: str
) -> DataFrame:
    at = F.date_trunc(grain, F.col(order[0])).cast("timestamp_ntz")
    part = rows.withColumns({"__h": F.coalesce(at, F.lit("0001-01-01").cast("timestamp_ntz")), "__x": amount.cast("long")})
    sums = part.groupBy(*by, "__h").agg(F.sum("__x").alias("__s"))
    before = Window.partitionBy(*by).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"__by_{c}") for c in by]
    base = sums.select(*keys, F.col("__h").alias("__k"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    within = Window.partitionBy(*by, "__h").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("__h") == F.col("__k")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    done = part.withColumn("__w", F.sum("__x").over(within)).join(base, same)
    return done.withColumn(alias, F.col("__w") + F.col("__b")).drop("__h", "__x", "__k", "__b", "__w", *(f"__by_{c}" for c in by))


def running_edge_count(edges: DataFrame) -> DataFrame:
    """``(edge_id, n_edges)``: edges seen up to and with each."""
    return running_total(edges, F.lit(1), alias="n_edges").select("edge_id", "n_edges")


def first_sightings(edges: DataFrame) -> DataFrame:
    """One row per vertex: its first edge."""
    first = endpoints(edges).groupBy("vertex").agg(F.min(F.struct(*ARRIVAL, "side")).alias("f"))
    return first.select("vertex", "f.side", "f.edge_id", "f.valid_from")


def running_vertex_count(edges: DataFrame) -> DataFrame:
    """``(edge_id, vertex, n_vertices)`` whenever the count of vertices changes."""
    seen = running_total(first_sightings(edges), F.lit(1), (*ARRIVAL, "side"), "n_vertices")
    return seen.select("edge_id", "vertex", "n_vertices")


def vertex_count(edges: DataFrame, approximate: bool = False) -> DataFrame:
    """The number of vertices, exact or by a HyperLogLog sketch."""
    ends = endpoints(edges)
    count = F.approx_count_distinct("vertex") if approximate else F.count_distinct("vertex")
    return ends.agg(count.alias("n_vertices"))


def vertex_aggregate(edges: DataFrame, *aggregates: Column, direction: str = "all") -> DataFrame:
    """Any aggregates over the edges of each vertex."""
    return endpoints(edges, direction).groupBy("vertex").agg(*aggregates)


def changes_only(rows: DataFrame, value: str, order: tuple[str, ...], grain: str = "hour") -> DataFrame:
    """Rows whose value differs from that of the row before.

    Rows are compared within a ``grain`` of time; its first row is compared
    with the last one of the grain before that has rows.
    """
    at = F.date_trunc(grain, F.col(order[0])).cast("timestamp_ntz")
    part = rows.withColumn("__d", at)
    key = F.struct(*order)
    ends = part.groupBy("__d").agg(F.max_by(value, key).alias("__last"))
    before = Window.orderBy("__d")
    ends = ends.select(F.col("__d").alias("__k"), F.lag("__last").over(before).alias("__last"), F.lag(F.lit(True)).over(before).alias("__has"))
    within = Window.partitionBy("__d").orderBy(*order)
    part = part.withColumns({"__p": F.lag(value).over(within), "__n": F.row_number().over(within)})
    part = part.join(ends, F.col("__d") == F.col("__k"))
    prior = F.when(F.col("__n") == 1, F.col("__last")).otherwise(F.col("__p"))
    first = (F.col("__n") == 1) & F.col("__has").isNull()
    return part.where(first | ~F.col(value).eqNullSafe(prior)).select(*rows.columns)


def neighborhoods(edges: DataFrame, direction: str = "out") -> DataFrame:
    """``(vertex, nbrs)``: sorted distinct neighbours."""
    ends = endpoints(edges, direction)
    return ends.groupBy("vertex").agg(F.array_sort(F.collect_set("other")).alias("nbrs"))


def running_neighborhoods(edges: DataFrame) -> DataFrame:
    """For each edge the sorted neighbours of its source so far."""
    w = Window.partitionBy("src").orderBy(*ARRIVAL).rowsBetween(Window.unboundedPreceding, 0)
    return edges.select("edge_id", "src", "dst", F.array_sort(F.collect_set("dst").over(w)).alias("nbrs"))
