"""Edge-wise transforms: all but ``distinct_edges`` run without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideweave.model import ARRIVAL


def map_edges(edges: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An arbitrary edge-to-edge map given as a DataFrame function."""
    return fn(edges)


def map_rows(edges: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """A Python function from batches of edges to batches of rows (map, filter, flat map)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield fn(rows)

    return edges.mapInPandas(run, schema)


def map_values(edges: DataFrame, value: Column) -> DataFrame:
    """The edges with another value; its type may change."""
    return edges.withColumn("value", value)


def filter_vertices(edges: DataFrame, predicate: Callable[[Column], Column]) -> DataFrame:
    """Edges both of whose endpoints meet the predicate."""
    return edges.where(predicate(F.col("src")) & predicate(F.col("dst")))


def keep_vertices(edges: DataFrame, kept: DataFrame, vertex: str = "vertex") -> DataFrame:
    """Edges both of whose endpoints are rows of ``kept``: two semi-joins."""
    ids = kept.select(F.col(vertex).alias("__v"))
    return edges.join(ids, F.col("src") == F.col("__v"), "left_semi").join(
        ids, F.col("dst") == F.col("__v"), "left_semi"
    )


def reverse(edges: DataFrame) -> DataFrame:
    """Source and target swapped, all else kept."""
    swapped = {"src": F.col("dst").alias("src"), "dst": F.col("src").alias("dst")}
    return edges.select(*(swapped.get(c, F.col(c)) for c in edges.columns))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, in one pass; nothing is removed."""
    ends = F.array(
        F.struct(F.col("src").alias("s"), F.col("dst").alias("d")),
        F.struct(F.col("dst").alias("s"), F.col("src").alias("d")),
    )
    both = edges.withColumn("__e", F.explode(ends))
    return both.select(
        *(F.col("__e.s").alias(c) if c == "src" else F.col("__e.d").alias(c) if c == "dst" else F.col(c) for c in edges.columns)
    )


def endpoints(edges: DataFrame, direction: str = "all") -> DataFrame:
    """``(vertex, other, side)`` rows: sources (0), targets (1) or both of each edge."""
    out = F.struct(F.col("src").alias("vertex"), F.col("dst").alias("other"), F.lit(0).alias("side"))
    into = F.struct(F.col("dst").alias("vertex"), F.col("src").alias("other"), F.lit(1).alias("side"))
    ends = {"out": [out], "in": [into], "all": [out, into]}[direction]
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(*rest, F.explode(F.array(*ends)).alias("__v")).select("__v.*", *rest)


def distinct_edges(edges: DataFrame) -> DataFrame:
    """The first arrival of every (src, dst); on a stream within the watermark."""
    if edges.isStreaming:
        return edges.dropDuplicatesWithinWatermark(["src", "dst"])
    # An aggregate rather than a window: a pair's repeats are combined before the shuffle.
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    first = edges.groupBy("src", "dst").agg(F.min_by(F.struct(*rest), F.struct(*ARRIVAL)).alias("__e"))
    return first.select(*(F.col(f"__e.{c}") if c in rest else F.col(c) for c in edges.columns))


def simple_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """Distinct undirected edges ``(*keys, a, b)`` with a < b; loops are dropped."""
    return (
        edges.where("src <> dst")
        .select(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct()
    )
