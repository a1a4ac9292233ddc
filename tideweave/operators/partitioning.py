"""Edge partitioning by degree, ownership, and partition quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.operators.metrics import degrees


def owner(vertex: Column, parts: int) -> Column:
    """The partition that owns a vertex."""
    return F.pmod(vertex, F.lit(parts)).cast("int")


def dbh_partition(edges: DataFrame, parts: int) -> DataFrame:
    """Edges with ``partition_id``: that of the endpoint of lower degree.

    Ties go to the smaller id.  The vertex hash is a multiplicative one that
    any SQL engine can compute.
    """
    degree = degrees(edges).select("vertex", "degree")
    left, right = degree.toDF("src", "ds"), degree.toDF("dst", "dd")
    placed = edges.join(left, "src").join(right, "dst")
    low = F.when(
        (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") <= F.col("dst"))), F.col("src")
    ).otherwise(F.col("dst"))
    shard = F.pmod(low * 2654435761 % 4294967296, F.lit(parts)).cast("int")
    return placed.select(*edges.columns, shard.alias("partition_id"))


def by_vertex(edges: DataFrame, placement: DataFrame) -> DataFrame:
    """Edges with the partition of their source; ``placement`` is ``(vertex, partition_id)``."""
    return edges.join(placement.withColumnRenamed("vertex", "src"), "src").select(*edges.columns, "partition_id")


def partition_quality(placed: DataFrame) -> DataFrame:
    """``(edges, vertices, max_load, min_load, replication)`` of placed edges.

    ``replication`` is the mean number of partitions that hold a vertex.
    """
    loads = placed.groupBy("partition_id").agg(F.count("*").alias("n"))
    loads = loads.agg(F.sum("n").alias("edges"), F.max("n").alias("max_load"), F.min("n").alias("min_load"))
    held = placed.select("partition_id", F.explode(F.array("src", "dst")).alias("vertex")).distinct()
    copies = held.groupBy("vertex").agg(F.count("*").alias("c"))
    copies = copies.agg(F.count("*").alias("vertices"), F.sum("c").alias("copies"))
    both = loads.withColumn("k", F.lit(1)).join(copies.withColumn("k", F.lit(1)), "k")
    return both.select(
        "edges", "vertices", "max_load", "min_load", F.round(F.col("copies") / F.col("vertices"), 6).alias("replication")
    )
