"""Writing graphs: adjacency text files, edge files, and the EL to AL converter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.functions.ids import as_text
from tideweave.operators.metrics import neighborhoods
from tideweave.operators.transforms import undirected
from tideweave.sources.edges import edge_list


def adjacency_rows(edges: DataFrame, make_undirected: bool = False) -> DataFrame:
    """``(src, nbrs)``: distinct neighbours, of both directions if asked."""
    return neighborhoods(undirected(edges) if make_undirected else edges).withColumnRenamed("vertex", "src")


def write_adjacency(adjacency: DataFrame, path: str) -> None:
    """Lines ``src:[n1, n2, ...]``."""
    nbrs = F.regexp_replace(as_text(F.col("nbrs")), ",", ", ")
    line = F.concat(F.col("src").cast("string"), F.lit(":["), nbrs, F.lit("]"))
    adjacency.select(line.alias("value")).write.text(path)


def write_edges(edges: DataFrame, path: str, sep: str = ",") -> None:
    """Lines ``src<sep>dst``."""
    edges.select("src", "dst").write.option("sep", sep).csv(path)


def el_to_al(spark: SparkSession, source: str, target: str, make_undirected: bool = False) -> None:
    """Convert an edge-list file to an adjacency file."""
    write_adjacency(adjacency_rows(edge_list(spark, source), make_undirected), target)
