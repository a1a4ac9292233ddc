"""Reading edges: text formats, the driver's event tables, generated graphs.

Every source yields the temporal edge columns of :mod:`tideweave.model`; a
column that the input lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideweave.model import edges_of

BIPARTITE_OFFSET = 1_000_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))


def edge_list(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """Text lines ``src<sep>dst...``; blank lines and ``#`` comments are skipped."""
    parts = F.split(F.trim("value"), sep)
    return edges_of(_lines(spark, path).select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst")))


def numbered_edges(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """:func:`edge_list` with the edge's number as id, and as time in ms.

    Lines are numbered in the order of files and lines without a sort: a line's
    place in its block of a file, plus the number of lines in the blocks
    before, of which there is one row each.
    """
    parts = F.split(F.trim("value"), sep)
    block = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at")).alias("p")
    lines = spark.read.text(path).select("value", block)
    lines = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    rows = lines.select(
        "p", F.monotonically_increasing_id().alias("m"), parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst")
    )
    sizes = rows.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("low"))
    before = F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("p", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"))
    rows = rows.join(starts, "p").select((F.col("m") + F.col("shift")).alias("edge_id"), "src", "dst")
    return edges_of(rows.withColumn("valid_from", F.timestamp_millis("edge_id").cast("timestamp_ntz")))


def weighted_edge_list(spark: SparkSession, path: str, sep: str = r"\s+") -> DataFrame:
    """Lines ``src dst weight time``: weight as value, time as year or epoch seconds."""
    parts = F.split(F.trim("value"), sep)
    fields = _lines(spark, path).select(
        parts[0].cast("long").alias("src"),
        parts[1].cast("long").alias("dst"),
        F.get(parts, 2).cast("double").alias("value"),
        F.get(parts, 3).cast("long").alias("t"),
    )
    year = F.make_timestamp_ntz(F.col("t").cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    when = F.when(F.col("t") < 10_000, year).otherwise(F.timestamp_seconds("t").cast("timestamp_ntz"))
    return edges_of(fields.withColumn("valid_from", when).drop("t"))


def adjacency_list(spark: SparkSession, path: str) -> DataFrame:
    """``(src, nbrs)`` from lines ``src:[n1, n2, ...]``."""
    parts = F.split("value", ":", 2)
    return _lines(spark, path).select(
        F.trim(parts[0]).cast("long").alias("src"), F.from_json(parts[1], "array<bigint>").alias("nbrs")
    )


def explode_adjacency(adjacency: DataFrame) -> DataFrame:
    """Edges from adjacency rows."""
    return edges_of(adjacency.select("src", F.explode("nbrs").alias("dst")))


def bipartite_csv(spark: SparkSession, path: str, sep: str = "\t", offset: int = BIPARTITE_OFFSET) -> DataFrame:
    """``user, item, rating, epoch seconds``; items are moved by ``offset``."""
    raw = spark.read.csv(path, sep=sep, schema="user long, item long, rating double, t long")
    return edges_of(
        raw.select(
            F.col("user").alias("src"),
            (F.col("item") + offset).alias("dst"),
            (F.col("rating") * 10).alias("value"),
            F.timestamp_seconds("t").cast("timestamp_ntz").alias("valid_from"),
        )
    )


def sequence_edges(spark: SparkSession, n: int, steps: tuple[int, ...] = (1, 2), every_ms: int = 100) -> DataFrame:
    """For i = 1..n an edge to i + s for each step s; later steps come later."""
    shifts = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(k).alias("k")) for k, s in enumerate(steps)))
    rows = spark.range(1, n + 1).select(F.col("id").alias("src"), F.explode(shifts).alias("x"))
    ms = F.col("src") * every_ms + F.col("x.k") * (every_ms // max(1, len(steps)))
    return edges_of(
        rows.select(
            "src", (F.col("src") + F.col("x.s")).alias("dst"), F.timestamp_millis(ms).cast("timestamp_ntz").alias("valid_from")
        )
    )


def _event_columns(events: DataFrame) -> list[Column]:
    return [
        F.col("event_id").alias("edge_id"),
        F.col("event_type").alias("label"),
        F.col("user_id").alias("src"),
        F.get_json_object("props", "$.k").cast("long").alias("dst"),
        F.col("value"),
        F.col("ts").alias("valid_from"),
    ]


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users linked with the item of each event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return edges_of(events.select(*_event_columns(events)))


def stream_event_edges(spark: SparkSession, path: str, delay: str = "1 day", files_per_trigger: int | None = None) -> DataFrame:
    """:func:`event_edges` as a stream over a folder or file, watermarked on ``valid_from``."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # A stream reads folders: take the file's, and only this file of it.
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    events = reader.parquet(path)
    edges = edges_of(events.select(*_event_columns(events)))
    return edges.withColumn("valid_from", F.col("valid_from").cast("timestamp")).withWatermark("valid_from", delay)


def ingested(edges: DataFrame) -> DataFrame:
    """Edges whose time is that of their ingestion, for batches and streams alike.

    All edges of a batch or micro-batch have the same time; their order within
    it is that of their ids.
    """
    return edges.withColumn("valid_from", F.current_timestamp().cast(edges.schema["valid_from"].dataType))


def part_supplier_edges(spark: SparkSession, sf_dir: str, offset: int = BIPARTITE_OFFSET) -> DataFrame:
    """Parts linked with suppliers of their line items: bipartite by construction."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return edges_of(
        items.select(
            F.col("l_partkey").alias("src"),
            (F.col("l_suppkey") + offset).alias("dst"),
            F.col("l_quantity").alias("value"),
            F.col("l_shipdate").alias("valid_from"),
        )
    )
