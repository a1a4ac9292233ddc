"""Connected components of a stream, kept in a table and merged batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideweave.operators.components import connected_components
from tideweave.plans.lineage import drop_stash, made_path, stash


class StreamingComponents:
    """A merger for ``foreachBatch``: labels so far and a batch's edges make new labels.

    Old labels are themselves edges (vertex, component), so a batch costs the
    labels and its own edges, not the edges seen before.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.labels: DataFrame | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        pairs = batch.select("src", "dst")
        if self.labels is not None:
            pairs = pairs.unionAll(self.labels.toDF("src", "dst"))
        new = stash(connected_components(pairs), f"stream-cc-{batch_id}")
        if self.labels is not None:
            drop_stash(self.labels)
        self.labels = new

    def run(self, edges: DataFrame) -> DataFrame:
        """All available edges of the stream; ``(vertex, component)``."""
        checkpoint = made_path(self.spark, "cc")
        query = edges.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return self.labels
