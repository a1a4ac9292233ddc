"""Driving streams over files to their end, and reading state back."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.plans.lineage import made_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that operators with several state variables need."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_table(
    stream: DataFrame, mode: str = "append", name: str = "stream", throttled: bool = False
) -> tuple[DataFrame, str]:
    """Run what is available; returns the result table and the checkpoint's path.

    Append results go to Parquet, update and complete ones are kept per batch
    with the column ``batch_id``.  A source that is ``throttled`` by itself
    tells no more than the end of its next batch, where the available-now
    trigger would stop; it is run until it has nothing new.
    """
    spark = stream.sparkSession
    root = made_path(spark, name)
    out, checkpoint = f"{root}/out", f"{root}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer if throttled else writer.trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
        schema = stream.schema
    else:

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.selectExpr("*", f"{batch_id}L as batch_id").write.mode("append").parquet(out)

        query = writer.foreachBatch(keep).start()
        schema = stream.schema.add("batch_id", "long")
    try:
        query.processAllAvailable() if throttled else query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(schema).parquet(out), checkpoint


def run_until(stream: DataFrame, enough: Callable[[DataFrame], bool], name: str = "clock", seconds: float = 120.0) -> DataFrame:
    """Run by the clock until the rows so far are ``enough``; returns them.

    For processing-time operators, which have no end of their own: timers go on
    after the last input.  Stops with an error after ``seconds``.
    """
    spark = stream.sparkSession
    root = made_path(spark, name)
    out, checkpoint = f"{root}/out", f"{root}/checkpoint"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("append").parquet(out)

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    query = writer.foreachBatch(keep).trigger(processingTime="1 second").start()
    rows = spark.read.schema(stream.schema)
    until = time.monotonic() + seconds
    try:
        while query.lastProgress is None or not enough(rows.parquet(out)):
            if query.exception() is not None or time.monotonic() > until:
                raise TimeoutError(f"{name} has not come to its end: {query.exception()}")
            time.sleep(1)
    finally:
        query.stop()
    return rows.parquet(out)


def read_state(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    """A stopped or running stream's state as a table.

    A map whose values are arrays side by side (blocks of edges) has a row per
    element.
    """
    reader = spark.read.format("statestore")
    state = (reader.option("stateVarName", variable) if variable else reader).load(checkpoint)
    value = dict(zip(state.columns, state.schema, strict=True)).get("user_map_value")
    fields = value.dataType.names if value is not None else []
    if len(fields) < 2 or any(f.dataType.typeName() != "array" for f in value.dataType):
        return state
    zipped = F.explode(F.arrays_zip(*(F.col(f"user_map_value.{f}").alias(f) for f in fields)))
    return state.withColumn("user_map_value", zipped)
