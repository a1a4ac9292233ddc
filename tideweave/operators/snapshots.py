"""Per-vertex neighbourhoods on tumbling and hopping windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideweave.operators.transforms import endpoints


class Snapshot:
    """The edges of each vertex in each window; ``direction`` is out, in or all.

    Windows are half-open and aligned with the epoch.  Works on batch edges and
    on watermarked streams.
    """

    def __init__(self, edges: DataFrame, size: str, slide: str | None = None, direction: str = "out") -> None:
        self.rows = endpoints(edges, direction).withColumn("w", F.window("valid_from", size, slide or size))

    def _grouped(self, *aggregates: Column) -> DataFrame:
        done = self.rows.groupBy("w", "vertex").agg(*aggregates)
        rest = [c for c in done.columns if c != "w"]
        return done.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest)

    def reduce(self, reducer: Callable[[Column], Column] = F.sum, alias: str = "result") -> DataFrame:
        """An associative reduction of edge values by a built-in aggregate."""
        return self._grouped(reducer(F.col("value")).alias(alias))

    def reduce_pairs(self, fn: Callable[[Column, Column], Column], alias: str = "result") -> DataFrame:
        """Any associative, commutative reduction of two values to one, as an expression.

        A (window, vertex) group's values are gathered; where a built-in
        aggregate does the same, :meth:`reduce` combines before the shuffle.
        """
        values = F.array_compact(F.collect_list("value"))
        first, rest = F.get(values, 0), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
        return self._grouped(F.aggregate(rest, first, fn).alias(alias))

    def aggregate(self, *aggregates: Column) -> DataFrame:
        """Any aggregates over the edges of each vertex and window."""
        return self._grouped(*aggregates)

    def fold(
        self,
        initial: Column,
        step: Callable[[Column, Column, Column, Column], Column],
        alias: str = "result",
    ) -> DataFrame:
        """A fold in order of arrival: ``step(state, vertex, neighbour, value)``."""
        edges = F.array_sort(
            F.collect_list(F.struct("valid_from", "edge_id", "side", "vertex", "other", "value"))
        )
        folded = F.aggregate(edges, initial, lambda s, e: step(s, e["vertex"], e["other"], e["value"]))
        return self._grouped(folded.alias(alias))

    def apply(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
        """Any function from a vertex's edges in a window to rows.

        ``fn`` gets the columns window_start, vertex, other, value, valid_from
        and edge_id in order of arrival.
        """
        flat = self.rows.select(
            F.col("w.start").alias("window_start"), "vertex", "other", "value", "valid_from", "edge_id"
        )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: pd.DataFrame | None = None
            for rows in batches:
                rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
                if not len(rows):
                    continue
                cuts = _starts(rows)
                held = rows.iloc[cuts[-1] :]
                done = [fn(rows.iloc[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if done:
                    yield pd.concat(done, ignore_index=True)
            if held is not None and len(held):
                yield fn(held)

        # A group's rows are adjacent in a partition and in order of arrival.
        keys = ["window_start", "vertex"]
        ordered = flat.repartition(*keys).sortWithinPartitions(*keys, "valid_from", "edge_id", "other")
        return ordered.mapInPandas(run, schema)


def _starts(rows: pd.DataFrame) -> list[int]:
    """Where each (window, vertex) group of sorted rows starts."""
    window, vertex = rows["window_start"].to_numpy(), rows["vertex"].to_numpy()
    changed = (window[1:] != window[:-1]) | (vertex[1:] != vertex[:-1])
    return [0, *(np.flatnonzero(changed) + 1).tolist()]
