"""Mergeable graph summaries: partial results per window, merged over time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def windowed_summary(edges: DataFrame, size: str, *aggregates: Column) -> DataFrame:
    """Built-in aggregates per tumbling window; Spark combines partial results."""
    w = F.window("valid_from", size)
    done = edges.groupBy(w.alias("w")).agg(*aggregates)
    return done.select(F.col("w.start").alias("window_start"), *(c for c in done.columns if c != "w"))


def cumulative_summary(per_window: DataFrame, merges: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Merge window results into running ones; there is one row per window."""
    order = Window.orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    rest = [c for c in per_window.columns if c not in merges]
    return per_window.select(*rest, *(merge(c).over(order).alias(c) for c, merge in merges.items()))


@dataclass(frozen=True)
class SummaryAggregation:
    """A summary given by Python functions on opaque states.

    ``update(state, edges)`` folds a batch of edges, ``combine(a, b)`` merges
    two states, ``transform(state)`` makes result rows.  States are folded per
    Spark partition and window first and travel pickled.  A window's partial
    states are merged in ``fan_in`` groups side by side, then those results.
    """

    initial: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    combine: Callable[[Any, Any], Any]
    transform: Callable[[Any], pd.DataFrame]
    schema: StructType | str
    fan_in: int = 32

    def run(self, edges: DataFrame, size: str) -> DataFrame:
        """Result rows per window, each with ``window_start``."""
        import pickle

        initial, update, combine, transform = self.initial, self.update, self.combine, self.transform
        fan_in = self.fan_in

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            states: dict[pd.Timestamp, Any] = {}
            for rows in batches:
                for start, part in rows.groupby("window_start", sort=False):
                    states[start] = update(states[start] if start in states else initial(), part)
            group = TaskContext.get().partitionId() % fan_in
            out = [(start, group, pickle.dumps(state)) for start, state in states.items()]
            yield pd.DataFrame(out, columns=["window_start", "group", "state"])

        def merged(group: pd.DataFrame) -> Any:
            state = initial()
            for blob in group["state"]:
                state = combine(state, pickle.loads(blob))
            return state

        def some(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"window_start": group["window_start"].iloc[:1], "state": [pickle.dumps(merged(group))]})

        def last(group: pd.DataFrame) -> pd.DataFrame:
            rows = transform(merged(group))
            rows.insert(0, "window_start", group["window_start"].iloc[0])
            return rows

        flat = edges.select(F.window("valid_from", size)["start"].alias("window_start"), "src", "dst", "value")
        states = flat.mapInPandas(partial, "window_start timestamp_ntz, group int, state binary")
        states = states.groupBy("window_start", "group").applyInPandas(some, "window_start timestamp_ntz, state binary")
        schema = self.schema if isinstance(self.schema, str) else self.schema.simpleString()[7:-1].replace(":", " ")
        return states.groupBy("window_start").applyInPandas(last, f"window_start timestamp_ntz, {schema}")
