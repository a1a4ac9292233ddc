"""The temporal property graph: one DataFrame of edges, batch or streaming.

Vertices are always derived from edges.  Time is event time; an open end of an
edge's validity is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an edge and their types.
EDGE_COLUMNS = {
    "edge_id": "bigint",
    "label": "string",
    "src": "bigint",
    "dst": "bigint",
    "value": "double",
    "valid_from": "timestamp_ntz",
    "valid_to": "timestamp_ntz",
}
#: What a running result is ordered by.
ARRIVAL = ("valid_from", "edge_id")


def edges_of(df: DataFrame) -> DataFrame:
    """``df`` with the edge columns first, missing ones null, others kept."""
    have = set(df.columns)
    own = [
        (F.col(c) if c in have else F.lit(None).cast(kind)).alias(c) for c, kind in EDGE_COLUMNS.items()
    ]
    return df.select(*own, *(c for c in df.columns if c not in EDGE_COLUMNS))


@dataclass(frozen=True)
class TemporalGraph:
    """A fluent view of the operators over an edge DataFrame."""

    edges: DataFrame

    def _with(self, edges: DataFrame) -> TemporalGraph:
        return TemporalGraph(edges)

    def map_edges(self, fn: Callable[[DataFrame], DataFrame]) -> TemporalGraph:
        from tideweave.operators.transforms import map_edges

        return self._with(map_edges(self.edges, fn))

    def filter_edges(self, condition: Column | str) -> TemporalGraph:
        return self._with(self.edges.where(condition))

    def filter_vertices(self, predicate: Callable[[Column], Column]) -> TemporalGraph:
        from tideweave.operators.transforms import filter_vertices

        return self._with(filter_vertices(self.edges, predicate))

    def reverse(self) -> TemporalGraph:
        from tideweave.operators.transforms import reverse

        return self._with(reverse(self.edges))

    def undirected(self) -> TemporalGraph:
        from tideweave.operators.transforms import undirected

        return self._with(undirected(self.edges))

    def union(self, other: TemporalGraph) -> TemporalGraph:
        return self._with(self.edges.unionByName(other.edges, allowMissingColumns=True))

    def distinct(self) -> TemporalGraph:
        from tideweave.operators.transforms import distinct_edges

        return self._with(distinct_edges(self.edges))

    def vertices(self) -> DataFrame:
        from tideweave.operators.metrics import vertices

        return vertices(self.edges)

    def degrees(self, direction: str = "all") -> DataFrame:
        from tideweave.operators.metrics import degrees

        return degrees(self.edges, direction)

    def running_degrees(self, direction: str = "all") -> DataFrame:
        from tideweave.operators.metrics import running_degrees

        return running_degrees(self.edges, direction)

    def slice(self, size: str, slide: str | None = None, direction: str = "out"):
        from tideweave.operators.snapshots import Snapshot

        return Snapshot(self.edges, size, slide, direction)

    def state(self, size: str, slide: str, layout: str = "AL"):
        from tideweave.operators.state import GraphState

        return GraphState(self.edges, size, slide, layout)
