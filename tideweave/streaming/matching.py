"""Greedy weighted matching of a stream, its matched edges kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideweave.operators.sequential import Matching

OUT = "key int, seq long, op string, src long, dst long, weight long"


class HeldEdges(dict):
    """Matched edges by vertex, read from state when first asked for."""

    def __init__(self, state) -> None:
        super().__init__()
        self.state, self.read = state, {}

    def __contains__(self, vertex: int) -> bool:
        if vertex not in self.read:
            held = tuple(self.state.getValue((vertex,))) if self.state.containsKey((vertex,)) else None
            self.read[vertex] = held
            if held is not None:
                self[vertex] = held
        return dict.__contains__(self, vertex)

    def write(self) -> None:
        """Bring the changes into state; every vertex touched has been read."""
        for vertex in {*self.read, *self}:
            new = self.get(vertex)
            if new is None:
                if self.read[vertex] is not None:
                    self.state.removeKey((vertex,))
            elif self.read.get(vertex) != new:
                self.state.updateValue((int(vertex),), tuple(int(x) for x in new))


class MatchingState(StatefulProcessor):
    """Edges of a micro-batch are taken in order of arrival; only their vertices' state is read."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edges = handle.getMapState("edges", "vertex long", "src long, dst long, weight long")
        self.seq = handle.getValueState("seq", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows)).sort_values(["valid_from", "edge_id"], kind="stable")
        matching, n = Matching(), self.seq.get()[0] if self.seq.exists() else 0
        matching.edge = HeldEdges(self.edges)
        out = []
        for r in batch.itertuples(index=False):
            for event in matching.add(int(r.src), int(r.dst), int(r.weight)):
                out.append((key[0], n, *event))
                n += 1
        matching.edge.write()
        self.seq.update((n,))
        yield pd.DataFrame(out, columns=["key", "seq", "op", "src", "dst", "weight"])

    def close(self) -> None:
        pass


def stream_matching(edges: DataFrame, weight: Column) -> DataFrame:
    """Matching events of an edge stream; needs the RocksDB state store."""
    rows = edges.select(
        F.lit(0).alias("key"), "edge_id", "src", "dst", "valid_from", weight.cast("long").alias("weight")
    )
    return rows.where("weight is not null").groupBy("key").transformWithStateInPandas(
        statefulProcessor=MatchingState(), outputStructType=OUT, outputMode="Append", timeMode="None"
    )
