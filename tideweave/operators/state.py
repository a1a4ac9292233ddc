"""Windowed graph state and its lookups.

At a fire time t the state holds the edges that became valid in [t - W, t), for
t in steps of the slide.  Layouts: ``EL`` keeps edges, ``sortedEL`` edges by
source, ``AL`` adjacency without repeats.  How state was fetched in older
designs (per edge, vertex or partition) is a physical matter that the optimizer
settles; those names are accepted and give the same rows.  Active and lazy
purging differ on streams only (:meth:`GraphState.purging`).

An algorithm runs coupled, over the live edges themselves, or decoupled: the
state is then a table of its own, and control rows, one per fire and partition,
make a downstream query read it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideweave.operators.metrics import running_total
from tideweave.operators.partitioning import owner
from tideweave.operators.triangles import triangle_count
from tideweave.plans.lineage import stash

LAYOUTS = ("EL", "sortedEL", "AL")
GRANULARITIES = ("edge", "vertex", "state")


#: Units of window sizes, in milliseconds.
UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def milliseconds(size: str) -> int:
    """A window size like ``3 days``."""
    number, unit = size.split()
    return int(number) * UNITS[unit.removesuffix("s")]


@dataclass(frozen=True)
class GraphState:
    """The live edges of every fire; ``slide`` of None is one fire over all."""

    edges: DataFrame
    size: str | None
    slide: str | None = None
    layout: str = "AL"
    parts: int = 4
    lazy_purge: bool = False
    granularity: str = "state"
    decoupled: bool = False

    def __post_init__(self) -> None:
        if self.layout not in LAYOUTS or self.granularity not in GRANULARITIES:
            raise ValueError(f"layout is one of {LAYOUTS}, granularity one of {GRANULARITIES}")

    def live(self) -> DataFrame:
        """``(fire, src, dst, edge_id, valid_from, partition_id)`` of live edges."""
        if self.size is None:
            fire = F.lit(None).cast("timestamp_ntz")
            rows = self.edges.withColumn("fire", fire)
        else:
            w = F.window("valid_from", self.size, self.slide or self.size)
            rows = self.edges.withColumn("w", w).withColumn("fire", F.col("w.end"))
        rows = rows.select("fire", "src", "dst", "edge_id", "valid_from", owner(F.col("src"), self.parts).alias("partition_id"))
        if self.layout != "AL":
            return rows
        last = F.max_by(F.struct("edge_id", "valid_from"), F.struct("valid_from", "edge_id")).alias("e")
        kept = rows.groupBy("fire", "partition_id", "src", "dst").agg(last)
        return kept.select("fire", "src", "dst", "e.edge_id", "e.valid_from", "partition_id")

    def state(self) -> DataFrame:
        """The layout itself: an edge, or a source's list of neighbours, per row."""
        live = self.live()
        if self.layout == "EL":
            return live
        nbrs = F.array_sort(F.collect_list("dst"))
        return live.groupBy("fire", "partition_id", "src").agg(nbrs.alias("nbrs"))

    def fires(self) -> DataFrame:
        """Control rows of decoupled algorithms: ``(partition_id, window_start, window_end)``."""
        return self._fires(self.live())

    def _fires(self, live: DataFrame) -> DataFrame:
        rows = live.groupBy("fire", "partition_id").agg(F.count("*").alias("n_edges"))
        start = F.lit(None).cast("timestamp_ntz") if self.size is None else F.expr(f"fire - interval {self.size}")
        return rows.select("partition_id", start.alias("window_start"), F.col("fire").alias("window_end"), "n_edges")

    def run(self, algorithm: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Run an algorithm over the live edges of all fires; the key is ``fire``."""
        if self.decoupled:
            raise ValueError("the state is decoupled: use run_decoupled")
        return algorithm(self.live())

    def decoupled_output(self) -> tuple[DataFrame, DataFrame]:
        """``(control rows, state table)``: what a downstream query needs."""
        if not self.decoupled:
            raise ValueError("the state is not decoupled: use run")
        table = stash(self.live(), "state")
        return self._fires(table), table

    def run_decoupled(self, algorithm: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Run an algorithm over the state that the control rows make it read."""
        fires, table = self.decoupled_output()
        asked = fires.select("partition_id", F.col("window_end").alias("fire"))
        same = (table["partition_id"] == asked["partition_id"]) & table["fire"].eqNullSafe(asked["fire"])
        return algorithm(table.join(asked, same, "left_semi"))

    def purging(self, edges: DataFrame) -> DataFrame:
        """Changes of this state over a watermarked stream of edges: added, removed, live.

        Edges leave at the end of their slide's window, each slide apart, or
        with ``lazy_purge`` all that have ended at the end of a window.
        """
        from tideweave.streaming.live_state import stream_adjacency

        size, slide = milliseconds(self.size), milliseconds(self.slide or self.size)
        return stream_adjacency(edges, size, slide, self.parts, lazy_slide_ms=size if self.lazy_purge else None)

    def size_per_partition(self) -> DataFrame:
        """``(fire, partition_id, n_entries)``."""
        return self.live().groupBy("fire", "partition_id").agg(F.count("*").alias("n_entries"))

    def triangles(self) -> DataFrame:
        """``(fire, triangles)``."""
        return triangle_count(self.live(), "fire")

    # ----------------------------------------------------------- lookups
    def partition(self, key: int) -> DataFrame:
        """One partition's state."""
        return self.state().where(F.col("partition_id") == key)

    def neighbours(self, vertices: DataFrame, between: Column | None = None) -> DataFrame:
        """``(src, nbrs)`` of the asked vertices over the live range.

        ``vertices`` has a column ``vertex``; its size decides how it is joined.
        """
        live = self.live() if between is None else self.live().where(between)
        asked = vertices.select(F.col("vertex").alias("src")).distinct()
        found = live.join(asked, "src", "left_semi")
        return found.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))

    def neighbours_with_total(self, vertices: DataFrame, between: Column | None = None) -> DataFrame:
        """:meth:`neighbours`, each row with ``n_live``, the number of live sources."""
        total = self.live_vertices(between).agg(F.count("*").alias("n_live")).withColumn("__k", F.lit(1))
        found = self.neighbours(vertices, between).withColumn("__k", F.lit(1))
        return found.join(total, "__k").drop("__k")  # the total is a single row

    def edge(self, pairs: DataFrame, between: Column | None = None) -> DataFrame:
        """The asked ``(src, dst)`` that are live edges; others have no row."""
        live = self.live() if between is None else self.live().where(between)
        return pairs.select("src", "dst").distinct().join(live.select("src", "dst"), ["src", "dst"], "left_semi")

    def live_vertices(self, between: Column | None = None) -> DataFrame:
        """Distinct live sources."""
        live = self.live() if between is None else self.live().where(between)
        return live.select("src").distinct()

    def contains(self, pairs: DataFrame, between: Column | None = None) -> DataFrame:
        """``pairs`` with ``present``: true, false if only the source is live, null if not even that."""
        live = self.live() if between is None else self.live().where(between)
        known = live.select(F.col("src").alias("s"), F.col("dst").alias("d")).distinct().withColumn("hit", F.lit(True))
        sources = live.select(F.col("src").alias("s0")).distinct()
        asked = pairs.select("src", "dst")
        met = asked.join(known, (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")), "left")
        met = met.join(sources, F.col("src") == F.col("s0"), "left")
        present = F.when(F.col("hit"), F.lit(True)).when(F.col("s0").isNotNull(), F.lit(False))
        return met.select("src", "dst", present.alias("present"))


def inserted_in_batches(edges: DataFrame, batch_size: int, parts: int) -> DataFrame:
    """Edges whose effective time is that of their batch's first edge.

    A batch is ``batch_size`` successive edges of one owner partition; the
    result's ``valid_from`` is the batch's, ``batch`` its number.
    """
    rows = edges.withColumn("partition_id", owner(F.col("src"), parts))
    rows = running_total(rows, F.lit(1), alias="__n", by=("partition_id",))
    rows = rows.withColumn("batch", F.floor((F.col("__n") - 1) / batch_size).cast("long")).drop("__n")
    first = rows.groupBy("partition_id", "batch").agg(F.min("valid_from").alias("valid_from"))
    return rows.drop("valid_from").join(first, ["partition_id", "batch"])
