"""Adjacency state of a stream, with edges leaving when their window ends.

State is kept per owner partition and slice of its sources.  A call to the state
store costs far more than an edge, so edges lie in blocks by a hash of (src,
dst), each a value of a map: arrays of sources, targets and ends of windows.
For each end the blocks that have edges leaving then are kept, so a purge reads
those alone.  Purging is active (a timer per time bucket) or lazy (a timer per
slide purges all buckets that have ended); the live edges at a slide are the
same.  Time is the edges' own, or the clock's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideweave.operators.partitioning import owner

OUT = "partition_id int, slice int, at timestamp, added long, removed long, live long"
SLICES = 16
#: Blocks of a slice's edges; what enters or leaves rewrites its block, so larger states want more slices.
BLOCKS = 256
Arrays = tuple[np.ndarray, np.ndarray, np.ndarray]


def _blocks(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The block of each edge."""
    mixed = (src.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ dst.view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(40)) % np.uint64(BLOCKS)).astype(np.int64)


def _latest(src: np.ndarray, dst: np.ndarray, end: np.ndarray) -> Arrays:
    """Each edge once, in order, with its last end."""
    order = np.lexsort((end, dst, src))
    src, dst, end = src[order], dst[order], end[order]
    last = np.append((src[1:] != src[:-1]) | (dst[1:] != dst[:-1]), True)[: len(src)]
    return src[last], dst[last], end[last]


class AdjacencyState(StatefulProcessor):
    """Adds edges, purges buckets at their end, reports sizes."""

    def __init__(self, window_ms: int, bucket_ms: int, slide_ms: int | None = None, clock: bool = False) -> None:
        self.window_ms, self.bucket_ms, self.slide_ms, self.clock = window_ms, bucket_ms, slide_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edges = handle.getMapState("edges", "block int", "src array<bigint>, dst array<bigint>, valid_to array<bigint>")
        self.leaving = handle.getMapState("leaving", "at long", "blocks array<int>")
        self.size = handle.getValueState("size", "live long")

    def _live(self) -> int:
        return self.size.get()[0] if self.size.exists() else 0

    def _timer(self, end: int) -> int:
        return end if self.slide_ms is None else -(-end // self.slide_ms) * self.slide_ms

    def _row(self, key, ms: int, added: int, removed: int, live: int) -> pd.DataFrame:
        row = (key[0], key[1], pd.Timestamp(ms, unit="ms"), added, removed, live)
        return pd.DataFrame([row], columns=["partition_id", "slice", "at", "added", "removed", "live"])

    def _held(self, block: int) -> Arrays:
        found = self.edges.getValue((block,)) or ([], [], [])
        return tuple(np.array(v, dtype=np.int64) for v in found)

    def _hold(self, block: int, edges: Arrays) -> None:
        if len(edges[0]):
            self.edges.updateValue((block,), tuple(v.tolist() for v in edges))
        else:
            self.edges.removeKey((block,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        added, last = 0, 0
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock else None
        parts = [(np.empty(0, np.int64),) * 3]
        for part in rows:
            src, dst = (part[c].astype("int64").to_numpy() for c in ("src", "dst"))
            ms = part["ms"].astype("int64").to_numpy() if now is None else np.full(len(src), now, dtype=np.int64)
            last = max(last, int(ms.max(initial=0)))
            end = (ms // self.bucket_ms + 1) * self.bucket_ms + self.window_ms
            parts.append(_latest(src, dst, end))
        new = _latest(*(np.concatenate(v) for v in zip(*parts, strict=True)))
        block = _blocks(new[0], new[1])
        order = np.argsort(block, kind="stable")
        block, new = block[order], tuple(v[order] for v in new)
        cuts = np.concatenate([np.flatnonzero(np.diff(block, prepend=-1)), [len(block)]])
        leaving: dict[int, set[int]] = {}
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k = int(block[lo])
            held = self._held(k)
            both = _latest(*(np.concatenate([h, v[lo:hi]]) for h, v in zip(held, new, strict=True)))
            added += len(both[0]) - len(held[0])
            self._hold(k, both)
            for end in np.unique(new[2][lo:hi]).tolist():
                leaving.setdefault(end, set()).add(k)
        for end, more in leaving.items():
            known = self.leaving.getValue((end,))
            self.leaving.updateValue((end,), (sorted(more.union(known[0] if known else ())),))
            self.handle.registerTimer(self._timer(end))
        live = self._live() + added
        self.size.update((live,))
        yield self._row(key, last, added, 0, live)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = expiredTimerInfo.getExpiryTimeInMs()
        removed = 0
        ended = [(k[0], v[0]) for k, v in self.leaving.iterator() if k[0] <= now]
        for block in sorted({b for _, blocks in ended for b in blocks}):
            held = self._held(block)
            # An edge that came again leaves later.
            stay = held[2] > now
            removed += len(stay) - int(stay.sum())
            self._hold(block, tuple(v[stay] for v in held))
        for end, _ in ended:
            self.leaving.removeKey((end,))
        live = self._live() - removed
        self.size.update((live,))
        yield self._row(key, now, 0, removed, live)

    def close(self) -> None:
        pass


def stream_adjacency(
    edges: DataFrame,
    window_ms: int,
    bucket_ms: int,
    parts: int = 4,
    slices: int = SLICES,
    lazy_slide_ms: int | None = None,
    clock: bool = False,
) -> DataFrame:
    """State changes of a watermarked edge stream; needs the RocksDB state store.

    ``lazy_slide_ms`` purges once per slide; ``clock`` takes the processing
    time instead of the edges' own, then no watermark is needed.
    """
    rows = edges.select(
        owner(F.col("src"), parts).alias("partition_id"),
        F.pmod(F.xxhash64("src"), F.lit(slices)).cast("int").alias("slice"),
        "src",
        "dst",
        "valid_from",
        F.unix_millis("valid_from").alias("ms"),
    )
    return rows.groupBy("partition_id", "slice").transformWithStateInPandas(
        statefulProcessor=AdjacencyState(window_ms, bucket_ms, lazy_slide_ms, clock),
        outputStructType=OUT,
        outputMode="Update",
        timeMode="ProcessingTime" if clock else "EventTime",
    )
