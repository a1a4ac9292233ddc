"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Pieces shorter than a sequence are dealt to shards of bounded size by their
place in the table.  Each shard is packed by several islands.  A chromosome
assigns the shard's pieces to bins; the first ones best-fit the pieces in
random orders.  Crossover injects whole well-filled bins of one parent into the
other, removes the bins that then hold a piece twice and best-fits the
displaced pieces.  After each epoch an island's elite migrates to the next
island of its shard through a shuffle; the best packing of any island stays.
What stands in bins that are not well filled is dealt to new, fewer shards and
packed again in another distributed round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideweave.llm.batches import arrow_map, bound_batches, sliced, strings
from tideweave.llm.tokens import byte_bpe
from tideweave.plans.lineage import stash

CAPACITY = 2048
SHARD_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 24
#: A bin is well filled from this share of its shard's median fill on.
WELL_FILLED = 0.98
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "shard long, island int, kind string, bins int, turns int, sizes binary, best binary"


# ---------------------------------------------------------------------- pieces
def piece_starts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenised_pieces(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str = "byte_bpe_50k.json",
) -> DataFrame:
    """The pieces of every document: its ids, then id 0; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        for part in sliced(batches):
            rows: list[list[int | None]] = [[], [], [], [], []]
            for doc, text in zip(part.column(0).to_pylist(), strings(part.column(1)), strict=True):
                ids = encoder.encode(text) + b"\0\0\0\0"
                for k, (start, length) in enumerate(piece_starts(len(ids) // 4, capacity)):
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    for col, value in zip(rows, (doc, k, start, length, crc), strict=True):
                        col.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names
            )

    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(kept, run, PIECES)


# ------------------------------------------------------------------ chromosomes
class Rooms:
    """Bins by remaining room, with the smallest sufficient room found at once."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_room, self.mask, self.bins = capacity, {}, 0, 0

    def add(self, bin_id: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(bin_id)
        self.mask |= 1 << room

    def place(self, size: int) -> int:
        """Best fit: the bin with the least room that still takes ``size``."""
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = self.by_room[room]
            bin_id = held.pop()
            if not held:
                self.mask ^= 1 << room
        else:
            room, bin_id = self.capacity, self.bins
            self.bins += 1
        self.add(bin_id, room - size)
        return bin_id


def dense(assign: np.ndarray) -> np.ndarray:
    """Bins renumbered from 0."""
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit of all pieces in the given order."""
    rooms, assign = Rooms(capacity), np.empty(len(sizes), np.int32)
    assign[order] = [rooms.place(s) for s in sizes[order].tolist()]
    return assign


def fitness(sizes: np.ndarray, assign: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller bins (the sum of squared fill)."""
    fill = np.bincount(assign, weights=sizes)
    return -len(fill), float(((fill / capacity) ** 2).sum())


def crossover(
    sizes: np.ndarray, host: np.ndarray, donor: np.ndarray, capacity: int, rng: np.random.Generator
) -> np.ndarray:
    """Inject whole well-filled bins of ``donor`` into ``host``.

    How full they must be, how many are taken and how many bins the mutation
    opens varies from child to child.
    """
    fill = np.bincount(donor, weights=sizes)
    well = np.flatnonzero(fill >= np.quantile(fill, rng.uniform(0.4, 0.9)))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(well, size=max(1, int(len(well) * rng.uniform(0.1, 0.5))), replace=False)] = True
    injected = chosen[donor]
    n_host = int(host.max()) + 1
    doubled = np.zeros(n_host, bool)
    doubled[host[injected]] = True
    # Some of the least filled bins are opened as well (mutation).
    left = np.bincount(host, weights=sizes, minlength=n_host)
    doubled[np.argsort(left)[: max(1, int(n_host * rng.uniform(0.02, 0.2)))]] = True
    displaced = np.flatnonzero(doubled[host] & ~injected)
    child = host.copy()
    child[injected] = n_host + donor[injected]
    stay = ~doubled[host] | injected
    rooms = Rooms(capacity)
    ids, place = np.unique(child[stay], return_inverse=True)
    child[stay] = place
    rooms.bins = len(ids)
    for b, room in enumerate((capacity - np.bincount(place, weights=sizes[stay])).astype(int).tolist()):
        if room:
            rooms.add(b, room)
    order = displaced[np.argsort(-sizes[displaced], kind="stable")]
    child[order] = [rooms.place(s) for s in sizes[order].tolist()]
    return dense(child)


def evolve(
    sizes: np.ndarray,
    seed: int | list[int],
    capacity: int,
    population: int,
    generations: int,
    arrived: list[np.ndarray],
) -> tuple[np.ndarray, int]:
    """One epoch of an island; returns its elite and the generations it took.

    The island starts from best fits of random orders, and from what arrived in
    later epochs; there the best fit of the descending order joins it as well,
    so the result is never worse than that.  It ends early only at the lower
    bound, which nothing can better.
    """
    bound = -(-int(sizes.sum()) // capacity)
    rng = np.random.default_rng(seed)
    pool = list(arrived)
    if pool:
        pool.append(dense(best_fit(sizes, np.argsort(-sizes, kind="stable"), capacity)))
    while len(pool) < population:
        pool.append(dense(best_fit(sizes, rng.permutation(len(sizes)), capacity)))
    key = lambda x: x[0]
    scored = sorted(((fitness(sizes, p, capacity), p) for p in pool), key=key, reverse=True)
    for turn in range(generations):
        if -scored[0][0][0] <= bound:
            return scored[0][1], turn
        children = []
        for _ in range(max(1, population // 2)):
            i, j = sorted(rng.choice(len(scored), 2, replace=False).tolist())
            # Either parent may be the host; the better one is more often.
            host, donor = (i, j) if rng.random() < 0.7 else (j, i)
            children.append(crossover(sizes, scored[host][1], scored[donor][1], capacity, rng))
        scored += [(fitness(sizes, c, capacity), c) for c in children]
        scored = sorted(scored, key=key, reverse=True)[:population]
    return scored[0][1], generations


# --------------------------------------------------------------------- packing
def _islands(
    shards: DataFrame, n: int, capacity: int, islands: int, epochs: int, population: int, generations: int
) -> DataFrame:
    """``(shard, best, turns)`` of every one of ``n`` shards ``(shard, sizes)``."""

    def born(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                yield pd.DataFrame([dict(shard=r.shard, island=i, kind="resident", bins=0, turns=0, sizes=r.sizes, best=None) for i in range(islands)])

    def epoch(k: int):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            sizes = np.frombuffer(group["sizes"].dropna().iloc[0], np.int64)
            shard, island = int(group["shard"].iloc[0]), int(group["island"].iloc[0])
            arrived = [np.frombuffer(b, np.int32).copy() for b in group["best"] if b is not None]
            seed = [shard & 0xFFFFFFFF, island, k]
            best, turns = evolve(sizes, seed, capacity, population, generations, arrived)
            turns += int(group["turns"].max())
            row = dict(shard=shard, bins=int(best.max()) + 1, turns=turns, best=best.astype(np.int32).tobytes())
            out = [row | dict(island=island, kind="resident", sizes=group["sizes"].dropna().iloc[0])]
            if k + 1 < epochs and islands > 1:
                out.append(row | dict(island=(island + 1) % islands, kind="migrant", sizes=None))
            return pd.DataFrame(out)[["shard", "island", "kind", "bins", "turns", "sizes", "best"]]

        return run

    # A number of partitions of our own is not coalesced, so islands run side by side.
    limit = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(n * islands, max(limit, n * islands // 64)))
    state = shards.mapInPandas(born, STATE)
    for k in range(epochs):
        state = state.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInPandas(epoch(k), STATE)
    best = F.min_by(F.struct("best", "turns"), F.struct("bins", "island")).alias("b")
    return state.groupBy("shard").agg(best).select("shard", "b.best", "b.turns")


def _dealt(short: DataFrame, shards: int) -> DataFrame:
    """Rows ``(shard, items)``: pieces dealt one by one, so shards are alike whatever their values.

    ``short`` has its place in the table as ``slot``: a partition's number and
    the row's in it.  Each partition starts dealing at another shard.
    """
    names = ["length", "doc_id", "piece", "start", "ids_crc32"]
    place = F.pmod(F.xxhash64(F.shiftright("slot", 33)), F.lit(shards)) + F.col("slot").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = short.withColumn("shard", F.pmod(place, F.lit(shards)))
    return dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct(*names)), asc=False).alias("items"))


def _round(
    short: DataFrame, turn: int, last: bool, n: int, shards: int, capacity: int, search: tuple[int, int, int, int]
) -> DataFrame:
    """The ``n`` pieces packed shard by shard; ``sequence_id`` is null for what is left to the next round."""
    names = ["length", "doc_id", "piece", "start", "ids_crc32"]

    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [np.array(v, np.int64).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["shard", "sizes"])

    def laid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                items = pd.DataFrame([tuple(x[n] for n in names) for x in r.items_], columns=names)
                bins = np.frombuffer(r.best, np.int32)
                fill = np.bincount(bins, weights=items["length"])
                done = np.full(len(bins), True) if last else fill[bins] >= WELL_FILLED * np.median(fill)
                number = (turn << 56) + (int(r.shard) << 16) + bins.astype(np.int64)
                offset = items.groupby(bins, sort=False)["length"].cumsum() - items["length"]
                items["sequence_id"] = pd.Series(number, dtype="Int64").where(done)
                items["offset"] = offset.astype("Int64").where(done)
                items["doc_id"] = items["doc_id"].astype("Int64")
                yield items[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    lists = stash(_dealt(short, shards), "pack-shards")
    sizes = arrow_map(lists.select("shard", F.col("items.length").alias("sizes")), sizes_of, "shard long, sizes binary")
    best = _islands(sizes, shards, capacity, *search).select("shard", "best")
    joined = lists.withColumnRenamed("items", "items_").join(best, "shard")
    return joined.mapInPandas(laid, PIECES + ", sequence_id long, offset long")


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    shard_pieces: int = SHARD_PIECES,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    population: int = POPULATION,
    generations: int = GENERATIONS,
) -> DataFrame:
    """``pieces`` (as :func:`tokenised_pieces` gives them) with ``sequence_id`` and ``offset``.

    No sequence holds over ``capacity`` tokens and none has gaps.  Full pieces
    are sequences by themselves.  A shard holds about ``shard_pieces`` pieces,
    whatever the input's size or values, so no task grows with it.  Pieces of
    bins that are not well filled go to another round with fewer shards, until
    one shard is left or a round leaves over half of its pieces.
    """
    held = stash(pieces, "pack-pieces")
    bound_batches(held.sparkSession)
    packed = held.where(F.col("length") >= capacity).withColumns(
        {"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}
    )
    short, before, turn = held.where(F.col("length") < capacity), None, 0
    search = (islands, epochs, population, generations)
    while True:
        short = stash(short.withColumn("slot", F.monotonically_increasing_id()), f"pack-short-{turn}")
        n = short.count()
        if not n:
            return packed
        shards = -(-n // shard_pieces)
        last = shards == 1 or (before is not None and 2 * n > before)
        done = _round(short, turn, last, n, shards, capacity, search)
        if last:
            return packed.unionByName(done)
        done = stash(done, f"pack-round-{turn}")
        packed = packed.unionByName(done.where("sequence_id is not null"))
        short, before, turn = done.where("sequence_id is null").drop("sequence_id", "offset"), n, turn + 1


def pack_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str = "byte_bpe_50k.json",
) -> DataFrame:
    """Pack all documents into as few sequences as the islands find.

    One row per piece.  A null text is empty and packs as its end id alone;
    rows with a null or repeated id are packed like any other; an empty table
    gives an empty result; other columns of ``df`` are not read.
    """
    return pack(tokenised_pieces(df, id_col, text_col, capacity, tokenizer), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLES: dict[str, str] = {}
