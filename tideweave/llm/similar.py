"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the vector of the
segments' bit counts lies in a grid, and the Manhattan distance of two vectors
is at most the Hamming distance of the fingerprints.  With at most two
differing bits at most two of the four blocks of eight segments differ, so two
fingerprints that link share a grid cell on at least one of the six pairs of
blocks.  Cells are joined on, the Manhattan bound filters inside a cell and the
exact Hamming distance decides.  A cell yields a spanning forest of its links,
never all its pairs; cells that stay large are refined by the same rule inside
the bits that they leave open, as often as it takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideweave.llm.batches import arrow_map, binaries, sliced
from tideweave.operators.components import connected_components
from tideweave.plans.lineage import stash

BITS = 64
MAX_DIFFERING = 2
FLUSH = 1 << 19
#: Byte value -> its eight bits, one per byte of a 64-bit word.
LANES = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], dtype=np.uint64)
EVEN = np.uint64(0x5555555555555555)


# --------------------------------------------------------------- fingerprints
def shingle_hashes(raw: bytes, width: int = 3) -> list[int]:
    """XXH64 (seed 42) of every ``width``-word shingle of lower-cased text."""
    words = raw.lower().split()
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    digest, joined = xxhash.xxh64_intdigest, b" ".join
    return [digest(joined(s), 42) for s in zip(*(words[i:] for i in range(width)), strict=False)]


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A fingerprint per run of ``lengths`` hashes: a bit is set in over half."""
    out = np.zeros(len(lengths), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    runs = lengths[full]
    # Blocks of at most 255 hashes, so that the byte lanes cannot overflow.
    blocks = -(-runs // 255)
    first = np.repeat(np.cumsum(runs) - runs, blocks)
    within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    lanes = LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, first + 255 * within, axis=0)
    counts = sums.view(np.uint8).reshape(len(sums), BITS).astype(np.int64)
    counts = np.add.reduceat(counts, np.cumsum(blocks) - blocks, axis=0)
    set_bits = (2 * counts > runs[:, None]).astype(np.uint8)
    out[full] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints_of(texts: list[bytes], width: int = 3) -> np.ndarray:
    """Fingerprints of texts; the hashes of a long text are folded in pieces."""
    done, pending, lengths = [], [], []

    def flush() -> None:
        flat = np.array(pending, dtype=np.uint64)
        done.append(majority(flat, np.array(lengths, dtype=np.int64)))
        pending.clear()
        lengths.clear()

    for raw in texts:
        got = shingle_hashes(raw, width)
        pending += got
        lengths.append(len(got))
        if len(pending) >= FLUSH:
            flush()
    flush()
    return np.concatenate(done)


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed long; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            fps = fingerprints_of(binaries(part.column(1)), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["id", "fp"])

    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(kept, run, "id long, fp long")


# ----------------------------------------------------------------------- cells
def embedding(fps: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 two-bit segments, each in unary (0, 01, 11).

    In unary the Manhattan distance of two vectors is the number of differing
    bits of their codes.
    """
    low, high = fps & EVEN, (fps >> np.uint64(1)) & EVEN
    return low | high | ((low & high) << np.uint64(1))


def embedding_column(fp: Column) -> Column:
    """:func:`embedding` as a column expression."""
    even = F.lit(int(EVEN))
    low, high = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def grid_masks(bits: list[int], parts: int = 4, shared: int = 2) -> list[list[int]]:
    """Which bits a cell fixes: every choice of ``shared`` of ``parts`` blocks."""
    size = -(-len(bits) // parts)
    blocks = [bits[i * size : (i + 1) * size] for i in range(parts)]
    return [sum(chosen, []) for chosen in combinations(blocks, shared)]


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def first_tables() -> list[list[int]]:
    """The bits that each table of cells fixes."""
    return grid_masks(list(range(BITS)))


def finer_tables(tables: list[list[int]]) -> list[tuple[int, list[int]]]:
    """``(parent table, bits)`` of the tables that refine heavy cells of ``tables``."""
    every = set(range(BITS))
    return [
        (k, fixed + more)
        for k, fixed in enumerate(tables)
        for more in grid_masks(sorted(every - set(fixed)))
    ]


def spanning_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct sorted fingerprints.

    Members are compared under the Manhattan bound in blocks of rows, so memory
    stays bounded whatever the cell's size; what passes is verified exactly.
    """
    n = len(fps)
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    vectors = embedding(fps)
    rows = max(1, (1 << 18) // n)
    for lo in range(0, n, rows):
        # Pairs are taken once, so only columns from the block's first row on count.
        x, y = np.nonzero(np.bitwise_count(vectors[lo : lo + rows, None] ^ vectors[None, lo:]) <= MAX_DIFFERING)
        keep = x < y
        x, y = x[keep] + lo, y[keep] + lo
        exact = np.bitwise_count(fps[x] ^ fps[y]) <= MAX_DIFFERING
        for i, j in zip(x[exact].tolist(), y[exact].tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                a.append(i)
                b.append(j)
    return fps[a], fps[b]


def _cells(fps: DataFrame, tables: list[tuple[int, list[int]]], inside: bool = False) -> DataFrame:
    """Rows ``(cell, t, fp)``: the fingerprint's cell in each table.

    ``inside``: ``fps`` has the table ``t`` whose heavy cell is refined, and
    every table of that level has as many finer ones, in order.
    """
    vector = embedding_column(F.col("fp"))
    masks = F.array(*(F.lit(signed(mask_of(bits))) for _, bits in tables))
    if not inside:
        rows = fps.select("fp", vector.alias("v"), F.posexplode(masks).alias("t", "mask"))
    else:
        each = len(tables) // (tables[-1][0] + 1)
        own = F.slice(masks, F.col("t") * each + 1, each)
        rows = fps.select("fp", vector.alias("v"), F.col("t").alias("u"), F.posexplode(own).alias("k", "mask"))
        rows = rows.withColumn("t", F.col("u") * each + F.col("k"))
    return rows.select(F.col("v").bitwiseAND(F.col("mask")).alias("cell"), "t", "fp")


def _links(cells: DataFrame) -> DataFrame:
    """Spanning links of every cell; a cell's rows are adjacent in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def solve(cell: np.ndarray, t: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((np.diff(cell) != 0) | (np.diff(t) != 0)) + 1
            edges = np.concatenate([[0], cut, [len(cell)]])
            left, right = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo > 1:
                    x, y = spanning_links(np.unique(fp[lo:hi].view(np.uint64)))
                    left.append(x)
                    right.append(y)
            if left:
                x, y = (np.concatenate(v).astype(np.uint64).view(np.int64) for v in (left, right))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["src", "dst"])

        for batch in batches:
            cols = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(cols[0]):
                continue
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            start = len(last) - (np.argmin(last[::-1]) if not last.all() else len(last))
            yield from solve(*(c[:start] for c in cols)) if start else ()
            held = [c[start:] for c in cols]
        if len(held[0]):
            yield from solve(*held)

    ordered = cells.select("cell", F.col("t").cast("long").alias("t"), "fp")
    ordered = ordered.repartition("cell", "t").sortWithinPartitions("cell", "t")
    return arrow_map(ordered, run, "src long, dst long")


def near_links(fps: DataFrame, max_cell: int = 1024) -> DataFrame:
    """``(src, dst)`` between distinct fingerprints, enough to connect all.

    ``fps`` holds distinct fingerprints.  A cell of over ``max_cell`` members is
    refined inside the bits it leaves open, and so are the finer cells, until
    none is larger or all bits of the embedding but four are fixed.
    """
    tables = first_tables()
    cells, links = _cells(fps.select("fp"), [(-1, bits) for bits in tables]), None
    while True:
        heavy = None
        if len(tables[0]) < BITS - 4:
            heavy = stash(cells.groupBy("cell", "t").count().where(F.col("count") > max_cell).drop("count"), "sim-heavy")
        done = heavy is None or heavy.isEmpty()
        own = _links(cells if done else cells.join(heavy, ["cell", "t"], "left_anti"))
        links = own if links is None else links.unionAll(own)
        if done:
            return links
        rest = stash(cells.join(heavy, ["cell", "t"], "left_semi").select("t", "fp"), "sim-rest")
        finer = finer_tables(tables)
        cells, tables = _cells(rest, finer, True), [bits for _, bits in finer]


def near_components(prints: DataFrame) -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``(id, fp)``.

    ``component_id`` is the smallest id reachable over links of at most
    ``MAX_DIFFERING`` bits, the row's own included.  Rows of one fingerprint
    are collapsed before any join; rows with a null id share in links and get
    the component of their fingerprint.
    """
    distinct = stash(prints.groupBy("fp").agg(F.min("id").alias("rep")), "sim-distinct")
    linked = connected_components(near_links(distinct)).toDF("fp", "root")
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("id", "fp", "component_id")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Near-duplicate classes of whole texts.

    Returns ``(<id_col>, fingerprint, component_id)``, one row per row of
    ``df``.  A null text is empty; a text without words has the fingerprint
    zero and links like any other; repeated rows each get a row; an empty table
    gives an empty result; further columns of ``df``, whatever their names, are
    not read.
    """
    prints = stash(simhash(df, id_col, text_col, width), "sim-prints")
    return near_components(prints).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``df`` that stay: of each class the one with the smallest id.

    Ids name documents: repeated rows of the id that stays are kept as they
    are, and rows with a null id always stay, as nothing names them.
    """
    classes = simhash_components(df, id_col, text_col, width)
    gone = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return df.join(stash(gone, "sim-gone"), F.col(id_col) == F.col("__gone"), "left_anti")


# ------------------------------------------------------------- shingle sets
#: Smallest shingle hashes that are keys: two texts at a Jaccard similarity of
#: 0.8 share none of them with a probability of 0.2 ** 10.
KEYS = 10
#: Members of a key of which all pairs are candidates at once.
SMALL_GROUP = 32
#: Nodes of a fingerprint in a chain.
CHAIN = 4096
#: Members, and bytes of their bits, on either side of a task of a larger key.
BLOCK = 2048
BLOCK_BYTES = 16 << 20
#: Words of bits that go with a pair.
FOLD = 32
#: Words, and members of one side, that are compared at a time.
AT_ONCE, ROWS = 1 << 21, 128


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(raw, width), dtype=np.uint64))


def parity_bits(held: np.ndarray) -> np.ndarray:
    """A set of hashes as 8 to 16 bits a hash: which bits an odd number of them falls on.

    Of two sets at most as many bits differ as hashes, however the bits are
    folded, so the bound of :func:`most_differing` never rules out a similar pair.
    """
    words = 1 << (len(held) // 8).bit_length()
    on = np.bincount((held & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((on & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Rows of bits cut to ``words`` words."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def matrix(values: list[bytes], words: int) -> np.ndarray:
    """Bits of several lengths as rows of ``words`` words."""
    out = np.empty((len(values), words), dtype=np.uint64)
    sizes = np.array([len(v) for v in values])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = folded(np.frombuffer(b"".join(values[i] for i in at), dtype=np.uint64).reshape(len(at), -1), words)
    return out


def most_differing(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How many hashes two similar sets differ in at most, by the sum of their sizes."""
    return (1 - similarity) / (1 + similarity) * sizes + 1e-6


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def may_be_similar(xs: list[bytes], ys: list[bytes], sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the bits of each pair leave it open that the sets are similar."""
    words = np.array([min(len(x), len(y)) // 8 for x, y in zip(xs, ys, strict=True)], dtype=np.int64)
    most = most_differing(sizes, similarity)
    out = np.zeros(len(xs), dtype=bool)
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        out[at] = differing(matrix([xs[i] for i in at], w), matrix([ys[i] for i in at], w)) <= most[at]
    return out


class Members:
    """One side of a block: members by the length of their bits."""

    def __init__(self, sizes: np.ndarray, bits: list[bytes]) -> None:
        self.sizes, self.by_words = sizes, {}
        words = np.array([len(v) // 8 for v in bits], dtype=np.int64)
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            self.by_words[w] = at, matrix([bits[i] for i in at], w)


def plausible(x: Members, y: Members, open_pairs, similarity: float) -> Iterator[tuple[np.ndarray, ...]]:
    """``(i, j, share)`` of pairs of the two sides that may be similar and ``open_pairs(i, j)``.

    ``share`` is the differing bits by those that sets just at the similarity
    are expected to differ in.  A fold of the bits is compared first.
    """
    for v, (xs, xbits) in x.by_words.items():
        for w in (v // 2, v, 2 * v):  # sizes further apart are never similar
            if w not in y.by_words:
                continue
            ys, ybits = y.by_words[w]
            words = min(v, w)
            xfull, yfull = folded(xbits, words), folded(ybits, words)
            coarse = max(1, words // 8)
            xfold, yfold = folded(xfull, coarse), folded(yfull, coarse)
            m = y.sizes[ys]
            rows = max(1, min(ROWS, AT_ONCE // (coarse * len(ys))))
            for lo in range(0, len(xs), rows):
                n = x.sizes[xs[lo : lo + rows], None]
                keep = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6
                keep &= differing(xfold[lo : lo + rows, None], yfold[None]) <= most_differing(n + m, similarity)
                keep &= open_pairs(xs[lo : lo + rows, None], ys[None])
                i, j = np.nonzero(keep)
                i += lo
                step = max(1, AT_ONCE // words)
                bits = [differing(xfull[i[k : k + step]], yfull[j[k : k + step]]) for k in range(0, len(i), step)]
                bits = np.concatenate(bits) if bits else np.empty(0, np.int64)
                most = most_differing(x.sizes[xs[i]] + m[j], similarity)
                good = bits <= most
                expected = 32 * words * (1 - np.exp(-most / (32 * words)))
                yield xs[i[good]], ys[j[good]], (bits / expected)[good]


def block_pairs(
    x: Members, y: Members, xpart: np.ndarray, ypart: np.ndarray, same: bool, every: bool, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)`` between members of different parts that may be similar.

    ``every``: all of them.  Otherwise a forest over the parts, of pairs that
    are likely to be similar, the likelier the earlier.
    """
    parts, label = np.unique(np.concatenate([xpart, ypart]), return_inverse=True)
    parent = np.arange(len(parts))
    sides = [label[: len(xpart)], label[len(xpart) :]]

    def find(p: int) -> int:
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    def open_pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        apart = sides[0][i] != sides[1][j]
        return apart & (i < j) if same else apart

    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j, share in plausible(x, y, open_pairs, similarity):
        if not every and len(i):
            likely = np.flatnonzero(share <= 1)
            likely = likely[np.argsort(share[likely], kind="stable")]
            ends = np.stack([sides[0][i[likely]], sides[1][j[likely]]])
            _, first = np.unique(ends.min(axis=0) * len(parts) + ends.max(axis=0), return_index=True)
            took = []
            for k in likely[np.sort(first)].tolist():
                p, q = find(sides[0][i[k]]), find(sides[1][j[k]])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    took.append(k)
            i, j = i[took], j[took]
            if took:
                while (parent != parent[parent]).any():
                    parent[:] = parent[parent]
                sides = [parent[side] for side in sides]
        left.append(i)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """``(id, mark, fp, node, n, keys, bits)`` of rows ``(id, mark, text)``.

    ``fp`` is the fingerprint, ``node`` hashes the shingle set, ``n`` is its
    size, ``keys`` are its smallest hashes and ``bits`` its :func:`parity_bits`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column=2):
            fps, nodes, sizes, keys, bits = [], [], [], [], []
            for raw in binaries(part.column(2)):
                hashes = np.array(shingle_hashes(raw, width), dtype=np.uint64)
                fps.append(majority(hashes, np.array([len(hashes)]))[0])
                held = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(held.tobytes(), 7))
                sizes.append(len(held))
                keys.append(held[:KEYS].view(np.int64))
                bits.append(parity_bits(held).tobytes())
            columns = [
                part.column(0),
                part.column(1),
                pa.array(np.array(fps, dtype=np.uint64).view(np.int64)),
                pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()),
                lists(keys),
                pa.array(bits, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "fp", "node", "n", "keys", "bits"])

    def lists(values: list[np.ndarray]) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))

    schema = "id long, mark long, fp long, node long, n long, keys array<long>, bits binary"
    return arrow_map(rows, run, schema)


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs ``(src, dst)`` whose sets have at least the Jaccard similarity.

    Pairs that sizes or bits rule out are dropped before any text is moved; the
    rest is decided on the whole sets.
    """

    def open_still(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes = part.column(4).to_numpy()
            keep = pa.array(may_be_similar(part.column(5).to_pylist(), part.column(6).to_pylist(), sizes, similarity), pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(i).filter(keep) for i in range(4)], names=["src", "dst", "ma", "mb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column=2):
            good = []
            for a, b in zip(binaries(part.column(2)), binaries(part.column(3)), strict=True):
                x, y = shingle_set(a, width), shingle_set(b, width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(i).filter(keep) for i in (0, 1)], names=["src", "dst"])

    held = nodes.select("node", "n", "fold", "mark")
    both = pairs.join(held.toDF("src", "m", "x", "ma"), "src").join(held.toDF("dst", "n", "y", "mb"), "dst")
    both = both.where(F.least("m", "n") >= similarity * F.greatest("m", "n") - 1e-6)
    both = both.select("src", "dst", "ma", "mb", (F.col("m") + F.col("n")).alias("n"), "x", "y")
    both = arrow_map(both, open_still, "src long, dst long, ma long, mb long")
    both = stash(both, "near-pairs")
    marks = both.select(F.explode(F.array("ma", "mb")).alias("mark")).distinct()
    texts = texts.join(marks, "mark", "left_semi")
    left, right = texts.toDF("ma", "x"), texts.toDF("mb", "y")
    joined = both.join(left, "ma").join(right, "mb").select("src", "dst", "x", "y")
    return arrow_map(joined, run, "src long, dst long")


def _print_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates by SimHash: nodes of one fingerprint in a chain, and of linked fingerprints."""
    chain = F.lead("node").over(Window.partitionBy("fp", F.pmod(F.xxhash64("node"), F.col("parts"))).orderBy("node"))
    sizes = nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.ceil(F.count("*") / CHAIN).alias("parts"))
    sizes = stash(sizes, "near-prints")
    held = nodes.select("node", "fp").join(sizes, "fp")
    same = held.select(F.col("node").alias("src"), chain.alias("dst")).where("dst is not null")
    to_rep = held.where("parts > 1 and node <> rep").select(F.col("rep").alias("src"), F.col("node").alias("dst"))
    links = near_links(sizes.select("fp"))
    rep = sizes.select("fp", "rep")
    across = links.join(rep.toDF("src", "a"), "src").join(rep.toDF("dst", "b"), "dst")
    return same.unionAll(to_rep).unionAll(across.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _with_fold(nodes: DataFrame) -> DataFrame:
    """``(node, n, mark, bits, fold)``: ``fold`` is the bits cut to what goes with a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, column=3):
            fold = []
            for v in part.column(3).to_pylist():
                fold.append(v if len(v) <= 8 * FOLD else matrix([v], FOLD).tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fold, pa.binary())], names=["node", "n", "mark", "bits", "fold"])

    return arrow_map(nodes.select("node", "n", "mark", "bits"), run, "node long, n long, mark long, bits binary, fold binary")


def _small_pairs(keyed: DataFrame, parts: DataFrame) -> DataFrame:
    """All pairs of nodes that share a key of few nodes and lie in different parts."""
    whole = keyed.where(F.col("size") <= SMALL_GROUP).join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    ends = F.min("part").alias("low"), F.max("part").alias("high")
    small = whole.groupBy("key").agg(F.collect_list(F.struct("node", "part")).alias("g"), *ends).where("low <> high")
    every = small.select("g", F.posexplode("g").alias("i", "x")).select("x", F.explode(F.slice("g", F.col("i") + 2, SMALL_GROUP)).alias("y"))
    return every.where("x.part <> y.part").select(F.col("x.node").alias("node"), F.col("y.node").alias("other"))


def _large_pairs(keyed: DataFrame, nodes: DataFrame, parts: DataFrame, similarity: float, every: bool) -> DataFrame:
    """Pairs of nodes of a larger key in different parts that may be similar, by :func:`block_pairs`.

    Each pair of blocks of a key is a task of its own, but for pairs of blocks
    within the key's largest part, which hold no open pair.
    """
    whole = keyed.where(F.col("size") > SMALL_GROUP).join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    largest = whole.groupBy("key", "part").count().groupBy("key")
    largest = largest.agg(F.max(F.struct("count", "part"))["part"].alias("top"), F.count("*").alias("parts"))
    rows = whole.join(largest.where("parts > 1"), "key").select("key", "node", "part", (F.col("part") != F.col("top")).alias("minor"))
    rows = stash(rows.join(nodes.select("node", "n", "bits"), "node"), "near-open")

    def slots(of: Column) -> Column:
        held = F.sum(F.when(of, F.length("bits")).otherwise(0)) / BLOCK_BYTES
        return F.ceil(F.greatest(F.count_if(of) / BLOCK, held)).cast("long")

    dealt = rows.groupBy("key").agg(slots(F.col("minor")).alias("few"), slots(~F.col("minor")).alias("more"))
    few, more, at = F.col("few"), F.col("more"), F.xxhash64("node", "key")
    slot = F.when(F.col("minor"), F.pmod(at, few)).otherwise(few + F.pmod(at, more))
    rows = rows.join(dealt, "key").withColumn("slot", slot)
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("minor"), few + more).otherwise(few) - 1))
    rows = rows.select("key", "slot", "node", "part", "n", "bits", met.alias("t"))
    rows = rows.select("key", F.least("slot", "t").alias("a"), F.greatest("slot", "t").alias("b"), "slot", "node", "part", "n", "bits")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in key[1:])
        slot, node, part, n = (table.column(c).to_numpy() for c in ("slot", "node", "part", "n"))
        bits = table.column("bits").to_pylist()
        at = [np.flatnonzero(slot == k) for k in (a, b)]
        x, y = (Members(n[k], [bits[i] for i in k.tolist()]) for k in at)
        i, j = block_pairs(x, y, part[at[0]], part[at[1]], a == b, every, similarity)
        return pa.table({"node": node[at[0][i]], "other": node[at[1][j]]})

    return rows.groupBy("key", "a", "b").applyInArrow(run, "node long, other long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct()


def similar_links(nodes: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """``(src, dst)`` between similar nodes, enough to connect all that share a key.

    First the SimHash links, each verified on the whole sets.  Texts at the
    similarity often lie further apart than the radius, so nodes that share one
    of their smallest shingle hashes are compared too, while their parts still
    differ: all pairs of small groups and a forest of likely pairs of larger
    ones, then every pair of the larger ones that is left open.
    """
    prints = stash(_print_pairs(nodes).distinct(), "near-print-pairs")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    keyed = stash(keyed.join(sizes, "key"), "near-keys")
    # Texts are moved once: those of nodes that have any candidate.
    some = keyed.select("node").unionAll(prints.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    nodes = stash(_with_fold(nodes.join(some, "node", "left_semi")), "near-some")
    marks = nodes.select("mark").distinct().hint("merge")  # a plan for any size: texts outgrow a broadcast
    texts = rows.select("mark", "text").join(marks, "mark", "left_semi").dropDuplicates(["mark"])
    texts = stash(texts, "near-texts")
    links = stash(_verified(prints, nodes, texts, width, similarity), "near-links")
    for every in (False, True):
        parts = connected_components(links).toDF("node", "part")
        pairs = _large_pairs(keyed, nodes, parts, similarity, every)
        pairs = pairs if every else pairs.unionAll(_small_pairs(keyed, parts))
        found = _verified(_ordered(pairs), nodes, texts, width, similarity)
        links = links.unionAll(stash(found, f"near-links-{'all' if every else 'likely'}"))
    return links


def keep_one_per_similar(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The rows of ``df`` that stay: of each class the one with the smallest id.

    Classes are connected over pairs of texts that :func:`similar_links` finds;
    each has at least the Jaccard ``similarity`` on sets of ``width``-word
    shingles.  Texts without words are one class.  Repeated rows of the id that
    stays are kept, and rows with a null id always stay, as nothing names them;
    an id on different texts loses only the rows whose class another id
    represents.  An empty table gives an empty result; columns are carried
    along whatever their names.
    """
    own = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.select(own.alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    sketches = stash(_sketches(rows, width), "near-sketches")
    nodes = sketches.groupBy("node").agg(
        *(F.min(c).alias(c) for c in ("n", "fp", "mark")), *(F.first(c).alias(c) for c in ("keys", "bits"))
    )
    nodes = stash(nodes, "near-nodes")
    parts = connected_components(similar_links(nodes, rows, width, similarity)).toDF("node", "part")
    classes = sketches.select("id", "mark", "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    keep = classes.groupBy("part").agg(F.min("id").alias("keep"))
    gone = classes.join(keep, "part").where("id <> keep")
    gone = stash(gone.select(F.col("id").alias("__gone"), F.col("mark").alias("__mark")).distinct(), "near-gone")
    return df.join(gone, (own == F.col("__gone")) & (F.xxhash64(text) == F.col("__mark")), "left_anti")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_simhash_near_dedup": op6_simhash_near_dedup}
ORACLES: dict[str, str] = {}
