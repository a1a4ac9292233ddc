"""Media columns: archives of images, and a data source that reads them.

Payloads are stored losslessly as 8-bit greyscale PNG images inside tar
archives.  Spark's own writer commits the archives to a folder (any store that
Spark can write); the data source plans byte ranges over that folder, so a
large archive is read by many tasks.  A range finds its first member by the
header's checksum and the archive's own mark, reads on member by member, and
owns those whose header starts inside it.  A member that can't be read or
whose check sums fail is read again by its offset, apart from all others.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tideweave.llm.batches import arrow_map, binaries, sliced
from tideweave.plans.lineage import made_path

BLOCK = 512
#: Samples of an image row; a payload is a positive multiple of it.
ROW = 576
PNG = b"\x89PNG\r\n\x1a\n"
ROW_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
#: Bytes of a range at least; they grow so that a read has so many ranges at most.
RANGE_BYTES = 16 << 20
MAX_RANGES = 100_000
RETRIES = 3
MEMBERS = "archive string, offset long, name string, media binary, error string"
FEATURES = (
    "name string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


# ---------------------------------------------------------------------- images
def padded(raw: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of ``ROW``."""
    return raw + b"\xff" * (-len(raw) % ROW or (0 if raw else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 3) -> bytes:
    """A payload of whole rows as an 8-bit greyscale image."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks, each held against its check sum."""
    if media[:8] != PNG:
        raise ValueError("no PNG signature")
    at = 8
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if len(data) != size or media[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, data
        at += 12 + size


def from_png(media: bytes) -> bytes:
    """The samples of an image made by :func:`to_png`."""
    head, data = b"", b""
    for kind, part in png_chunks(media):
        if kind == b"IHDR":
            head = part
        elif kind == b"IDAT":
            data += part
    width, height, depth, colour = struct.unpack(">IIBB", head[:10])
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not an unfiltered 8-bit greyscale image")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation, entropy in bits, and mean step of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts / len(samples)
    levels = np.arange(256)
    mean = float(share @ levels)
    deviation = float(max(0.0, share @ (levels - mean) ** 2)) ** 0.5
    some = share[share > 0]
    entropy = float(-(some * np.log2(some)).sum())
    step = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    return f"mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};step={step:.4f}"


# -------------------------------------------------------------------- archives
def tar_header(name: str, size: int, mark: str) -> bytes:
    """A ustar header; the owner's name carries the archive's mark."""
    head = bytearray(BLOCK)
    for at, value in (
        (0, name.encode()[:100]),
        (100, b"0000644\0"),
        (108, b"0000000\0"),
        (116, b"0000000\0"),
        (124, f"{size:011o}\0".encode()),
        (136, b"00000000000\0"),
        (148, b" " * 8),
        (156, b"0"),
        (257, b"ustar\00000"),
        (265, mark.encode()[:31]),
    ):
        head[at : at + len(value)] = value
    head[148:156] = f"{sum(head):06o}\0 ".encode()
    return bytes(head)


def parse_header(block: bytes, mark: str) -> tuple[str, int] | None:
    """``(name, size)`` if the block is a header of an archive with this mark."""
    if len(block) < BLOCK or block[257:262] != b"ustar" or block[265:297].rstrip(b"\0") != mark.encode():
        return None
    try:
        total = int(block[148:154], 8)
        size = int(block[124:135], 8)
    except ValueError:
        return None
    if total != sum(block) - sum(block[148:156]) + 8 * 32:
        return None
    return block[:100].rstrip(b"\0").decode(), size


def archive_rows(members: Iterator[tuple[str, bytes]], mark: str) -> Iterator[bytes]:
    """An archive in rows that each end before a NUL which the writer adds.

    A header ends in NULs, so rows end after a header or the end of the archive.
    """
    held = bytearray()
    for name, media in members:
        held += tar_header(name, len(media), mark)
        if len(held) >= ROW_BYTES:
            yield bytes(held[:-1])
            held.clear()
        held += media
        held += bytes(-len(media) % BLOCK)
    if held:
        held += bytes(2 * BLOCK)
        yield bytes(held[:-1])


def write_archives(
    df: DataFrame, path: str, mark: str, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Every row's text as one image; one archive per partition of ``df``.

    Members are named by the id (``null`` if it is null); null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[tuple[str, bytes]]:
            for part in sliced(batches):
                for one, raw in zip(part.column(0).to_pylist(), binaries(part.column(1)), strict=True):
                    yield "null" if one is None else str(one), to_png(padded(raw))

        for row in archive_rows(members(), mark):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["value"])

    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = arrow_map(kept, run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("compression", "none").text(path)


# ----------------------------------------------------------------- data source
class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int) -> None:
        self.path, self.start, self.end, self.size = path, start, end, size


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class ArchiveReader(DataSourceReader):
    """Options: ``path``, ``mark``, ``rangeBytes``, ``retries``, ``mode``.

    ``mode`` is ``FAILFAST`` (a member that stays unreadable fails the task) or
    ``PERMISSIVE`` (it yields a row with ``error`` set and no media).  A header
    that stays unreadable is treated alike; reading goes on at the next header.
    """

    #: Where tests put faults: called with path, offset and attempt.
    fault: Callable[[str, int, int], None] | None = None

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.mark = options["path"], options["mark"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 0)))
        self.retries = int(options.get("retries", RETRIES))
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def partitions(self) -> list[InputPartition]:
        """Byte ranges of the folder's files; file names and sizes are all that is read."""
        store, root = open_store(self.path)
        files = [
            f
            for f in store.get_file_info(fs.FileSelector(root, recursive=True))
            if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", "."))
        ]
        step = self.range_bytes or max(RANGE_BYTES, -(-sum(f.size for f in files) // MAX_RANGES))
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            for start in range(0, f.size, step):
                out.append(ByteRange(f.path, start, min(f.size, start + step), f.size))
        return out or [ByteRange("", 0, 0, 0)]

    def member(self, store: fs.FileSystem, path: str, offset: int, size: int) -> tuple[bytes | None, str | None]:
        """One member's media by its offset; each attempt opens the file anew."""
        said = ""
        for attempt in range(self.retries + 1):
            try:
                if self.fault is not None:
                    self.fault(path, offset, attempt)
                with store.open_input_file(path) as f:
                    media = f.read_at(size, offset + BLOCK)
                if len(media) != size:
                    raise ValueError("the archive ends inside the member")
                for _ in png_chunks(media):
                    pass
                return media, None
            except (OSError, ValueError, struct.error) as e:
                said = f"{type(e).__name__}: {e}"
                time.sleep(min(1.0, 0.05 * 2**attempt))
        if not self.permissive:
            raise RuntimeError(f"{path} at {offset}: {said}")
        return None, said

    def headers(self, store: fs.FileSystem, part: ByteRange) -> Iterator[tuple[int, str, int | None]]:
        """``(offset, name, size)`` of the members whose header starts in the range.

        Where a block that should be a header is not one, the size is None.
        """
        at, synced = -(-part.start // BLOCK) * BLOCK, False
        with store.open_input_file(part.path) as f:
            while at < part.end:
                if synced or at == 0:
                    got = self._header(store, f, part.path, at)
                    if got is None:
                        return  # the end of the archive
                    if got[1] is None:
                        yield at, *got
                        at, synced = at + BLOCK, False
                        continue
                else:
                    window = f.read_at(min(1 << 20, part.end - at + BLOCK), at)
                    got = None
                    for k in range(0, len(window) - BLOCK + 1, BLOCK):
                        if window[k + 257 : k + 262] == b"ustar" and (got := parse_header(window[k : k + BLOCK], self.mark)):
                            at += k
                            break
                    if got is None:
                        at += max(BLOCK, len(window) // BLOCK * BLOCK)
                        continue
                    if at >= part.end:
                        return
                synced = True
                name, size = got
                yield at, name, size
                at += BLOCK + -(-size // BLOCK) * BLOCK

    def _header(self, store: fs.FileSystem, f, path: str, at: int) -> tuple[str, int | None] | None:
        """The header at an offset, read again where it does not parse; None at the end."""
        for attempt in range(self.retries + 1):
            try:
                if attempt == 0:
                    block = f.read_at(BLOCK, at)
                else:
                    with store.open_input_file(path) as again:
                        block = again.read_at(BLOCK, at)
                if not block.strip(b"\0"):
                    return None
                got = parse_header(block, self.mark)
                if got is not None:
                    return got
            except OSError:
                pass
            time.sleep(min(1.0, 0.05 * 2**attempt))
        if not self.permissive:
            raise RuntimeError(f"{path} at {at}: no header of a member")
        return "", None

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, _ = open_store(self.path)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
            names = ["archive", "offset", "name", "media", "error"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )

        for offset, name, size in self.headers(store, partition):
            if size is None:
                rows.append((partition.path, offset, None, None, "no header of a member"))
                continue
            media, error = self.member(store, partition.path, offset, size)
            rows.append((partition.path, offset, name, media, error))
            held += size
            if held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class ArchiveSource(DataSource):
    """``spark.read.format("media_archives")`` over a folder of archives."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, mark: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").options(path=path, mark=mark, **options).load()


def media_features(members: DataFrame) -> DataFrame:
    """Digests and features of members read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            out: list[list] = [[] for _ in range(7)]
            for media in binaries(part.column(1)):
                payload = from_png(media)
                row = (
                    len(payload.rstrip(b"\xff")),  # UTF-8 holds no byte 255
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-32:]),
                    len(media),
                    hashlib.sha256(media).hexdigest(),
                    feature_of(payload),
                )
                for col, value in zip(out, row, strict=True):
                    col.append(value)
            i, s = pa.int64(), pa.string()
            columns = [pa.array(c, k) for c, k in zip(out, (i, i, s, i, i, s, s), strict=True)]
            names = [f.split()[0] for f in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return arrow_map(members.select("name", "media"), run, FEATURES)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: str) -> DataFrame:
    """Store every row's whole text as an image, read it back, describe it.

    Null text is empty; a null id stays null; repeated rows each get a member
    and a row; an empty table gives an empty result; other columns of ``df``
    are not read.  The archives lie in the folder that all executors share.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex[:31]
    path = made_path(spark, "media")
    write_archives(df, path, mark, id_col, text_col)
    out = media_features(read_archives(spark, path, mark, **options))
    one = F.when(F.col("name") != "null", F.col("name").cast("long")).alias(id_col)
    return out.select(one, *(c for c in out.columns if c != "name"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a media member, read back through the data source."""
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_media_columns": op3_media_columns}
ORACLES: dict[str, str] = {}
