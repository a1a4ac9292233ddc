"""A replay of text files at a bounded number of lines per micro-batch."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pyarrow import fs


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class Lines(InputPartition):
    def __init__(self, start: dict, end: dict) -> None:
        self.start, self.end = start, end


class ReplayReader(DataSourceStreamReader):
    """Each batch takes the next ``linesPerBatch`` lines.

    Offsets are line numbers with the byte that the line begins at, so a batch
    reads its own lines and none before them.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.step = int(options.get("linesperbatch", options.get("linesPerBatch", "1000")))
        self.at = self.initialOffset()

    def _lines(self, start: int) -> Iterator[tuple[str, int]]:
        """The lines from a byte on, each with the byte after it."""
        store, path = _open(self.path)
        with store.open_input_file(path) as f:
            f.seek(start)
            rest = b""
            while block := f.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    start += len(line) + 1
                    yield line.decode("utf-8", "replace"), start
            if rest:
                yield rest.decode("utf-8", "replace"), start + len(rest)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"line": 0, "byte": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        line, byte = self.at["line"], self.at["byte"]
        for _, byte in islice(self._lines(byte), self.step):
            line += 1
        self.at = {"line": line, "byte": byte}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end, key=lambda offset: offset["line"])
        return [Lines(start, end)]

    def read(self, partition: Lines) -> Iterator[tuple[int, str]]:
        first, last = partition.start["line"], partition.end["line"]
        for k, (line, _) in enumerate(islice(self._lines(partition.start["byte"]), last - first), first):
            yield k, line

    def commit(self, end: dict) -> None:
        pass


class ReplaySource(DataSource):
    """``readStream.format("line_replay")`` with the options path and linesPerBatch."""

    @classmethod
    def name(cls) -> str:
        return "line_replay"

    def schema(self) -> str:
        return "line long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ReplayReader(dict(self.options))


def first_part(spark: SparkSession, path: str) -> str:
    """The one file of a folder that a single task has written."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return found[0].getPath().toUri().getPath() if ":" not in path else found[0].getPath().toString()


def throttled_adjacency(spark: SparkSession, path: str, lines_per_batch: int = 1000) -> DataFrame:
    """``(line, src, nbrs)`` of an adjacency file as a stream."""
    spark.dataSource.register(ReplaySource)
    lines = spark.readStream.format("line_replay").options(path=path, linesPerBatch=str(lines_per_batch)).load()
    kept = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parts = F.split("value", ":", 2)
    return kept.select(
        "line", F.trim(parts[0]).cast("long").alias("src"), F.from_json(parts[1], "array<bigint>").alias("nbrs")
    )
