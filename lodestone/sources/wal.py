"""A write-ahead log as a data source: read from a sequence number on, as a batch or as a stream.

A log is a folder of segments, each named by its first sequence number and holding the next ones without a gap. The source
`lodestone_wal` reads the segments that hold a sequence number from `start` on, in order; a stream's offsets are sequence
numbers, so a run that is started again from its checkpoint gives each change once. What is missing is an error: a start
before the oldest segment (its records are gone) or a gap between or inside segments.

Files are read by pyarrow's file systems from the path's scheme (file, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lodestone.operators.order import numbered

NAME = "lodestone_wal"
SEQ = "seq"


def append(log: DataFrame, path: str, by: list[str], segment_rows: int = 100_000) -> int:
    """Adds rows in the order `by` after what the log holds; gives the sequence number after the last."""
    first = end(path)
    rows = numbered(log, by, name="_place").withColumn(SEQ, F.col("_place") + F.lit(first)).drop("_place")
    rows = rows.withColumn("segment", F.lit(first) + F.floor((F.col(SEQ) - F.lit(first)) / segment_rows) * segment_rows)
    rows.repartition("segment").sortWithinPartitions("segment", SEQ).write.mode("append").partitionBy("segment").parquet(path)
    return end(path)


def purge(path: str, before: int) -> None:
    """Takes away the segments whose records are all before a sequence number."""
    where, _ = _where(path)
    found = segments(path)
    for (_, folder), (following, _) in zip(found, found[1:], strict=False):
        if following <= before:
            where.delete_dir(folder)


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def segments(path: str) -> list[tuple[int, str]]:
    """(first sequence number, folder) of each segment in order."""
    where, folder = _where(path)
    found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((int(f.base_name.split("=", 1)[1]), f.path) for f in found if f.base_name.startswith("segment="))


def _files(where: fs.FileSystem, folder: str) -> list[str]:
    return sorted(f.path for f in where.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet"))


def end(path: str) -> int:
    """The sequence number after the last record; 0 for no log."""
    found = segments(path)
    if not found:
        return 0
    where, _ = _where(path)
    return found[-1][0] + sum(pq.read_metadata(f, filesystem=where).num_rows for f in _files(where, found[-1][1]))


class Segment(InputPartition):
    """Records from `start` to before `stop` of the segment that begins at `first`."""

    def __init__(self, folder: str, first: int, start: int, stop: int):
        self.folder, self.first, self.start, self.stop = folder, first, start, stop


def plan(path: str, start: int, stop: int) -> list[Segment]:
    """The segments that hold sequence numbers from start to before stop."""
    if start >= stop:
        return []
    found = segments(path)
    if not found or start < found[0][0]:
        raise ValueError(f"sequence number {start} is not in the log any more")
    ends = [*(first for first, _ in found[1:]), end(path)]
    return [Segment(folder, first, max(start, first), min(stop, last)) for (first, folder), last in zip(found, ends, strict=True) if last > start and first < stop]


def records(path: str, part: Segment, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The records of a partition in order; raises on a gap."""
    where, _ = _where(path)
    table = pa.concat_tables([pq.read_table(f, filesystem=where, partitioning=None) for f in _files(where, part.folder)]).sort_by(SEQ)
    seq = table.column(SEQ)
    table = table.filter(pc.and_(pc.greater_equal(seq, part.start), pc.less(seq, part.stop)))
    found = table.column(SEQ).to_numpy()
    if len(found) != part.stop - part.start or (len(found) and (found[0] != part.start or found[-1] != part.stop - 1)):
        raise ValueError(f"gap in the log between sequence numbers {part.start} and {part.stop}")
    yield from table.select(columns).to_batches(max_chunksize=10_000)


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], start: int):
        self.path, self.columns, self.start = path, columns, start

    def partitions(self) -> list[Segment]:
        return plan(self.path, self.start, end(self.path)) or [Segment("", 0, 0, 0)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return records(self.path, partition, self.columns) if partition.folder else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str], start: int):
        self.path, self.columns, self.start = path, columns, start

    def initialOffset(self) -> dict:
        return {SEQ: self.start}

    def latestOffset(self) -> dict:
        return {SEQ: max(self.start, end(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return plan(self.path, start[SEQ], end[SEQ])

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return records(self.path, partition, self.columns)

    def commit(self, end: dict) -> None:
        pass


class WalSource(DataSource):
    """Options: path of the log, start (a sequence number, 0 if not given); the schema is given by the reader."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the schema of the log, with its column seq")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], schema.names, int(self.options.get("start", 0)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], schema.names, int(self.options.get("start", 0)))


def read(spark: SparkSession, path: str, schema, start: int = 0) -> DataFrame:
    """The records from a sequence number on."""
    spark.dataSource.register(WalSource)
    return spark.read.format(NAME).schema(schema).option("start", start).load(path)


def follow(spark: SparkSession, path: str, schema, start: int = 0) -> DataFrame:
    """The records from a sequence number on, as a stream."""
    spark.dataSource.register(WalSource)
    return spark.readStream.format(NAME).schema(schema).option("start", start).load(path)
