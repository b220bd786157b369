"""Helpers that the training-data operators share: shared folder, written intermediate tables, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and rereads it: lineage ends there and a lost executor costs no rerun."""
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing lazy reads any more."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all intermediate tables in the shared folder; call it when no result is lazy any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, m: int):
    """crc32 of an integer column as text, modulo m: the folds of the contracts."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, or a longer one, that is none of those taken; Spark's names know no case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x if x is not None else b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Cuts record batches to so many rows, for bounded memory where texts are long."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
