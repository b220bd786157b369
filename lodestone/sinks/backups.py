"""Incremental backups of a table's files: files are kept once by what they hold, and a backup is a list of them.

A backup reads the files, keeps those whose SHA-256 no earlier backup has, and writes its manifest last, so a backup that
ends early is none. Tasks write what they keep; a file that a repeated task writes again has the same name and content.
Verifying reads the kept files and compares their hashes with their names; purging drops old manifests and then the files
that no manifest names. A backup is restored by reading its files where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file string, sha string, size long"


def _where(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _names(path: str, folder: str) -> list[str]:
    where, own = _where(f"{path}/{folder}")
    return sorted(f.base_name for f in where.get_file_info(fs.FileSelector(own, allow_not_found=True)))


def backups(path: str) -> list[int]:
    """Numbers of the backups that are whole."""
    where, own = _where(path)
    return [int(n.split("=")[1]) for n in _names(path, "manifests") if where.get_file_info(f"{own}/manifests/{n}/_SUCCESS").type != fs.FileType.NotFound]


def _manifest(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/backup={number:08d}")


def backup(spark: SparkSession, source: str, path: str) -> int:
    """Backs up the files of a folder; gives the backup's number."""
    number = max(backups(path), default=0) + 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(source)
    listed = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha"), F.col("length").alias("size"), "content")
    known = spark.createDataFrame([(n,) for n in _names(path, "files")], "sha string")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, own = _where(path)
        where.create_dir(f"{own}/files", recursive=True)
        for b in batches:
            for sha, content, seen in zip(b.column("sha").to_pylist(), b.column("content"), b.column("seen").to_pylist(), strict=True):
                if not seen:
                    with where.open_output_stream(f"{own}/files/{sha}") as out:
                        out.write(content.as_buffer())
            yield b.select(["file", "sha", "size"])

    marked = listed.join(known.withColumn("seen", F.lit(True)), "sha", "left").select("file", "sha", "size", "content", F.coalesce("seen", F.lit(False)).alias("seen"))
    marked.mapInArrow(keep, MANIFEST).write.parquet(f"{path}/manifests/backup={number:08d}")
    return number


def restore(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The rows of a backup, the last by default."""
    number = max(backups(path)) if number is None else number
    return spark.read.parquet(*[f"{path}/files/{r['sha']}" for r in _manifest(spark, path, number).select("sha").distinct().collect()])


def damaged(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(sha, found): files of a backup that are gone or do not hold what their name says."""
    there = spark.read.format("binaryFile").load(f"{path}/files").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("sha"), F.sha2("content", 256).alias("found"))
    return _manifest(spark, path, number).select("sha").distinct().join(there, "sha", "left").filter("found IS NULL OR found <> sha")


def purge(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Drops all but the newest `keep` backups, and the files that only they had; gives their numbers."""
    where, own = _where(path)
    old = backups(path)[: -keep or None]
    for n in old:
        where.delete_dir(f"{own}/manifests/backup={n:08d}")
    used = {r["sha"] for n in backups(path) for r in _manifest(spark, path, n).select("sha").distinct().collect()}  # a name a file
    for name in _names(path, "files"):
        if name not in used:
            where.delete_file(f"{own}/files/{name}")
    return old
