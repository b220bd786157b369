"""Zone maps: least and greatest value of columns for every block of every file, kept in a table beside the files.

A table is written sorted by range, so that files hold narrow ranges, and one aggregate over what was written gives a row
for each file and block. A search joins its ranges with that small table and opens only files that may hold a match; the
same filter then runs on their rows, so the result is that of the filter alone. Blocks without a value in a column have null
bounds and match no range; null values are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATA, ZONES = "data", "zones"


def write(df: DataFrame, path: str, by: list[str], columns: list[str], files: int | None = None) -> None:
    """Files in order of `by`, and the zones of `columns`."""
    (df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)).sortWithinPartitions(*by).write.parquet(f"{path}/{DATA}")
    of_files(df.sparkSession, f"{path}/{DATA}", columns).coalesce(1).write.parquet(f"{path}/{ZONES}")


def of_files(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(file, block, rows, and for each column its least, greatest and number of nulls)."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    bounds = [x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls"))]
    return rows.groupBy(F.col("_file").alias("file"), F.col("_block").alias("block")).agg(F.count(F.lit(1)).alias("rows"), *bounds)


def _overlap(ranges: dict[str, tuple]) -> tuple[Column, Column]:
    """(which zones may match, which rows match): from lo to before hi for each column, null for no bound."""
    zone, row = F.lit(True), F.lit(True)
    for c, (lo, hi) in ranges.items():
        if lo is not None:
            zone, row = zone & (F.col(f"{c}_max") >= F.lit(lo)), row & (F.col(c) >= F.lit(lo))
        if hi is not None:
            zone, row = zone & (F.col(f"{c}_min") < F.lit(hi)), row & (F.col(c) < F.lit(hi))
    return zone, row


def files_for(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> list[str]:
    """The files that may hold a row within all ranges: names only, as a scan lists them anyway."""
    return sorted(r["file"] for r in spark.read.parquet(f"{path}/{ZONES}").filter(_overlap(ranges)[0]).select("file").distinct().collect())


def read(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> DataFrame:
    """The rows within all ranges, from the files that may hold some."""
    files = files_for(spark, path, ranges)
    schema = spark.read.parquet(f"{path}/{DATA}").schema
    return spark.read.schema(schema).parquet(*files).filter(_overlap(ranges)[1]) if files else spark.createDataFrame([], schema)
