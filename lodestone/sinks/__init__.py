"""Writers: partitioned Parquet, daily CSV, run artifacts, Turtle, sorted files, versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Hive-partitioned zstd Parquet; only the partitions written are replaced."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def named(spark, path: str, by: str, ending: str, name=lambda value: value) -> None:
    """Turns folders by=value that Spark wrote under `path` into files named by their value, <value>-0 and on where a value
    has several. Only names pass through the driver."""
    from concurrent.futures import ThreadPoolExecutor
    from urllib.parse import unquote

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rename(folder) -> None:
        value = folder.getName()
        files = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda x: x.getName())
        for i, f in enumerate(files):
            own = name(unquote(value.split("=", 1)[1])) + (f"-{i}" if len(files) > 1 else "") + ending
            if not fs.rename(f, jvm.org.apache.hadoop.fs.Path(root, own)):
                raise FileExistsError(f"{own} is in {path} already")
        fs.delete(folder, True)

    with ThreadPoolExecutor(16) as pool:
        for _ in pool.map(rename, [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith(f"{by}=")]):
            pass


def daily_csv(df: DataFrame, path: str, by: str = "ds") -> None:
    """Files named by their day, 20180123.csv, the day not in the rows."""
    df.repartition(by).write.mode("append").partitionBy(by).option("header", True).csv(path)
    named(df.sparkSession, path, by, ".csv", lambda day: day.replace("-", ""))


def artifact(df: DataFrame, path: str, kind: str = "json") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)


def turtle(triples: DataFrame, path: str, by: str) -> None:
    """Triples (by, s, p, o, o_is_literal) as Turtle lines, a folder per value of `by`."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    line = F.concat_ws(" ", "s", "p", F.when(F.col("o_is_literal"), quoted).otherwise(F.col("o")), F.lit("."))
    triples.select(by, line.alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def sorted_files(df: DataFrame, path: str, key: str, files: int) -> None:
    """Range-partitioned files sorted by key, so that row groups prune by key."""
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def snapshot(df: DataFrame, path: str, seq: int) -> str:
    """A point-in-time copy by sequence number; returns its path."""
    own = f"{path}/seq={seq:020d}"
    df.write.mode("error").parquet(own)
    return own


def purge(spark, path: str, keep: int) -> list[str]:
    """Deletes all but the newest `keep` snapshots; returns what went."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = sorted((s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("seq=")), key=lambda x: x.getName())[: -keep or None]
    for x in old:
        fs.delete(x, True)
    return [x.getName() for x in old]


class _Buckets:
    """Writes rows by hash bucket of a key, and reads the one bucket that may hold a key."""

    def __call__(self, df: DataFrame, path: str, key: str, n: int) -> None:
        df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path)

    def read(self, spark, path: str, key: str, n: int, value) -> DataFrame:
        df = spark.read.parquet(path)
        own = F.pmod(F.xxhash64(F.lit(value).cast(df.schema[key].dataType)), F.lit(n)).cast("int")
        return df.filter((F.col("bucket") == own) & (F.col(key) == value)).drop("bucket")


buckets = _Buckets()


def verified(df: DataFrame, path: str, key: str, files: int) -> DataFrame:
    """Writes sorted files and reads them back checked: (file, rows, least, greatest, ordered, apart), and raises when read
    if rows or their checksum are not those of df."""
    digest = lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[c for c, k in d.dtypes if "map<" not in k]).cast("decimal(38,0)")).alias("sum"))
    sorted_files(df, path, key, files)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    same = digest(df).crossJoin(digest(back).withColumnsRenamed({"n": "n2", "sum": "sum2"}))  # one row
    at = back.select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    place = Window.partitionBy("_file").orderBy("_at")
    per = at.withColumn("_before", F.lag(key).over(place)).groupBy("_file").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest"), (F.count_if(F.col("_before") > F.col(key)) == 0).alias("ordered"))
    apart = F.coalesce(F.lag("greatest").over(Window.orderBy("least")) <= F.col("least"), F.lit(True))  # a row a file
    wrong = F.when(~(F.col("n") == F.col("n2")) | ~F.col("sum").eqNullSafe(F.col("sum2")), F.raise_error(F.lit("the files do not hold what was written")).cast("boolean")).otherwise(F.lit(True))
    return per.withColumn("apart", apart).crossJoin(F.broadcast(same)).filter(wrong).select(F.col("_file").alias("file"), "rows", "least", "greatest", "ordered", "apart")


def verified_rows(df: DataFrame, path: str, key: str, files: int) -> DataFrame:
    """The rows of sorted files, read back; raises when read if `verified` does, or a file is out of order or meets another."""
    fine = verified(df, path, key, files).agg(F.bool_and(F.col("ordered") & F.col("apart")).alias("_fine"))  # one row
    back = df.sparkSession.read.schema(df.schema).parquet(path).crossJoin(F.broadcast(fine))
    wrong = F.when(~F.col("_fine"), F.raise_error(F.lit("the files are not sorted")).cast("boolean")).otherwise(F.lit(True))
    return back.filter(wrong).drop("_fine")
