"""Block IO traces: lines `time device address size type`, up to the first malformed one, in rounds.

A trace is a folder of files in order of their names, or one file. Spark cuts files into splits at byte offsets; the order
of lines is that of file, offset of the split, and place in it. The lines are parsed once into a written table that carries
this order, so every later step sees the same one, however splits were dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.order import numbered
from lodestone.sources import scratch

FIELDS = ["time", "device", "address", "size", "type"]
ORDER = ["file", "split", "line"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line, the fields or nulls, bad) as a written table; a line is bad if it has not five fields or one is no number."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), F.split(F.regexp_replace("value", r"\r$", ""), " ").alias("p"))
    p = F.filter("p", lambda x: x != "")
    n = [F.try_element_at(p, F.lit(i + 1)).try_cast("long").alias(c) for i, c in enumerate(FIELDS)]
    bad = (F.size(p) != len(FIELDS)) | F.exists(p, lambda x: x.try_cast("long").isNull())
    at = scratch.path(spark, "block-lines")
    raw.select("file", "split", "line", *n, bad.alias("bad")).write.parquet(at)
    return spark.read.parquet(at)


def requests(parsed: DataFrame) -> DataFrame:
    """The requests before the first bad line."""
    stop = parsed.filter("bad").agg(F.min(F.struct(*ORDER)).alias("_stop"))  # one row
    return parsed.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.struct(*ORDER) < F.col("_stop"))).drop("_stop", "bad")


def backward(reqs: DataFrame) -> DataFrame:
    """Requests that come before the one ahead of them, with its time: a healthy trace has none.

    The request ahead is in the same split, or the last of the nearest split before that has one.
    """
    own = Window.partitionBy("file", "split").orderBy("line")
    ends = reqs.groupBy("file", "split").agg(F.max_by("time", "line").alias("_end"))
    carried = F.last("_end").over(Window.orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1))  # a row a split
    carry = ends.select(F.col("file").alias("_f"), F.col("split").alias("_s"), carried.alias("_carry"))
    met = reqs.withColumn("_ahead", F.lag("time").over(own)).join(carry, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s")))
    return met.withColumn("ahead", F.coalesce("_ahead", "_carry")).filter("time < ahead").select(*reqs.columns, "ahead")


def replay(reqs: DataFrame, rounds: int = 1, percent: int = 100) -> DataFrame:
    """(round, place, fields): one round gives the first `percent` of the requests; more give all of them again and again,
    each round starting at the time at which the one before ended."""
    n = numbered(reqs, ORDER, name="place", total="_total").drop(*ORDER)
    if rounds == 1:
        return n.filter(F.col("place") < F.floor(F.col("_total") * percent / 100)).withColumn("round", F.lit(0)).drop("_total")
    last = reqs.agg(F.max_by("time", F.struct(*ORDER)).alias("_last"))  # one row
    again = n.crossJoin(F.broadcast(last)).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return again.withColumn("time", F.col("time") + F.col("round") * F.col("_last")).drop("_total", "_last")


def read(spark: SparkSession, path: str, rounds: int = 1, percent: int = 100) -> DataFrame:
    """The requests of a trace; a time that goes back raises an error when rows are read."""
    reqs = requests(lines(spark, path))
    wrong = backward(reqs).agg(F.count(F.lit(1)).alias("_wrong"))  # one row
    checked = replay(reqs, rounds, percent).crossJoin(F.broadcast(wrong))
    return checked.filter(F.when(F.col("_wrong") > 0, F.raise_error(F.lit("arrival times must not decrease")).cast("boolean")).otherwise(F.lit(True))).drop("_wrong")
