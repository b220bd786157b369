"""Structured Streaming forms of the window and latest-value operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and mean value per window and type; later rows than `late` are dropped. Batch and stream alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
    return g.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


def tail(spark, path: str, schema, start: int = 0) -> DataFrame:
    """Change feed of a growing folder from a sequence number on."""
    return spark.readStream.schema(schema).parquet(path).filter(F.col("event_id") >= start)


def run_once(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Runs a stream over what is there into Parquet, and ends."""
    q = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()


def run_complete(stream: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Runs an aggregating stream over what is there, and gives its whole result after the last batch."""
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number:012d}")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = stream.sparkSession.read.schema(schema).option("basePath", sink).parquet(sink)
    last = every.agg(F.max("batch").alias("_last"))  # one row
    return every.join(F.broadcast(last), F.col("batch") == F.col("_last")).select(*schema.names)
