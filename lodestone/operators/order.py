"""Places in a total order, and order statistics, without a group meeting in one task.

Rows are sorted by range; the place of a row is its place in its range behind the rows of the ranges before. Only the sizes
of the ranges are summed in one place: a row for each range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import scratch


def pieces(rows: DataFrame, most: int = 1_000_000) -> int:
    """Into how many partitions rows go, so that a task's share does not grow with them."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))


def numbered(rows: DataFrame, by: list[str | Column], group: list[str] | None = None, name: str = "place", total: str | None = None) -> DataFrame:
    """Rows with their place (from 0) in the order `by` within their group, and if asked for the group's number of rows.

    The sorted rows are written once, as places must not change when a task runs again.
    """
    group = group or []
    keys = [F.col(g) for g in group] + [F.col(b) if isinstance(b, str) else b for b in by]
    at = scratch.path(rows.sparkSession, "ordered")
    rows.repartitionByRange(pieces(rows), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).write.parquet(at)
    placed = rows.sparkSession.read.parquet(at).withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range", *group).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # a row for each range
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g_{g}") for g in group], "_from", before.alias("_before"), F.sum("_n").over(whole).alias("_total"))
    same = F.col("_range") == F.col("_r")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = placed.join(sizes, same).withColumn(name, F.col("_at") - F.col("_from") + F.col("_before"))
    return out.select(*rows.columns, name, *([F.col("_total").alias(total)] if total else []))


def nth(rows: DataFrame, value: str, group: list[str], places: dict[str, Column], tie: list[str] | None = None) -> DataFrame:
    """For each group, the values at given places of its order; a place is an expression over `size`, the number of rows."""
    n = numbered(rows.select(*group, value, *(tie or [])), [value, *(tie or [])], group, "_place", "size")
    picks = [F.max(F.when(F.col("_place") == p, F.col(value))).alias(k) for k, p in places.items()]
    return n.groupBy(*group).agg(*picks, F.max("size").alias("size"))
