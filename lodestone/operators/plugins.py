"""Plug points of a key log: what a user may replace, as plain functions over columns, and a compaction that calls them all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import kv


@dataclass(frozen=True)
class Plugins:
    """compare: what keys are ordered by. prefix: the part of a key that a prefix search takes. merge: how operands fold.
    filter: keep, ignore or replace, of a row (cf, key, value), and `replaced` the columns of those to replace. partition:
    rows of a family with another value of it are never in one file. properties: aggregates over the rows of each file."""

    compare: Callable[[Column], Column] = lambda key: key
    prefix: Callable[[Column], Column] = lambda key: key.cast("string")
    merge: kv.Merge = field(default_factory=lambda: kv.MERGES["put"])
    filter: Callable[[], Column] = lambda: F.lit("keep")
    replaced: dict[str, Column] = field(default_factory=dict)
    partition: Callable[[Column], Column] = lambda key: F.lit(0)
    properties: dict[str, Callable[[], Column]] = field(default_factory=dict)


def compacted(log: DataFrame, seq: list[str], plugins: Plugins) -> DataFrame:
    """(cf, key, value, file) of what a whole compaction leaves: merged, filtered, dealt to files by the partitioner."""
    rows = kv.effective(log, seq).filter("type <> 'delete'").groupBy(*kv.KEY).agg(plugins.merge.fold(seq).alias("value"))
    act = rows.withColumn("_act", plugins.filter()).filter(F.col("_act").isin("keep", "replace"))
    new = lambda c: F.when(F.col("_act") == "replace", plugins.replaced[c]).otherwise(F.col(c)).alias(c) if c in plugins.replaced else F.col(c)
    return act.select(*map(new, ["cf", "key", "value"]), plugins.partition(F.col("key")).alias("file"))


def files(rows: DataFrame, plugins: Plugins) -> DataFrame:
    """(cf, file, first, last, and each property): a file's first and last key are by the comparator."""
    by = plugins.compare(F.col("key"))
    return rows.groupBy("cf", "file").agg(F.min_by("key", by).alias("first"), F.max_by("key", by).alias("last"), *[f().alias(n) for n, f in plugins.properties.items()])


def prefixed(rows: DataFrame, prefix: str, plugins: Plugins) -> DataFrame:
    """The rows whose key has a prefix, in the comparator's order."""
    return rows.filter(plugins.prefix(F.col("key")) == prefix).orderBy("cf", plugins.compare(F.col("key")))
