"""Drive health: daily collapse, gap fill, consecutive-day windows, failure joins, label windows, cohorts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_collapse(rows: DataFrame, order: list[str]) -> DataFrame:
    """(drive, day): errors summed, last written value, greatest flag, last known model, by the order of the log."""
    at = F.struct(*order)
    return rows.groupBy("drive", "day").agg(F.sum("errors").alias("errors"), F.max_by("written", at).alias("written"), F.max("flag").alias("flag"), F.max_by("model", F.when(F.col("model").isNotNull(), at)).alias("model"))


def gap_fill(daily: DataFrame) -> DataFrame:
    """Every day of each drive's span: counts and flags 0, cumulative values carried forward, a model (if there is one)
    forward and then backward. Each day fills up to the next."""
    w = Window.partitionBy("drive").orderBy("day")
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.last("wear", ignorenulls=True).over(past)
    model = [F.coalesce(F.last("model", ignorenulls=True).over(past), F.first("model", ignorenulls=True).over(future)).alias("model")] if "model" in daily.columns else []
    d = daily.select("drive", "day", "errors", "flag", known.alias("wear"), *model, F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day")).alias("till"))
    extra = ["model"] if model else []
    out = d.select("drive", F.col("day").alias("first"), "errors", "flag", "wear", *extra, F.explode(F.sequence("day", "till")).alias("day"))
    own = lambda c: F.when(F.col("day") == F.col("first"), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast(daily.schema[c].dataType).alias(c)
    return out.select("drive", "day", own("errors"), own("flag"), "wear", *extra)


def consecutive(daily: DataFrame, n: int = 30) -> DataFrame:
    """Window ends: days on which the drive has n days in a row."""
    w = Window.partitionBy("drive").orderBy("day")
    island = daily.withColumn("g", F.date_sub("day", F.row_number().over(w)))
    return island.withColumn("run", F.row_number().over(Window.partitionBy("drive", "g").orderBy("day"))).filter(F.col("run") >= n).select("drive", F.col("day").alias("window_end"))


def window_values(daily: DataFrame, n: int = 30, value: str = "errors") -> DataFrame:
    """The values of the last n days of each window end, oldest first, where all n days are there."""
    w = Window.partitionBy("drive").orderBy("day").rowsBetween(-(n - 1), 0)
    last = daily.select("drive", "day", F.collect_list(value).over(w).alias("values"), F.first("day").over(w).alias("_from"))  # n values
    return last.filter((F.size("values") == n) & (F.datediff("day", "_from") == n - 1)).drop("_from")


def flatten_window(values: DataFrame, name: str, n: int) -> DataFrame:
    """An array column as columns name_t00 .. name_t(n-1)."""
    return values.select("drive", "day", *[F.col("values")[i].alias(f"{name}_t{i:02d}") for i in range(n)])


def first_healthy(ends: DataFrame, failures: DataFrame) -> DataFrame:
    """First window of each drive that never fails."""
    return ends.join(failures, "drive", "left_anti").groupBy("drive").agg(F.min("window_end").alias("window_end"))


def last_before_failure(ends: DataFrame, failures: DataFrame, horizon: int = 30) -> DataFrame:
    """As-of join: the latest window end at most `horizon` days before the failure."""
    gap = F.datediff("fail_day", "window_end")
    near = ends.join(failures, "drive").withColumn("ttf", gap.cast("long")).filter((F.col("ttf") >= 0) & (F.col("ttf") <= horizon))
    return near.groupBy("drive").agg(F.max("window_end").alias("window_end"), F.min("ttf").alias("ttf"))


def failure_day(drives: DataFrame, minima: list[DataFrame]) -> DataFrame:
    """Earliest of several per-drive days: left joins and the least that is there."""
    joined = reduce(lambda a, b: a.join(b, "drive", "left"), minima, drives)
    return joined.select("drive", F.least(*[F.col(next(c for c in m.columns if c != "drive")) for m in minima]).alias("fail_day"))


def first_failure(rows: DataFrame, order: list[str]) -> DataFrame:
    """Earliest failure row of each drive with its model."""
    at = F.struct("day", *order)
    return rows.groupBy("drive").agg(F.min("day").alias("fail_day"), F.min_by("model", at).alias("model"))


def dealt(seed: int, key: str) -> Column:
    """A seeded place for each key, from its md5, so that any engine deals alike: 32 bits of it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def cohorts(ids: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Deals ids into cohorts of about `size` by a seeded hash; needs no global order."""
    n = max(1, -(-ids.count() // size))
    return ids.withColumn("cohort", F.pmod(dealt(seed, key), F.lit(n)))


def dedup_keep_first(rows: DataFrame, key: str, order: list[str], cohort_size: int) -> DataFrame:
    """First row per key, but all rows where the distinct keys would not fill a cohort."""
    enough = rows.select(key).distinct().limit(cohort_size).count() >= cohort_size
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r") if enough else rows


def ratio_sample(rows: DataFrame, label: str, key: str, n: int, positive: float, seed: int) -> DataFrame:
    """n rows with a share of positives, by seeded hash order; a class that is short leaves its places to the other."""
    have = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    pos = min(have.get(1, 0), max(round(n * positive), n - have.get(0, 0)))
    want = {1: pos, 0: min(have.get(0, 0), n - pos)}
    parts = [rows.filter(F.col(label) == k).orderBy(dealt(seed, key), key).limit(v) for k, v in want.items()]
    return parts[0].unionByName(parts[1])


def pair_by_position(left: DataFrame, right: DataFrame, left_key: str, right_key: str, parts: int | None = None, a_part: int = 100_000) -> DataFrame:
    """Joins rows by hash order inside hash parts of about `a_part` rows, the right side reused where it is short."""
    parts = parts or max(1, -(-left.count() // a_part))
    deal = lambda df, k: df.withColumn("_p", F.pmod(dealt(0, k), F.lit(parts))).withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(dealt(1, k), k)) - 1)
    r = deal(right, right_key)
    size = r.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    out = deal(left, left_key).join(size, "_p").withColumn("_i", F.pmod("_i", "_n"))
    return out.join(r, ["_p", "_i"]).drop("_p", "_i", "_n")
