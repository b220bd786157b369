"""Statistics of numeric series: robust summary, slope, changepoint, outliers, risk, fleet aggregates.

Long form: a row per (group columns, pos, v). Null and NaN values are left out, as missing readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import order
from lodestone.sources import scratch

R = 6  # digits in results


def _r(c: Column) -> Column:
    return F.round(c, R)


def clean(series: DataFrame) -> DataFrame:
    return series.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def robust_stats(series: DataFrame, by: list[str]) -> DataFrame:
    """n, median, quartiles and outer quantiles, interquartile range, median absolute deviation, extremes per group."""
    s = clean(series)
    q = F.percentile("v", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    base = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), q.alias("q"), F.min("v").alias("min_v"), F.max("v").alias("max_v"))
    mad = s.join(base.select(*by, F.col("q")[2].alias("m")), by).groupBy(*by).agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("mad"))
    out = base.join(mad, by)
    named = [_r(F.col("q")[i]).alias(c) for i, c in enumerate(("q05", "q25", "median", "q75", "q95"))]
    return out.select(*by, "n", *named, _r(F.col("q")[3] - F.col("q")[1]).alias("iqr"), _r("mad").alias("mad"), "min_v", "max_v")


def slope(series: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares slope of v on pos; null below 3 values."""
    return clean(series).groupBy(*by).agg(_r(F.when(F.count(F.lit(1)) >= 3, F.regr_slope("v", F.col("pos").cast("double")))).alias("slope"))


def changepoint(series: DataFrame, by: list[str]) -> DataFrame:
    """Place (from 0) after the greatest absolute step, the first if tied; null below 4 values."""
    w = Window.partitionBy(*by).orderBy("pos")
    s = clean(series).withColumn("i", F.row_number().over(w) - 1).withColumn("d", F.abs(F.col("v") - F.lag("v").over(w)))
    best = F.max(F.when(F.col("d").isNotNull(), F.struct("d", (-F.col("i")).alias("neg"))))
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), best.alias("b")).select(*by, F.when(F.col("n") >= 4, (-F.col("b.neg")).cast("long")).alias("changepoint"))


def outliers(series: DataFrame, by: list[str], limit: float = 3.5) -> DataFrame:
    """Values whose robust z-score 0.6745 (v - median) / MAD exceeds the limit; 0 if MAD is 0 or below 4 values."""
    s = clean(series)
    med = s.groupBy(*by).agg(F.median("v").alias("m"), F.count(F.lit(1)).alias("n"))
    dev = s.join(med, by).withColumn("d", F.abs(F.col("v") - F.col("m")))
    mad = dev.groupBy(*by).agg(F.median("d").alias("mad"))
    far = (F.col("mad") > 0) & (F.col("n") >= 4) & (0.6745 * F.col("d") / F.col("mad") > limit)
    return dev.join(mad, by).groupBy(*by).agg(F.count_if(far).alias("outliers"))


def frames(series: DataFrame, by: list[str], limit: float = 3.5) -> DataFrame:
    """One frame per group: n, median, p95, extremes, slope, changepoint, outliers. One shuffle, by group: steps need a
    group's order anyway, so its median and deviation are windows over the same partitioning."""
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("pos")
    s = clean(series).withColumn("i", F.row_number().over(order) - 1).withColumn("step", F.abs(F.col("v") - F.lag("v").over(order)))
    s = s.withColumn("off", F.abs(F.col("v") - F.median("v").over(group))).withColumn("mad", F.median("off").over(group))
    best = F.max(F.when(F.col("step").isNotNull(), F.struct("step", (-F.col("i")).alias("neg"))))
    n, q = F.count(F.lit(1)), F.percentile("v", F.array(F.lit(0.5), F.lit(0.95)))
    far = F.count_if((F.col("mad") > 0) & (0.6745 * F.col("off") / F.col("mad") > limit))
    g = s.groupBy(*by).agg(n.alias("n"), q.alias("q"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.regr_slope("v", F.col("pos").cast("double")).alias("slope"), best.alias("b"), far.alias("far"))
    enough = F.col("n") >= 4
    return g.select(
        *by, "n", _r(F.col("q")[0]).alias("median"), _r(F.col("q")[1]).alias("p95"), "min_v", "max_v", _r(F.when(F.col("n") >= 3, F.col("slope"))).alias("slope"),
        F.when(enough, (-F.col("b.neg")).cast("long")).alias("changepoint"), F.when(enough, F.col("far")).otherwise(F.lit(0)).alias("outliers"),
    )


def risk_score(frame: DataFrame, by: list[str]) -> DataFrame:
    """Sum over signals of capped slope and outlier terms, 1 more for each changepoint."""
    part = F.least(F.lit(10.0), F.abs(F.coalesce("slope", F.lit(0.0))) * 1.5) + F.least(F.lit(10.0), F.col("outliers") * 0.75) + F.when(F.col("changepoint").isNotNull(), 1.0).otherwise(0.0)
    return frame.groupBy(*by).agg(_r(F.sum(part)).alias("risk"))


def nearest_rank(values: Column, p: float) -> Column:
    """Element of a sorted array at place round(p (n - 1)), halves to even."""
    return F.element_at(values, (F.bround(F.lit(p) * (F.size(values) - 1)) + 1).cast("int"))


def fleet_attributes(frame: DataFrame, drive: str, attribute: str, top: int = 5, parts: int = 64) -> DataFrame:
    """Per attribute over drives: count, upper median and nearest-rank p95 of the medians, slopes, outliers, changepoints, steepest drives.

    Percentiles by place come from the places of a total order, the steepest drives from the steepest of each part, so the
    drives of an attribute never meet in one task.
    """
    at = scratch.path(frame.sparkSession, "frames")  # frames are computed once
    frame.write.parquet(at)
    frame = frame.sparkSession.read.parquet(at)
    size = F.col("size")
    picks = order.nth(frame, "median", [attribute], {"median_of_medians": F.floor(size / 2), "p95_of_medians": F.bround(0.95 * (size - 1)).cast("long")}, [drive]).withColumnRenamed("size", "n_drives")
    agg = frame.groupBy(attribute).agg(_r(F.avg("slope")).alias("mean_slope"), _r(F.avg("outliers")).alias("mean_outliers"), _r(F.avg(F.col("changepoint").isNotNull().cast("double"))).alias("changepoint_share"))
    by = [F.desc(F.abs(F.coalesce("slope", F.lit(0.0)))), drive]
    some = frame.withColumn("_part", F.pmod(F.xxhash64(drive), F.lit(parts)))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy(attribute, "_part").orderBy(*by))).filter(F.col("r") <= top)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy(attribute).orderBy(*by))).filter(F.col("r") <= top)
    best = best.groupBy(attribute).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", drive))), lambda x: x[drive].cast("string")), ",").alias("top_drives"))  # at most `top` a group
    return picks.join(agg, attribute).join(best, attribute)


def top_signals(frame: DataFrame, drive: str, attribute: str, k: int = 3) -> DataFrame:
    """The k strongest attributes of each drive by risk term, ties by attribute."""
    power = F.abs(F.coalesce("slope", F.lit(0.0))) + F.col("outliers")
    w = Window.partitionBy(drive).orderBy(F.desc(power), attribute)
    return frame.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select(drive, attribute, F.col("r").cast("long").alias("r"))


def rate_change(series: DataFrame, by: list[str], width: int = 2, duration: float = 60.0, threshold: float = 50.0, percent: bool = True) -> DataFrame:
    """Bursts: change over `width` readings scaled to `duration`, as a percentage of the earlier value if asked for."""
    w = Window.partitionBy(*by).orderBy("pos")
    old, gap = F.lag("v", width).over(w), F.col("pos") - F.lag("pos", width).over(w)
    change = (F.col("v") - old) * duration / gap
    rate = F.try_divide(100 * change, old) if percent else change
    return series.select(*by, "pos", _r(rate).alias("rate")).filter(F.col("rate") >= threshold)


def unaccumulate(series: DataFrame, by: list[str]) -> DataFrame:
    """Differences of a cumulative series."""
    return series.select(*by, "pos", _r(F.col("v") - F.lag("v").over(Window.partitionBy(*by).orderBy("pos"))).alias("delta")).filter("delta is not null")


def reduce_series(series: DataFrame, by: list[str]) -> DataFrame:
    """Mean, extremes, latest and oldest value."""
    return series.groupBy(*by).agg(_r(F.avg("v")).alias("avg_v"), F.max("v").alias("max_v"), F.min("v").alias("min_v"), F.max_by("v", "pos").alias("latest"), F.min_by("v", "pos").alias("oldest"))
