"""Request-trace analytics: equal-width windows, key statistics, rates, distributions, prefixes, correlations.

Inputs have the columns of a request trace: line_no, ts (s), key, key_size, value_size, op. Where a statistic needs the
order of requests, the window is over one key, never over the whole trace; where the first or greatest row of a key is
enough, it is an aggregate joined back, which combines before the shuffle and which AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READS, WRITES = ("get", "gets"), ("set", "add", "replace", "cas", "append", "prepend", "incr", "decr")
INLINE_LIMIT, INLINE_HEADER = 64, 8  # fixed values: bytes of an inline slot and of its header


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def windows(trace: DataFrame, n: int = 8) -> DataFrame:
    """Adds w: the number of the equal-width window; widths are at least 1 s. The span is a one-row broadcast."""
    span = trace.agg(F.min("ts").alias("t0"), F.greatest(F.lit(1.0), (F.max("ts") - F.min("ts")) / F.lit(float(n))).alias("width"))
    return trace.crossJoin(F.broadcast(span)).withColumn("w", F.least(F.floor((F.col("ts") - F.col("t0")) / F.col("width")), F.lit(n - 1)))


def seen_before(trace: DataFrame) -> DataFrame:
    """Adds seen: whether an earlier line has the key, by any operation."""
    first = trace.groupBy("key").agg(F.min("line_no").alias("_first"))  # combines before the shuffle, so a hot key is no task
    return trace.join(first, "key").withColumn("seen", F.col("line_no") > F.col("_first")).drop("_first")


def window_stats(trace: DataFrame, n: int = 8) -> DataFrame:
    """A row per window 0..n-1, empty ones with zeros: requests, throughput, read share, update intensity, sizes, inline share."""
    is_write, is_read = F.col("op").isin(*WRITES), F.col("op").isin(*READS)
    fits = F.col("key_size") + F.col("value_size") + INLINE_HEADER <= INLINE_LIMIT
    some = F.when(F.col("value_size") > 0, F.col("value_size"))
    # a row for each key and window: a key's first line is in the window that has its least line
    per = windows(trace, n).groupBy("key", "w").agg(
        F.count(F.lit(1)).alias("requests"), F.first("width").alias("width"), F.count_if(is_read).alias("reads"), F.count_if(is_write).alias("writes"), F.count_if(is_write & fits).alias("inline"),
        F.sum(some).alias("bytes"), F.count(some).alias("sized"), F.min("line_no").alias("line"), F.min_by(is_write, "line_no").alias("first_write"),
    )
    fresh = (F.col("line") == F.min("line").over(Window.partitionBy("key"))) & F.col("first_write")  # over at most n rows a key
    stats = per.withColumn("fresh", fresh.cast("int")).groupBy("w").agg(
        F.sum("requests").alias("requests"), F.first("width").alias("width"), F.sum("reads").alias("reads"), F.sum("writes").alias("writes"), (F.sum("writes") - F.sum("fresh")).alias("updates"),
        F.sum("inline").alias("inline"), F.try_divide(F.sum("bytes"), F.sum("sized")).alias("mean_value"), F.count(F.lit(1)).alias("keys"),
    )
    spine = trace.sparkSession.range(n).withColumnRenamed("id", "w")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return spine.join(stats, "w", "left").select(
        "w", F.coalesce("requests", F.lit(0)).alias("requests"), F.round(zero(F.col("requests") / F.col("width")), 6).alias("throughput"), F.round(ratio(F.col("reads"), F.col("requests")), 6).alias("read_share"),
        F.round(ratio(F.col("updates"), F.col("writes")), 6).alias("update_intensity"), F.round(ratio(F.col("inline"), F.col("writes")), 6).alias("inline_share"), F.round(zero(F.col("mean_value")), 6).alias("mean_value"), F.coalesce("keys", F.lit(0)).alias("keys"),
    )


def size_class(size: Column) -> Column:
    return F.when(size <= 64, "<=64B").when(size <= 256, "<=256B").when(size <= 1024, "<=1KB").when(size <= 4096, "<=4KB").otherwise(">4KB")


def value_histogram(trace: DataFrame) -> DataFrame:
    """Share of positive values by size class, rounded to 4 digits."""
    some = trace.filter("value_size > 0").groupBy(size_class(F.col("value_size")).alias("size_class")).agg(F.count(F.lit(1)).alias("n"))
    return some.select("size_class", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))


def top_key_share(trace: DataFrame, n: int = 8, top: float = 0.01) -> DataFrame:
    """Per window, the share of requests that go to the top 1 % (one at least) of its keys; keys of one count are taken together."""
    by = windows(trace, n).groupBy("w", "key").agg(F.count(F.lit(1)).alias("c")).groupBy("w", "c").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("w")  # a row per count
    before = F.coalesce(F.sum("m").over(w.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = by.select("w", "c", "m", before.alias("before"), F.sum(F.col("c") * F.col("m")).over(w).alias("total"), F.greatest(F.lit(1), F.floor(F.sum("m").over(w) * top)).alias("k"))
    taken = F.greatest(F.lit(0), F.least(F.col("m"), F.col("k") - F.col("before")))
    return r.groupBy("w").agg(F.round(F.sum(taken * F.col("c")) / F.first("total"), 6).alias("top_share"))


def key_stats(trace: DataFrame) -> DataFrame:
    """Per operation and key: accesses, accesses with a value, largest value, latest time."""
    return trace.groupBy("op", "key").agg(F.count(F.lit(1)).alias("accesses"), F.count_if(F.col("value_size") > 0).alias("hits"), F.max("value_size").alias("value_size"), F.max("ts").alias("last_ts"))


def op_stats(trace: DataFrame) -> DataFrame:
    """Per operation: mean and population variance of key and value sizes."""
    r = lambda c: F.round(c, 6)
    return trace.groupBy("op").agg(F.count(F.lit(1)).alias("n"), r(F.avg("key_size")).alias("key_mean"), r(F.var_pop("key_size")).alias("key_var"), r(F.avg("value_size")).alias("value_mean"), r(F.var_pop("value_size")).alias("value_var"))


def access_count_distribution(trace: DataFrame) -> DataFrame:
    """How many keys have each access count, per operation."""
    return key_stats(trace).groupBy("op", "accesses").agg(F.count(F.lit(1)).alias("keys"))


def key_size_distribution(trace: DataFrame) -> DataFrame:
    return trace.select("op", "key", "key_size").distinct().groupBy("op", "key_size").agg(F.count(F.lit(1)).alias("keys"))


def value_size_distribution(trace: DataFrame, interval: int = 8) -> DataFrame:
    """Accesses per value-size bucket with the running share of each operation."""
    b = trace.groupBy("op", F.floor(F.col("value_size") / interval).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("op").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("op", "bucket", "n", F.round(F.sum("n").over(run) / F.sum("n").over(Window.partitionBy("op")), 6).alias("running_share"))


def qps(trace: DataFrame, bucket: int = 3600) -> DataFrame:
    """Requests per operation: total, peak bucket, mean over the buckets of the whole trace."""
    span = trace.agg((F.floor((F.max("ts") - F.min("ts")) / bucket) + 1).alias("buckets"))
    per = trace.groupBy("op", F.floor(F.col("ts") / bucket).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("op").agg(F.sum("n").alias("total"), F.max("n").alias("peak")).crossJoin(F.broadcast(span)).select("op", "total", "peak", F.round(F.col("total") / F.col("buckets"), 6).alias("mean"))


def unique_keys_over_time(trace: DataFrame, bucket: int = 86400) -> DataFrame:
    """Distinct keys seen up to each bucket and their ratio to the requests so far."""
    per = trace.groupBy(F.floor(F.col("ts") / bucket).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    new = trace.groupBy("key").agg(F.min(F.floor(F.col("ts") / bucket)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("fresh"))
    run = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # a row per bucket, not per request
    both = per.join(new, "b", "left").select("b", F.sum(F.coalesce("fresh", F.lit(0))).over(run).alias("keys"), F.sum("n").over(run).alias("requests"))
    return both.select("b", "keys", F.round(F.col("keys") / F.col("requests"), 6).alias("ratio"))


def prefix_stats(trace: DataFrame, length: int = 1) -> DataFrame:
    """Per key prefix: accesses, keys, accesses a key, share with a value."""
    return trace.groupBy(F.substring("key", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("accesses"), F.count_distinct("key").alias("keys"), F.round(F.count(F.lit(1)) / F.count_distinct("key"), 6).alias("mean"), F.round(F.avg((F.col("value_size") > 0).cast("double")), 6).alias("hit_share"))


def top_keys(trace: DataFrame, k: int = 10) -> DataFrame:
    """The k most accessed keys; ties go to the smaller key."""
    return trace.groupBy("key").agg(F.count(F.lit(1)).alias("accesses")).orderBy(F.desc("accesses"), "key").limit(k)


def top_buckets(trace: DataFrame, k: int = 5, bucket: int = 3600) -> DataFrame:
    return trace.groupBy(F.floor(F.col("ts") / bucket).alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "b").limit(k)


def top_bucket_prefixes(trace: DataFrame, k: int = 5, bucket: int = 3600, length: int = 1) -> DataFrame:
    """Key prefixes inside the k busiest buckets."""
    peak = top_buckets(trace, k, bucket)
    own = trace.groupBy(F.floor(F.col("ts") / bucket).alias("b"), F.substring("key", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return own.join(F.broadcast(peak.select("b")), "b")


def correlation(trace: DataFrame, first: str, second: str) -> DataFrame:
    """Gaps from the last `first` operation on a key to each later `second` one on it at another time: count and mean."""
    w = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op") == first, F.col("ts")), ignorenulls=True).over(w)
    gap = trace.filter(F.col("op").isin(first, second)).withColumn("gap", F.col("ts") - last).filter((F.col("op") == second) & (F.col("gap") != 0))
    return gap.agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("gap"), F.lit(0.0)), 6).alias("mean_gap"))


def whole_keyspace(keys: DataFrame, trace: DataFrame) -> DataFrame:
    """All keys with their accesses, 0 for those never accessed."""
    hit = trace.groupBy("key").agg(F.count(F.lit(1)).alias("accesses"))
    return keys.join(hit, "key", "left").select("key", F.coalesce("accesses", F.lit(0)).alias("accesses"))


def sample_ops(trace: DataFrame, n: int, lines: int = 1_000_000) -> DataFrame:
    """One in n requests of each operation, in order of line. A line's rank is that in its range of lines, and the counts
    of the ranges before it."""
    own = trace.withColumn("_part", F.floor(F.col("line_no") / lines))
    counts = own.groupBy("op", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("op", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("op").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("op", "_part").orderBy("line_no"))
    return own.withColumn("_r", rank).join(before, ["op", "_part"]).filter((F.col("_r") + F.col("_before")) % n == 1 % n).select(*[f"`{c}`" for c in trace.columns])


def cluster_stats(trace: DataFrame) -> DataFrame:
    """Mean frequency, one-hit-wonder and compulsory-miss percent, Zipf exponent."""
    per = trace.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    by = per.groupBy("c").agg(F.count(F.lit(1)).alias("m"))  # equal counts share consecutive ranks
    after = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)
    mid = by.withColumn("rank", F.coalesce(F.sum("m").over(after), F.lit(0)) + (F.col("m") + 1) / 2)
    fit = mid.agg(F.round(-F.regr_slope(F.log("c"), F.log("rank")), 6).alias("zipf_alpha"))
    base = per.agg(F.round(F.sum("c") / F.count(F.lit(1)), 6).alias("mean_freq"), F.round(100 * F.count_if(F.col("c") == 1) / F.count(F.lit(1)), 6).alias("one_hit_wonder_pct"), F.round(100 * F.count(F.lit(1)) / F.sum("c"), 6).alias("compulsory_miss_pct"))
    return base.crossJoin(fit)
