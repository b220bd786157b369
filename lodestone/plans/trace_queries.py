"""Queries on request traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import trace
from lodestone.plans.registry import query

WIN = """, span AS (SELECT min(ts) AS t0, greatest(1.0, (max(ts) - min(ts)) / 8.0::DOUBLE) AS width FROM v_trace),
 win AS (SELECT t.*, CAST(least(floor((ts - t0) / width), 7) AS BIGINT) AS w, width FROM t CROSS JOIN span)"""


@query("agg_trace_window", "WITH t AS (SELECT *, line_no > min(line_no) OVER (PARTITION BY key) AS seen FROM v_trace)" + WIN + """,
 s AS (SELECT w, count(*) AS requests, any_value(width) AS width, count(*) FILTER (op IN ('get', 'gets')) AS reads, count(*) FILTER (op IN ('set', 'add')) AS writes, count(*) FILTER (op IN ('set', 'add') AND seen) AS updates,
   count(*) FILTER (op IN ('set', 'add') AND key_size + value_size + 8 <= 64) AS inl, avg(value_size) FILTER (value_size > 0) AS mv, count(DISTINCT key) AS keys FROM win GROUP BY w)
 SELECT CAST(g.range AS BIGINT) AS w, coalesce(requests, 0) AS requests, round(coalesce(requests / width, 0), 6) AS throughput, round(coalesce(reads / nullif(requests, 0)::DOUBLE, 0), 6) AS read_share,
  round(coalesce(updates / nullif(writes, 0)::DOUBLE, 0), 6) AS update_intensity, round(coalesce(inl / nullif(writes, 0)::DOUBLE, 0), 6) AS inline_share, round(coalesce(mv, 0), 6) AS mean_value, coalesce(keys, 0) AS keys
 FROM range(8) g LEFT JOIN s ON s.w = g.range""")
def _(t):
    return trace.window_stats(t("v_trace"))


@query("agg_value_hist", """SELECT CASE WHEN value_size <= 64 THEN '<=64B' WHEN value_size <= 256 THEN '<=256B' WHEN value_size <= 1024 THEN '<=1KB' WHEN value_size <= 4096 THEN '<=4KB' ELSE '>4KB' END AS size_class,
 count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS share FROM v_trace WHERE value_size > 0 GROUP BY 1""")
def _(t):
    return trace.value_histogram(t("v_trace"))


@query("agg_topk_share", "WITH t AS (SELECT * FROM v_trace)" + WIN + """, p AS (SELECT w, key, count(*) AS c FROM win GROUP BY w, key), z AS (SELECT w, sum(c) AS total, greatest(1, floor(count(*) * 0.01)) AS k FROM p GROUP BY w),
 r AS (SELECT p.*, row_number() OVER (PARTITION BY w ORDER BY c DESC, key) AS r FROM p) SELECT r.w, round(sum(c) / any_value(total)::DOUBLE, 6) AS top_share FROM r JOIN z ON r.w = z.w WHERE r.r <= z.k GROUP BY r.w""")
def _(t):
    return trace.top_key_share(t("v_trace"))


@query("agg_update_intensity", "WITH s AS (SELECT *, line_no > min(line_no) OVER (PARTITION BY key) AS seen FROM v_trace) SELECT count(*) FILTER (op IN ('set', 'add')) AS writes, count(*) FILTER (op IN ('set', 'add') AND seen) AS updates, round(coalesce(count(*) FILTER (op IN ('set', 'add') AND seen) / nullif(count(*) FILTER (op IN ('set', 'add')), 0)::DOUBLE, 0), 6) AS intensity FROM s")
def _(t):
    w = F.col("op").isin(*trace.WRITES)
    return trace.seen_before(t("v_trace")).agg(F.count_if(w).alias("writes"), F.count_if(w & F.col("seen")).alias("updates")).withColumn("intensity", F.round(trace.ratio(F.col("updates"), F.col("writes")), 6))


@query("agg_trace_key", "SELECT op, key, count(*) AS accesses, count(*) FILTER (value_size > 0) AS hits, max(value_size) AS value_size, max(ts) AS last_ts FROM v_trace GROUP BY op, key")
def _(t):
    return trace.key_stats(t("v_trace"))


@query("agg_trace_cf", "SELECT op, count(*) AS n, round(avg(key_size), 6) AS key_mean, round(var_pop(key_size), 6) AS key_var, round(avg(value_size), 6) AS value_mean, round(var_pop(value_size), 6) AS value_var FROM v_trace GROUP BY op")
def _(t):
    return trace.op_stats(t("v_trace"))


@query("agg_access_count_dist", "SELECT op, accesses, count(*) AS keys FROM (SELECT op, key, count(*) AS accesses FROM v_trace GROUP BY op, key) GROUP BY op, accesses")
def _(t):
    return trace.access_count_distribution(t("v_trace"))


@query("agg_key_size_dist", "SELECT op, key_size, count(DISTINCT key) AS keys FROM v_trace GROUP BY op, key_size")
def _(t):
    return trace.key_size_distribution(t("v_trace"))


@query("agg_value_size_dist", "WITH b AS (SELECT op, value_size // 8 AS bucket, count(*) AS n FROM v_trace GROUP BY 1, 2) SELECT op, bucket, n, round(sum(n) OVER (PARTITION BY op ORDER BY bucket) / sum(n) OVER (PARTITION BY op)::DOUBLE, 6) AS running_share FROM b")
def _(t):
    return trace.value_size_distribution(t("v_trace"))


@query("agg_qps", "WITH p AS (SELECT op, ts // 3600 AS b, count(*) AS n FROM v_trace GROUP BY 1, 2), s AS (SELECT (max(ts) - min(ts)) // 3600 + 1 AS k FROM v_trace) SELECT op, CAST(sum(n) AS BIGINT) AS total, max(n) AS peak, round(sum(n) / any_value(k)::DOUBLE, 6) AS mean FROM p CROSS JOIN s GROUP BY op")
def _(t):
    return trace.qps(t("v_trace"))


@query("agg_unique_keys_time", """WITH p AS (SELECT ts // 86400 AS b, count(*) AS n FROM v_trace GROUP BY 1), f AS (SELECT b, count(*) AS fresh FROM (SELECT key, min(ts // 86400) AS b FROM v_trace GROUP BY key) GROUP BY b)
 SELECT b, CAST(keys AS BIGINT) AS keys, round(keys / req::DOUBLE, 6) AS ratio FROM (SELECT p.b, sum(coalesce(fresh, 0)) OVER (ORDER BY p.b) AS keys, sum(n) OVER (ORDER BY p.b) AS req FROM p LEFT JOIN f ON p.b = f.b)""")
def _(t):
    return trace.unique_keys_over_time(t("v_trace"))


@query("agg_prefix_cut", "SELECT substr(key, 1, 1) AS prefix, count(*) AS accesses, count(DISTINCT key) AS keys, round(count(*) / count(DISTINCT key)::DOUBLE, 6) AS mean, round(avg(CASE WHEN value_size > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS hit_share FROM v_trace GROUP BY 1")
def _(t):
    return trace.prefix_stats(t("v_trace"))


@query("agg_topk_keys", "SELECT key, count(*) AS accesses FROM v_trace GROUP BY key ORDER BY accesses DESC, key LIMIT 10")
def _(t):
    return trace.top_keys(t("v_trace"))


@query("agg_topk_prefix", "SELECT substr(key, 1, 2) AS prefix, count(*) AS accesses FROM v_trace GROUP BY 1 ORDER BY accesses DESC, prefix LIMIT 5")
def _(t):
    return trace.top_keys(t("v_trace").withColumn("key", F.substring("key", 1, 2)), 5).withColumnRenamed("key", "prefix")


@query("agg_topk_qps", "SELECT ts // 3600 AS b, count(*) AS n FROM v_trace GROUP BY 1 ORDER BY n DESC, b LIMIT 5")
def _(t):
    return trace.top_buckets(t("v_trace"))


@query("srt_topk_heap", "SELECT key, n FROM (SELECT key, op, count(*) AS n, row_number() OVER (PARTITION BY op ORDER BY count(*) DESC, key) AS r FROM v_trace GROUP BY key, op) WHERE r <= 3")
def _(t):
    from pyspark.sql import Window

    c = t("v_trace").groupBy("key", "op").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("op").orderBy(F.desc("n"), "key"))).filter("r <= 3").select("key", "n")


@query("agg_top_qps_prefix", "WITH k AS (SELECT ts // 3600 AS b, count(*) AS n FROM v_trace GROUP BY 1 ORDER BY n DESC, b LIMIT 5) SELECT ts // 3600 AS b, substr(key, 1, 1) AS prefix, count(*) AS n FROM v_trace WHERE ts // 3600 IN (SELECT b FROM k) GROUP BY 1, 2")
def _(t):
    return trace.top_bucket_prefixes(t("v_trace"))


@query("jn_trace_corr", """WITH g AS (SELECT op, ts - last_value(CASE WHEN op = 'get' THEN ts END IGNORE NULLS) OVER (PARTITION BY key ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM v_trace WHERE op IN ('get', 'set'))
 SELECT count(*) AS n, round(coalesce(avg(gap), 0), 6) AS mean_gap FROM g WHERE op = 'set' AND gap <> 0""")
def _(t):
    return trace.correlation(t("v_trace"), "get", "set")


@query("jn_whole_keyspace", "SELECT CAST(c_custkey AS VARCHAR) AS key, coalesce(n, 0) AS accesses FROM customer LEFT JOIN (SELECT key, count(*) AS n FROM v_trace GROUP BY key) k ON k.key = CAST(c_custkey AS VARCHAR)")
def _(t):
    return trace.whole_keyspace(t("customer").select(F.col("c_custkey").cast("string").alias("key")), t("v_trace"))


@query("flt_sample_ops", "SELECT op, line_no FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY line_no) AS r FROM v_trace) WHERE r % 10 = 1")
def _(t):
    return trace.sample_ops(t("v_trace"), 10).select("op", "line_no")


@query("flt_downsample_blocks", "SELECT block, count(*) AS accesses FROM v_block WHERE substr(md5(CAST(block AS VARCHAR)), 1, 1) IN ('0', '1') GROUP BY block")
def _(t):
    return t("v_block").filter(F.substring(F.md5(F.col("block").cast("string").cast("binary")), 1, 1).isin("0", "1")).groupBy("block").agg(F.count(F.lit(1)).alias("accesses"))


@query("tbl_cluster_stat", """WITH p AS (SELECT key, count(*) AS c FROM v_trace GROUP BY key), b AS (SELECT c, count(*) AS m FROM p GROUP BY c),
 k AS (SELECT c, coalesce(sum(m) OVER (ORDER BY c DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (m + 1) / 2.0::DOUBLE AS rank FROM b)
 SELECT round(sum(c) / count(*)::DOUBLE, 6) AS mean_freq, round(100 * count(*) FILTER (c = 1) / count(*)::DOUBLE, 6) AS one_hit_wonder_pct, round(100 * count(*) / sum(c)::DOUBLE, 6) AS compulsory_miss_pct,
 (SELECT round(-regr_slope(ln(c), ln(rank)), 6) FROM k) AS zipf_alpha FROM p""")
def _(t):
    return trace.cluster_stats(t("v_trace"))


@query("fn_bucket_size", "SELECT p_partkey, CASE WHEN p_size * 100 <= 64 THEN '<=64B' WHEN p_size * 100 <= 256 THEN '<=256B' WHEN p_size * 100 <= 1024 THEN '<=1KB' WHEN p_size * 100 <= 4096 THEN '<=4KB' ELSE '>4KB' END AS size_class FROM part")
def _(t):
    return t("part").select("p_partkey", trace.size_class(F.col("p_size") * 100).alias("size_class"))


@query("fn_inline_fit", "SELECT line_no, key_size + value_size + 8 <= 64 AS fits FROM v_trace")
def _(t):
    return t("v_trace").select("line_no", (F.col("key_size") + F.col("value_size") + trace.INLINE_HEADER <= trace.INLINE_LIMIT).alias("fits"))
