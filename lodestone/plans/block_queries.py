"""Queries on block accesses, cache simulation, histograms and device statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import blockcache as bc
from lodestone.plans.registry import query

W = "WINDOW w AS (PARTITION BY block ORDER BY ts, o1, o2, o3)"


@query("agg_block_summary", "SELECT btype, caller, level, count(*) AS n, count(DISTINCT block) AS blocks FROM v_block GROUP BY GROUPING SETS ((btype), (caller), (caller, level), (caller, btype))")
def _(t):
    return bc.summary(t("v_block"))


@query("agg_block_size", "SELECT btype, count(*) AS n, round(avg(size), 6) AS mean, round(quantile_cont(size, 0.5), 6) AS p50, round(quantile_cont(size, 0.95), 6) AS p95 FROM v_block GROUP BY btype")
def _(t):
    return bc.size_stats(t("v_block"))


@query("agg_access_count_stats", "SELECT btype, count(*) AS blocks, round(avg(c), 6) AS mean, max(c) AS most, round(stddev_pop(c), 6) AS stddev FROM (SELECT block, btype, count(*) AS c FROM v_block GROUP BY ALL) GROUP BY btype")
def _(t):
    return bc.access_count_stats(t("v_block"))


@query("agg_data_block_access", "SELECT round(avg(100 * k / 64.0::DOUBLE), 6) AS pct_keys, round(avg(100 * h), 6) AS pct_hits FROM (SELECT block, count(DISTINCT key_id) AS k, avg(is_hit) AS h FROM v_block GROUP BY block)")
def _(t):
    return bc.data_block_access(t("v_block"))


@query("agg_pct_access", "SELECT caller, round(100 * count(*) FILTER (btype = 'F') / count(*)::DOUBLE, 6) AS pct_F, round(100 * count(*) FILTER (btype = 'O') / count(*)::DOUBLE, 6) AS pct_O FROM v_block GROUP BY caller")
def _(t):
    return bc.percent_access(t("v_block"), "caller", "btype", ["F", "O"])


@query("agg_access_count_buckets", "SELECT CASE WHEN c <= 5 THEN '<=5' WHEN c <= 10 THEN '<=10' WHEN c <= 20 THEN '<=20' ELSE '>20' END AS bucket, btype, count(*) AS blocks FROM (SELECT block, btype, count(*) AS c FROM v_block GROUP BY ALL) GROUP BY ALL")
def _(t):
    return bc.count_buckets(t("v_block"), [5, 10, 20])


@query("agg_reuse_interval", f"SELECT gap, count(*) AS n FROM (SELECT ts - lag(ts) OVER w AS gap FROM v_block {W}) WHERE gap IS NOT NULL GROUP BY gap")
def _(t):
    return bc.reuse_interval(t("v_block"))


@query("agg_lifetime", "SELECT block, max(ts) - min(ts) AS lifetime FROM v_block GROUP BY block")
def _(t):
    return bc.lifetime(t("v_block"))


REUSE = """WITH a AS (SELECT block, size, row_number() OVER (ORDER BY ts, o1, o2, o3) AS p FROM v_block),
  n AS (SELECT *, lag(p) OVER w AS q, coalesce(lead(p) OVER w, 1000000000000) AS later FROM a WINDOW w AS (PARTITION BY block ORDER BY p)),
  d AS (SELECT i.p, coalesce(sum(j.size), 0) AS distance FROM n i LEFT JOIN n j ON j.p > i.q AND j.p < i.p AND j.later > i.p WHERE i.q IS NOT NULL GROUP BY i.p)
  SELECT CAST(distance // 100 AS BIGINT) AS bucket, count(*) AS n FROM d GROUP BY 1"""


@query("agg_reuse_distance", REUSE)
def _(t):
    d = bc.reuse_distance(t("v_block"))
    return d.groupBy(F.floor(F.col("distance") / 100).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_reuse_timeline", "WITH b AS (SELECT DISTINCT block, ts // 180 AS w FROM v_block), s AS (SELECT w, count(*) AS n FROM b GROUP BY w), h AS (SELECT x.w, y.w AS later, count(*) AS reused FROM b x JOIN b y ON x.block = y.block AND x.w < y.w GROUP BY ALL) SELECT h.w, later, round(reused / n::DOUBLE, 6) AS share FROM h JOIN s ON s.w = h.w")
def _(t):
    return bc.reuse_timeline(t("v_block"), 180)


@query("agg_spatial_locality", "SELECT CAST(floor(100 * k / 64.0 / 10) * 10 AS BIGINT) AS pct, count(*) AS blocks, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT block, count(DISTINCT key_id) AS k, sum(size) AS bytes FROM v_block GROUP BY block) GROUP BY 1")
def _(t):
    return bc.spatial_locality(t("v_block"))


@query("agg_correlation_feats", f"SELECT round(corr(past, until), 6) AS past_until, round(corr(since, until), 6) AS since_until FROM (SELECT row_number() OVER w - 1 AS past, ts - lag(ts) OVER w AS since, lead(ts) OVER w - ts AS until FROM v_block {W}) WHERE since IS NOT NULL AND until IS NOT NULL")
def _(t):
    return bc.correlation_features(t("v_block"))


@query("agg_skewness", "WITH c AS (SELECT block, btype, count(*) AS c FROM v_block GROUP BY ALL), r AS (SELECT c, row_number() OVER (ORDER BY c DESC) AS r, count(*) OVER () AS n, sum(c) OVER () AS total FROM c), p AS (SELECT unnest([1, 5, 10, 50])::BIGINT AS pct) SELECT pct, round(100 * coalesce(sum(c) FILTER (r <= n * pct // 100), 0) / any_value(total)::DOUBLE, 6) AS pct_accesses FROM r CROSS JOIN p GROUP BY pct")
def _(t):
    return bc.skewness(t("v_block"), [1, 5, 10, 50])


@query("agg_miss_ratio", "SELECT ts // 100 AS bucket, round(100 * avg(CASE WHEN is_hit = 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS miss_pct, CAST(sum(CASE WHEN is_hit = 0 THEN size ELSE 0 END) AS BIGINT) AS miss_bytes FROM v_block GROUP BY 1")
def _(t):
    return bc.miss_ratio(t("v_block"), 100)


@query("agg_miss_bytes", "WITH m AS (SELECT ts // 100 AS bucket, CAST(sum(CASE WHEN is_hit = 0 THEN size ELSE 0 END) AS BIGINT) AS x FROM v_block GROUP BY 1), l AS (SELECT list_sort(list(x)) AS l, avg(x) AS a FROM m) SELECT round(a, 6) AS mean, l[least(CAST(floor(0.95 * len(l)) AS BIGINT), len(l) - 1) + 1] AS p95 FROM l")
def _(t):
    return bc.miss_bytes_summary(t("v_block"), 100)


@query("win_next_access", f"SELECT block, ts, lead(ts) OVER w AS next_ts FROM v_block {W}")
def _(t):
    return bc.next_access(t("v_block")).select("block", "ts", "next_ts")


@query("sim_trace", "SELECT caller, round(avg(is_hit), 6) AS hit_ratio FROM v_block GROUP BY caller")
def _(t):
    return t("v_block").groupBy("caller").agg(F.round(F.avg("is_hit"), 6).alias("hit_ratio"))


for _n in ("lru", "arc", "gdsize", "opt", "mru", "lfu", "ghost"):
    query(f"sim_{_n}")(lambda t, n=_n: bc.simulate(t("v_block"), [(n, 5_000)]))


@query("sim_mrc")
def _(t):
    return bc.simulate(t("v_block"), [("lru", c) for c in (1_000, 5_000, 10_000, 20_000)])


_L = bc.histogram_limits()
_ROWS = ", ".join(f"({i}, {_L[i - 1] if i else 0}::DOUBLE, {x}::DOUBLE)" for i, x in enumerate(_L))
_PCT = ", ".join(f"round(arg_min(least(greatest(lo + (hi - lo) * (total * {p / 100} - (cum - n)) / n, lowest), highest), i) FILTER (cum >= total * {p / 100}), 6) AS p{p}" for p in (50, 95, 99))
_LAST = len(bc.histogram_limits()) - 1
HIST = f"""WITH l AS (SELECT * FROM (VALUES {_ROWS}) v(i, lo, hi)),
  c AS (SELECT op, i, lo, hi, count(*) AS n, min(value_size)::DOUBLE AS mn, max(value_size)::DOUBLE AS mx FROM v_trace JOIN l ON (value_size <= hi OR i = {_LAST}) AND (value_size > lo OR i = 0) GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY i) AS cum, sum(n) OVER (PARTITION BY op) AS total, min(mn) OVER (PARTITION BY op) AS lowest, max(mx) OVER (PARTITION BY op) AS highest FROM c)
  SELECT op, CAST(sum(n) AS BIGINT) AS n, {_PCT} FROM r GROUP BY op"""


@query("agg_hist_percentile", HIST)
def _(t):
    return bc.histogram_percentiles(t("v_trace").select("op", F.col("value_size").alias("v")), ["op"], [50.0, 95.0, 99.0])


@query("fn_hist_bucket", "WITH l AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, 6), (5, 6, 10), (6, 10, 15), (7, 15, 22), (8, 22, 34), (9, 34, 51)) v(i, lo, hi)) SELECT p_partkey, CAST(i AS INTEGER) AS bucket FROM part JOIN l ON p_size <= hi AND (p_size > lo OR i = 0)")
def _(t):
    limits = [x for x in bc.histogram_limits(60.0) if x <= 51]
    b = F.lit(len(limits))
    for i in range(len(limits) - 1, -1, -1):
        b = F.when(F.col("p_size") <= limits[i], F.lit(i)).otherwise(b)
    return t("part").select("p_partkey", b.alias("bucket"))


@query("agg_flow_stats", "SELECT o_orderpriority AS flow, count(*) AS requests, CAST(sum(floor(o_totalprice)) AS BIGINT) AS bytes, CAST(min(floor(o_totalprice)) AS BIGINT) AS min_latency, CAST(floor(avg(floor(o_totalprice))) AS BIGINT) AS avg_latency, CAST(max(floor(o_totalprice)) AS BIGINT) AS max_latency FROM orders GROUP BY 1")
def _(t):
    v = F.floor("o_totalprice")
    return t("orders").groupBy(F.col("o_orderpriority").alias("flow")).agg(F.count(F.lit(1)).alias("requests"), F.sum(v).alias("bytes"), F.min(v).alias("min_latency"), F.floor(F.avg(v)).alias("avg_latency"), F.max(v).alias("max_latency"))


QE = "qe AS (SELECT o_orderpriority AS q, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS ts, 1 AS delta FROM orders UNION ALL SELECT o_orderpriority, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + o_orderkey % 7 + 1, -1 FROM orders)"


@query("agg_queue_stats", f"WITH {QE}, p AS (SELECT q, ts, sum(delta) AS d, count(*) FILTER (delta > 0) AS enq, count(*) FILTER (delta < 0) AS deq FROM qe GROUP BY ALL), l AS (SELECT *, sum(d) OVER w AS len, lead(ts) OVER w - ts AS dt FROM p WINDOW w AS (PARTITION BY q ORDER BY ts)) SELECT q, CAST(sum(enq) AS BIGINT) AS enqueued, CAST(sum(deq) AS BIGINT) AS dequeued, CAST(max(len) AS BIGINT) AS max_len, round(sum(len * dt) / sum(dt)::DOUBLE, 6) AS mean_len FROM l GROUP BY q")
def _(t):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    o = t("orders").select(F.col("o_orderpriority").alias("q"), day.alias("ts"), "o_orderkey")
    e = o.select("q", "ts", F.lit(1).alias("delta")).union(o.select("q", F.col("ts") + F.col("o_orderkey") % 7 + 1, F.lit(-1)))
    return bc.queue_stats(e, "q")


@query("agg_cmt_ratio", "SELECT btype, CAST(sum(is_hit) AS BIGINT) AS hits, count(*) AS total, round(coalesce(sum(is_hit) / nullif(count(*), 0)::DOUBLE, 0), 6) AS ratio FROM v_block GROUP BY btype")
def _(t):
    return t("v_block").groupBy("btype").agg(F.sum("is_hit").alias("hits"), F.count(F.lit(1)).alias("total")).withColumn("ratio", F.round(F.col("hits") / F.col("total"), 6))


@query("agg_hot_cold", """WITH c AS (SELECT block, count(*) AS n FROM v_block GROUP BY block), b AS (SELECT n, count(*) AS m FROM c GROUP BY n), r AS (SELECT n, m, sum(m) OVER (ORDER BY n DESC) AS b1 FROM b), t AS (SELECT sum(m) AS addresses, sum(m * n) AS writes FROM b),
  g AS (SELECT k, sum(greatest(0, least(b1, k * (addresses * 0.01::DOUBLE)) - greatest(b1 - m, (k - 1) * (addresses * 0.01::DOUBLE))) * n) / any_value(writes) AS share, any_value(addresses) AS addresses FROM r, t, range(1, 101) s(k) GROUP BY k),
  s AS (SELECT coalesce(min(k) FILTER (share < 0.01), 101) AS stop FROM g), h AS (SELECT coalesce(sum(share), 0) AS r, count(*) * 0.01::DOUBLE AS f, coalesce(any_value(addresses), 0) AS addresses FROM g, s WHERE k < stop)
  SELECT round(r, 6)::DOUBLE AS write_share, round(f, 6)::DOUBLE AS address_share, addresses > 100 AND r > 0.5 AND f > 0 AND r > 2.5 * f AS is_hot FROM h""")
def _(t):
    return bc.hot_set(t("v_block").groupBy(F.col("block").alias("address")).agg(F.count(F.lit(1)).alias("n")), least=100)


@query("win_shortterm_epoch", "SELECT epoch, count(*) AS n, round(avg(v), 6) AS mean_v FROM (SELECT pos // 4 AS epoch, v FROM v_series) GROUP BY epoch")
def _(t):
    return t("v_series").groupBy(F.floor(F.col("pos") / 4).alias("epoch")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))


@query("win_hist_windowing", f"""WITH l AS (SELECT * FROM (VALUES {_ROWS}) v(i, lo, hi)),
  e AS (SELECT op, unnest([ts // 43200, ts // 43200 + 1, ts // 43200 + 2]) AS w, value_size FROM v_trace),
  c AS (SELECT op, w, i, lo, hi, count(*) AS n, min(value_size)::DOUBLE AS mn, max(value_size)::DOUBLE AS mx, sum(value_size) AS total FROM e JOIN l ON (value_size <= hi OR i = {_LAST}) AND (value_size > lo OR i = 0) GROUP BY ALL),
  r AS (SELECT *, sum(n) OVER (PARTITION BY op, w ORDER BY i) AS cum, sum(n) OVER (PARTITION BY op, w) AS total_n, min(mn) OVER (PARTITION BY op, w) AS lowest, max(mx) OVER (PARTITION BY op, w) AS highest FROM c)
  SELECT op, CAST(w AS BIGINT) AS w, CAST(sum(n) AS BIGINT) AS n, round(sum(total) / sum(n)::DOUBLE, 6) AS mean, min(mn) AS least, max(mx) AS greatest, {_PCT.replace("total", "total_n")} FROM r GROUP BY op, w""")
def _(t):
    """Percentiles over the last three half days of each operation."""
    return bc.windowed_histograms(t("v_trace").withColumn("v", F.col("value_size")), ["op"], 43200, 3, [50.0, 95.0, 99.0]).select("op", "w", "n", "mean", "least", "greatest", "p50", "p95", "p99")


LINE = "n AS (SELECT *, row_number() OVER (ORDER BY ts, o1, o2, o3, block) - 1 AS place FROM v_block), g AS (SELECT ts AS time, o3 AS device, block AS address, size, level % 2 AS type, place FROM n WHERE place < coalesce((SELECT min(place) FROM n WHERE o1 % 997 = 996 AND ts > 10900), 9223372036854775807))"


@query("src_block_io", f"WITH {LINE} SELECT CAST(r AS INTEGER) AS round, place, time + r * (SELECT arg_max(time, place) FROM g) AS time, device, address, size, type FROM g, range(2) t(r)")
def _(t):
    """A trace written in time order and read back in two rounds, up to its first malformed line."""
    from lodestone.operators.order import pieces
    from lodestone.sources import block_io
    from lodestone.sources.scratch import path

    s = lambda c: F.col(c).cast("string")
    good = F.concat_ws(" ", s("ts"), s("o3"), s("block"), s("size"), (F.col("level") % 2).cast("string"))
    by = ["ts", "o1", "o2", "o3", "block"]
    p = path(t.spark, "block-io")
    t("v_block").repartitionByRange(pieces(t("v_block")), *by).sortWithinPartitions(*by).select(F.when((F.col("o1") % 997 == 996) & (F.col("ts") > 10900), F.concat(s("ts"), F.lit(" cut"))).otherwise(good).alias("value")).write.text(p)
    return block_io.read(t.spark, p, rounds=2).select("round", "place", *block_io.FIELDS)


@query("fn_row_key", "SELECT block, key_id, CAST(block AS VARCHAR) || '_' || CAST(key_id AS VARCHAR) AS row_key, count(*) AS n FROM v_block GROUP BY ALL")
def _(t):
    return t("v_block").groupBy("block", "key_id", F.concat_ws("_", F.col("block").cast("string"), F.col("key_id").cast("string")).alias("row_key")).agg(F.count(F.lit(1)).alias("n"))


@query("dev_gc_select", "SELECT plane, block, invalid FROM (SELECT key % 8 AS plane, key AS block, count(*) FILTER (type = 'delete') AS invalid, row_number() OVER (PARTITION BY key % 8 ORDER BY count(*) FILTER (type = 'delete') DESC, key) AS r FROM v_kv GROUP BY key) WHERE r = 1")
def _(t):
    c = t("v_kv").groupBy((F.col("key") % 8).alias("plane"), F.col("key").alias("block")).agg(F.count_if(F.col("type") == "delete").alias("invalid"))
    return c.groupBy("plane").agg(F.max(F.struct("invalid", (-F.col("block")).alias("neg"))).alias("m")).select("plane", (-F.col("m.neg")).alias("block"), F.col("m.invalid").alias("invalid"))


@query("dev_mapping", "SELECT p_partkey, p_partkey % 4 AS channel, p_partkey // 4 % 2 AS way, p_partkey // 8 % 2 AS die, p_partkey // 16 % 2 AS plane FROM part")
def _(t):
    p = F.col("p_partkey")
    return t("part").select("p_partkey", (p % 4).alias("channel"), (F.floor(p / 4) % 2).alias("way"), (F.floor(p / 8) % 2).alias("die"), (F.floor(p / 16) % 2).alias("plane"))


@query("dev_chip_time", "SELECT caller, round(sum(size) FILTER (btype = 'F') / sum(size)::DOUBLE, 6) AS executing, round(sum(size) FILTER (btype = 'O') / sum(size)::DOUBLE, 6) AS transferring FROM v_block GROUP BY caller")
def _(t):
    part = lambda k: F.round(F.sum(F.when(F.col("btype") == k, F.col("size"))) / F.sum("size"), 6)
    return t("v_block").groupBy("caller").agg(part("F").alias("executing"), part("O").alias("transferring"))
