"""Round trips through sinks and sources, and the operators that need files or streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone import sinks, sources, streaming
from lodestone.operators import blockcache as bc
from lodestone.operators import kv, plugins
from lodestone.plans.kv_queries import EFF
from lodestone.plans.registry import query
from lodestone.sources import wal
from lodestone.sources.scratch import path
from lodestone.streaming import state


def _lines(t, df, label):
    """Writes a text column `value` and gives the folder."""
    p = path(t.spark, label)
    df.select("value").write.text(p)
    return p


def _s(c):
    return F.col(c).cast("string")


@query("src_trace_csv", "SELECT ts, key, CAST(key_size AS INTEGER) AS key_size, CAST(value_size AS INTEGER) AS value_size, op FROM v_trace WHERE line_no % 7 <> 0")
def _(t):
    good = F.concat_ws(",", _s("ts"), "key", _s("key_size"), _s("value_size"), F.lit("c"), "op", F.lit("0"))
    lines = t("v_trace").select(F.when(F.col("line_no") % 7 == 0, F.concat_ws(",", "key", F.lit("x"))).otherwise(good).alias("value"))
    return sources.trace_csv(t.spark, _lines(t, lines, "trace")).select("ts", "key", "key_size", "value_size", "op")


@query("src_kv_rows", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def _(t):
    p = path(t.spark, "rows.jsonl")
    sinks.artifact(t("supplier").select("s_suppkey", "s_name", "s_nationkey"), p)
    return sources.rows(t.spark, p).select("s_suppkey", "s_name", "s_nationkey")


@query("src_kvpack", "SELECT s_suppkey, 'kvpack' AS source, 'KVPack' AS kv_ftl FROM supplier")
def _(t):
    lines = t("supplier").select(F.to_json(F.struct("s_suppkey", "s_name")).alias("value"))
    return sources.kvpack(t.spark, _lines(t, lines, "pack"), ["s_suppkey", "absent"]).select("s_suppkey", "source", "kv_ftl")


def _files(t, df, key, label):
    """A file for each row: text column `value`, by a short key."""
    p = path(t.spark, label)
    df.repartition(key).write.partitionBy(key).text(p)
    return p


@query("src_sim_xml", "SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey ELSE n_nationkey END AS DOUBLE) AS throughput_kops, CASE WHEN n_nationkey % 2 = 0 THEN 0.5::DOUBLE END AS gc_overhead_pct, CAST(n_regionkey + 7 AS DOUBLE) AS tail_latency_p999_us, n_name AS vendor FROM nation")
def _(t):
    """Results with nested tags, a second value that overrides, one that is missing, and a tag whose name only starts alike."""
    tag = lambda name, v: F.concat(F.lit(f"<{name}> "), v, F.lit(f" </{name}>"))
    n = t("nation").withColumn("later", F.when(F.col("n_nationkey") % 3 == 0, tag("Device_Throughput", _s("n_regionkey"))).otherwise(""))
    xml = F.concat(
        F.lit("<?xml version='1.0'?><R><Host><Flow id='1'>"), F.col("later"), tag("Device_Throughput_KOPS", _s("n_nationkey")), F.lit("</Flow><Flow id='2'>"), tag("Device_Throughput_KOPS", F.lit("-1")), F.lit("</Flow></Host>"),
        F.when(F.col("n_nationkey") % 2 == 0, tag("GC_Overhead", F.lit("0.5"))).otherwise("<GC_Overhead/>"), tag("Read_Latency_P999", F.lit("3")), tag("Tail_Latency_P999", (F.col("n_regionkey") + 7).cast("string")), tag("Device_Vendor", F.col("n_name")), F.lit("</R>"),
    )
    found = sources.sim_xml(t.spark, _files(t, n.select("n_nationkey", xml.alias("value")), "n_nationkey", "xml"))
    key = F.regexp_extract("file", r"n_nationkey=(\d+)", 1).cast("int")
    return found.select(key.alias("n_nationkey"), F.col("throughput_kops_number").alias("throughput_kops"), F.col("gc_overhead_pct_number").alias("gc_overhead_pct"), F.col("tail_latency_p999_us_number").alias("tail_latency_p999_us"), "vendor")


@query("src_kv_log", """SELECT n_nationkey, n_nationkey / 1000.0::DOUBLE AS kops, CASE WHEN n_nationkey % 2 = 0 THEN 1.5::DOUBLE END AS p50, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS DOUBLE) END AS p99,
  CASE WHEN n_nationkey % 2 = 0 THEN 9.25::DOUBLE END AS p999, CASE WHEN n_nationkey % 3 = 0 THEN 4.5::DOUBLE ELSE (n_nationkey + 10) / 4.0::DOUBLE END AS write_amplification, CAST(n_regionkey AS DOUBLE) AS read_amplification, CAST(n_nationkey + 10 AS DOUBLE) AS gb_written, 2.5::DOUBLE AS gb_read, CAST(n_regionkey AS DOUBLE) AS compact_s FROM nation""")
def _(t):
    """Logs with and without percentiles and a write amplification of their own."""
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    log = c(
        "fillrandom : 2.1 micros/op ", _s("n_nationkey"), " ops/sec; 1.0 MB/s\n** DB Stats **\nCumulative writes: 3M writes, ingest: ", (F.col("n_nationkey") + 10).cast("string"), " GB written\nCumulative reads: 7 keys, 2.5 GB read\nUser writes: 4 GB\n",
        F.when(F.col("n_nationkey") % 3 == 0, "write-amplification: 4.5\n").otherwise(""), "Read Amplification ", _s("n_regionkey"), "\nCompact(s) : ", _s("n_regionkey"), "\n",
        F.when(F.col("n_nationkey") % 2 == 0, c("Percentile table\n  50th : 1.5 us\n  99th : ", _s("n_regionkey"), " us\n  99.9th : 9.25 us\n")).otherwise("P50: 3 P99: 4\n"),
    )
    found = sources.kv_log(t.spark, _files(t, t("nation").select("n_nationkey", log.alias("value")), "n_nationkey", "log"))
    key = F.regexp_extract("file", r"n_nationkey=(\d+)", 1).cast("int")
    return found.select(key.alias("n_nationkey"), "kops", "p50", "p99", "p999", "write_amplification", "read_amplification", "gb_written", "gb_read", "compact_s")


def _by_day(t, day):
    """Orders by a day: a file for each."""
    return t("orders").select(day.alias("ds"), "o_orderkey", "o_totalprice")


@query("src_daily_csv_chunks", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def _(t):
    """Files of the first days of months, read back by the day in their names."""
    p = path(t.spark, "daily")
    sinks.daily_csv(_by_day(t, F.trunc(F.col("o_orderdate").cast("date"), "month")), p)
    return sources.daily_csv(t.spark, p, "o_orderkey long, o_totalprice double").groupBy("ds").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query("snk_daily_csv", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds FROM orders")
def _(t):
    """Every day's orders in a file of that day."""
    p = path(t.spark, "daily2")
    sinks.daily_csv(_by_day(t, F.col("o_orderdate").cast("date")), p)
    return sources.daily_csv(t.spark, p, "o_orderkey long, o_totalprice double").select("o_orderkey", "ds")


@query("src_err_log", "SELECT CAST(user_id AS VARCHAR) AS drive_id, CAST(ts AS DATE) AS day, coalesce(value, 0) AS errors, 0.0::DOUBLE AS absent FROM events")
def _(t):
    p = path(t.spark, "err")
    e = t("events").select(F.col("user_id").alias("drive_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_usec"), F.col("value").alias("errors"))
    sinks.artifact(e, p, "csv")
    return sources.error_log(t.spark, p, ["errors", "absent"])


@query("src_fio_ini", "SELECT p_name || p_partkey AS job_name, CAST(p_size AS VARCHAR) AS iodepth FROM part")
def _(t):
    ini = F.concat(F.lit("[global]\nbs=1k\n["), "p_name", _s("p_partkey"), F.lit("]\niodepth="), _s("p_size"), F.lit("\n"))
    return sources.fio_jobs(t.spark, _lines(t, t("part").select(ini.alias("value")), "fio")).select("job_name", "iodepth")


@query("src_ttl", "SELECT 'e:n' || n_nationkey AS s, 'e:in' AS p, 'e:r' || n_regionkey AS o, false AS o_is_literal FROM nation UNION ALL SELECT 'e:n' || n_nationkey, 'rdfs:label', n_name, true FROM nation")
def _(t):
    n = F.concat(F.lit("e:n"), _s("n_nationkey"))
    ttl = F.concat(n, F.lit(" e:in e:r"), _s("n_regionkey"), F.lit(' ;\n  rdfs:label "'), "n_name", F.lit('" .'))
    return sources.turtle(t.spark, _lines(t, t("nation").select(ttl.alias("value")), "ttl"))


@query("snk_ttl", "SELECT 'n' || n_nationkey AS s, 'label' AS p, n_name AS o, true AS o_is_literal FROM nation")
def _(t):
    p = path(t.spark, "ttl2")
    tr = t("nation").select(F.col("n_regionkey").alias("g"), F.concat(F.lit("n"), _s("n_nationkey")).alias("s"), F.lit("label").alias("p"), F.col("n_name").alias("o"), F.lit(True).alias("o_is_literal"))
    sinks.turtle(tr, p, "g")
    return sources.turtle(t.spark, p)


TRACES = {"src_qtrace": ("key string, type_id int, value_size long, ts long", ["key", "type_id", "value_size", "ts"]), "src_btrace": ("block long, size long, caller string, level long", ["block", "size", "caller", "level"]), "src_iotrace": ("ts long, op string, len long", ["ts", "op", "len"])}


def _text(t, name, df):
    p = path(t.spark, name)
    df.select(*TRACES[name][1]).write.csv(p)
    return sources.trace_text(t.spark, p, TRACES[name][0])


@query("src_qtrace", "SELECT key, CAST(length(op) AS INTEGER) AS type_id, value_size, ts, (ts - min(ts) OVER ()) / 4.0::DOUBLE AS due FROM v_trace")
def _(t):
    """A query trace with the times at which a replay at four times the speed runs it."""
    return sources.replayed(_text(t, "src_qtrace", t("v_trace").withColumn("type_id", F.length("op"))), "ts", 4.0)


@query("src_btrace", "SELECT block, size, caller, level FROM v_block")
def _(t):
    return _text(t, "src_btrace", t("v_block"))


@query("src_iotrace", "SELECT ts, op, value_size AS len FROM v_trace")
def _(t):
    return _text(t, "src_iotrace", t("v_trace").withColumn("len", F.col("value_size")))


@query("snk_parquet_part", "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS model, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    p = path(t.spark, "part")
    sinks.partitioned(t("orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("model")), p, ["year", "model"])
    return t.spark.read.parquet(p).groupBy("year", "model").agg(F.count(F.lit(1)).alias("n"))


@query("snk_csv_json", "SELECT c_custkey, c_name FROM customer")
def _(t):
    p = path(t.spark, "art")
    sinks.artifact(t("customer").select("c_custkey", "c_name"), p)
    return t.spark.read.schema("c_custkey long, c_name string").json(p)


@query("snk_sst", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 40 AND 90")
def _(t):
    p = path(t.spark, "sst")
    sinks.sorted_files(t("orders").select("o_orderkey", "o_totalprice"), p, "o_orderkey", 4)
    return t.spark.read.parquet(p).filter("o_orderkey between 40 and 90")


@query("snk_checkpoint", "SELECT 1 AS backup, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 2, o_orderkey, o_totalprice FROM orders")
def _(t):
    """Two backups of a table that grows between them; the second keeps only the new files."""
    from lodestone.sinks import backups

    at, to = path(t.spark, "live"), path(t.spark, "backups")
    o = t("orders").select("o_orderkey", "o_totalprice")
    o.filter("o_orderkey % 4 = 0").write.parquet(at)
    one = backups.backup(t.spark, at, to)
    o.filter("o_orderkey % 4 <> 0").write.mode("append").parquet(at)
    two = backups.backup(t.spark, at, to)
    return backups.restore(t.spark, to, one).select(F.lit(1).alias("backup"), "*").unionByName(backups.restore(t.spark, to, two).select(F.lit(2).alias("backup"), "*"))


@query("bench_report", "SELECT p_name AS name, CAST(p_size AS DOUBLE) AS ops_sec FROM part WHERE p_partkey % 5 <> 0")
def _(t):
    p = path(t.spark, "bench")
    r = t("part").select(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 5 == 0, "n/a").otherwise(_s("p_size")).alias("ops_sec"))
    r.write.option("sep", "\t").option("header", True).csv(p)
    return sources.benchmark_tsv(t.spark, p)


@query("stm_tail", "SELECT event_id, event_type FROM events WHERE event_id >= 100")
def _(t):
    src, out = path(t.spark, "feed"), path(t.spark, "feed-out")
    t("events").select("event_id", "event_type").write.parquet(src)
    streaming.run_once(streaming.tail(t.spark, src, "event_id long, event_type string", 100), out, path(t.spark, "feed-cp"))
    return t.spark.read.parquet(out)


def _events(t, label):
    """The events as a folder that grows, to be read as a stream: key, ts, ord, value, v."""
    e = t("events").select(_s("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), F.col("event_type").alias("value"), F.coalesce("value", F.lit(0.0)).alias("v"))
    p = path(t.spark, label)
    e.write.parquet(p)
    return t.spark.readStream.schema(e.schema).parquet(p)


@query("stm_ttl", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(epoch_us(max(ts)) AS BIGINT) AS at FROM events GROUP BY user_id HAVING max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def _(t):
    """Users alive at the end of a stream with a time to live of two days."""
    out = path(t.spark, "ttl-out")
    state.run(state.expiring(_events(t, "ttl"), 2 * 86400), out, path(t.spark, "ttl-cp"), 8)
    return state.alive_now(t.spark.read.schema("key string, at long, expired boolean").parquet(out))


@query("stm_state_kv", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(epoch_us(max(ts)) AS BIGINT) AS at, arg_max(event_type, row(ts, event_id)) AS value, count(*) AS n FROM events GROUP BY 1")
def _(t):
    """Newest value of each user, kept as state of a stream."""
    out = path(t.spark, "kv-out")
    state.run(state.newest(_events(t, "kv")), out, path(t.spark, "kv-cp"), 8)
    return state.newest_now(t.spark.read.schema("key string, at long, ord long, value string, n long").parquet(out))


@query("stm_late", "WITH c AS (SELECT epoch_ms(max(ts)) - 3600000 AS mark FROM events) SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events, c GROUP BY 1, 2, mark HAVING (floor(epoch(min(ts)) / 86400) + 1) * 86400000 <= mark")
def _(t):
    """Windows that a one-hour watermark closes."""
    src, out = path(t.spark, "late"), path(t.spark, "late-out")
    e = t("events")
    e.write.parquet(src)
    streaming.run_once(streaming.tumbling(t.spark.readStream.schema(e.schema).parquet(src), "1 day"), out, path(t.spark, "late-cp"))
    return t.spark.read.parquet(out)


@query("fn_fio_kv", "SELECT p_partkey, p_brand AS bs FROM part")
def _(t):
    return t("part").select("p_partkey", fn.fio_value(F.concat(F.lit("rw=read\nbs = "), "p_brand"), "bs").alias("bs"))


@query("fn_policies", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'gc=' || p_brand || '|' || trim(p_type) WHEN p_size % 3 = 1 THEN trim(p_type) END AS policies FROM part")
def _(t):
    """Lists of policies with blank entries and without any."""
    text = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(" gc="), "p_brand", F.lit(" ;; "), "p_type", F.lit(";"))).when(F.col("p_size") % 3 == 1, F.concat("p_type", F.lit(" ; "))).otherwise(" ; ")
    return t("part").select("p_partkey", F.array_join(fn.policy_list(text), "|").alias("policies"))


@query("fn_env", "SELECT event_id, CASE WHEN event_id % 3 > 0 OR event_id % 2 = 0 THEN CASE WHEN event_id % 3 > 0 THEN coalesce(CAST(user_id AS VARCHAR), '') ELSE '' END || '/' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END || '/' || CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'ENV_1' END END AS env FROM events")
def _(t):
    """Effects of the environment: blank columns left out, an id from the condition or the default."""
    e = t("events").select("event_id", F.when(F.col("event_id") % 3 > 0, _s("user_id")).otherwise(" ").alias("temperature_c"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("condition_id"))
    m = fn.section(e.columns, fn.ENVIRONMENT, ["env_id", "condition_id"], "ENV_1")
    part = lambda k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))
    return e.select("event_id", F.when(m.isNotNull(), F.concat_ws("/", part("temperature_c"), part("condition_id"), part("id"))).alias("env"))


@query("fn_flash", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN trim(p_type) || '/FT_1' END AS flash FROM part")
def _(t):
    """The flash type under any of its names."""
    p = t("part").select("p_partkey", F.when(F.col("p_size") % 2 > 0, F.concat(F.lit(" "), "p_type")).alias("ft"), F.when(F.col("p_size") % 4 == 2, F.col("p_type")).alias("FlashType"))
    p = p.withColumn("type", fn.first_alias(p.columns, ["flash_type", "ft", "FlashType"]))
    m = fn.section(p.columns, ["type"], [], "FT_1")
    return p.select("p_partkey", F.when(m.isNotNull(), F.concat_ws("/", F.element_at(m, "type"), F.element_at(m, "id"))).alias("flash"))


@query("fn_uri", "SELECT n_nationkey, 'http://x/' || replace(replace(n_name, '%', '%25'), ' ', '%20') AS uri FROM nation")
def _(t):
    return t("nation").select("n_nationkey", F.concat(F.lit("http://x/"), F.replace(F.url_encode("n_name"), F.lit("+"), F.lit("%20"))).alias("uri"))


@query("fn_table_id", "SELECT block, block // 100 AS table_id, block % 100 * 4096 AS block_offset FROM v_block")
def _(t):
    return t("v_block").select("block", F.floor(F.col("block") / 100).alias("table_id"), (F.col("block") % 100 * 4096).alias("block_offset"))


SEQ = ["day", "a", "b", "c"]


@query("kv_put", "SELECT 'N' AS cf, p_partkey AS key, p_partkey AS seq, CASE WHEN p_size % 3 = 0 THEN 'put_entity' ELSE 'put' END AS type, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS value, CASE WHEN p_size % 3 = 0 THEN p_type END AS column_type, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) END AS write_time FROM part")
def _(t):
    """Puts of plain values and of entities of several columns, every other with a write time of its own."""
    entity = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit(""), F.col("p_brand"), F.lit("type"), F.col("p_type")))
    rows = t("part").select(F.lit("N").alias("cf"), F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("value"), entity.alias("entity"), "p_size")
    log = kv.puts(rows, F.col("key"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("long")))
    return log.select("cf", "key", "seq", "type", "value", F.try_element_at("columns", F.lit("type")).alias("column_type"), "write_time")


MARKED = "mk AS (SELECT cf, key, day, a, b, c, value, CASE WHEN type = 'delete' AND c % 2 = 0 THEN 'single' ELSE type END AS type, CASE WHEN day > 9800 THEN 1 ELSE 0 END + CASE WHEN day > 10500 THEN 1 ELSE 0 END AS s FROM v_kv WHERE type <> 'merge')"
AROUND = f"{MARKED}, ar AS (SELECT *, lag(s) OVER w AS newer, lead(s) OVER w AS older, lead(type) OVER w AS next_type FROM mk WINDOW w AS (PARTITION BY cf, key ORDER BY day DESC, a DESC, b DESC, c DESC))"


def _marked(t):
    """The log with every other delete a single delete."""
    return t("v_kv").filter("type <> 'merge'").withColumn("type", F.when((F.col("type") == "delete") & (F.col("c") % 2 == 0), "single").otherwise(F.col("type")))


@query("kv_single_delete", f"WITH {AROUND} SELECT cf, key, day, a, b, c, type, value FROM ar WHERE CASE WHEN type = 'single' THEN older <> s OR (older IS NULL AND s > 0) ELSE newer IS DISTINCT FROM s AND NOT (type = 'delete' AND s = 0) END")
def _(t):
    """What a compaction under two snapshots leaves."""
    return kv.compact_single(_marked(t), SEQ, [9800, 10500], "day").select("cf", "key", *SEQ, "type", "value")


@query("kv_single_delete_mismatch", f"WITH {AROUND} SELECT cf, count(*) AS mismatches FROM ar WHERE type = 'single' AND older = s AND next_type IN ('single', 'delete') GROUP BY cf")
def _(t):
    return kv.single_mismatches(_marked(t), SEQ, [9800, 10500], "day")


@query("kv_write_batch", """WITH o AS (SELECT cf, key, day, a, b, c, value, CASE c % 9 WHEN 0 THEN 'save' WHEN 1 THEN 'rollback' WHEN 2 THEN 'pop' ELSE type END AS type FROM v_kv),
  d AS (SELECT *, sum(CASE type WHEN 'save' THEN 1 WHEN 'rollback' THEN -1 WHEN 'pop' THEN -1 ELSE 0 END) OVER (PARTITION BY cf, day ORDER BY a, b, c, key) AS d FROM o),
  l AS (SELECT *, least(0, coalesce(min(d) OVER (PARTITION BY cf, day ORDER BY a, b, c, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM d),
  p AS (SELECT *, CASE WHEN type = 'save' THEN d - low WHEN type IN ('rollback', 'pop') AND d >= low THEN d - low + 1 END AS depth FROM l),
  u AS (SELECT *, lead(type) OVER (PARTITION BY cf, day, depth ORDER BY a, b, c, key) AS taken FROM p),
  r AS (SELECT *, sum(CASE WHEN depth IS NOT NULL AND type = 'save' AND taken = 'rollback' THEN 1 WHEN depth IS NOT NULL AND type = 'rollback' THEN -1 ELSE 0 END) OVER (PARTITION BY cf, day ORDER BY a, b, c, key) AS open FROM u)
  SELECT cf, key, day, a, b, c, type, value FROM r WHERE open = 0 AND type NOT IN ('save', 'rollback', 'pop')""")
def _(t):
    """Writes of each family and day that outlive the batch's nested savepoints."""
    mark = F.when(F.col("c") % 9 == 0, "save").when(F.col("c") % 9 == 1, "rollback").when(F.col("c") % 9 == 2, "pop").otherwise(F.col("type"))
    return kv.batch_survivors(t("v_kv").withColumn("type", mark), ["cf", "day"], ["a", "b", "c", "key"]).select("cf", "key", *SEQ, "type", "value")


@query("kv_get_entity", "SELECT key, string_agg(cf || '=' || value, ';' ORDER BY cf) AS entity FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY day DESC, a DESC, b DESC, c DESC) AS r FROM v_kv) WHERE r = 1 AND type <> 'delete' GROUP BY key")
def _(t):
    rows = kv.resolve(t("v_kv"), SEQ)
    return kv.attribute_groups(rows).withColumnRenamed("groups", "entity")


@query("cli_idump", "SELECT type, day // 365 AS bucket, count(*) AS n FROM v_kv GROUP BY ALL")
def _(t):
    return t("v_kv").groupBy("type", F.floor(F.col("day") / 365).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("udf_registry", f"WITH {EFF} SELECT cf, key, min(value) AS value FROM ef WHERE type <> 'delete' GROUP BY cf, key")
def _(t):
    """A merge operator registered by name: the least operand."""
    return kv.merged(t("v_kv"), SEQ, "min", merges=kv.MERGES.register("min", lambda seq: F.min("value")))


def _plugins():
    return plugins.Plugins(
        compare=lambda key: -key, prefix=lambda key: F.substring(key.cast("string"), 1, 1), merge=kv.Merge(lambda seq: F.min("value")),
        filter=lambda: F.when(F.col("key") % 10 == 0, "ignore").when(F.col("value") > 20, "replace").otherwise("keep"), replaced={"value": F.lit(20).cast("long")},
        partition=lambda key: F.floor(key / 250), properties={"entries": lambda: F.count(F.lit(1)), "total": lambda: F.sum("value")},
    )


LEAST = f"WITH {EFF}, mg AS (SELECT cf, key, least(min(value), 20) AS value FROM ef WHERE type <> 'delete' AND key % 10 <> 0 GROUP BY cf, key)"


@query("udf_plugins", f"{LEAST} SELECT cf, key // 250 AS file, max(key) AS first, min(key) AS last, count(*) AS entries, CAST(sum(value) AS BIGINT) AS total FROM mg GROUP BY ALL")
def _(t):
    """Files of a compaction with a comparator, merge, filter, partitioner and properties of the user's."""
    return plugins.files(plugins.compacted(t("v_kv"), SEQ, _plugins()), _plugins())


@query("udf_prefix", f"{LEAST} SELECT cf, key, value FROM mg WHERE CAST(key AS VARCHAR) LIKE '7%'")
def _(t):
    """The keys of a prefix by the user's extractor, in the user's order."""
    return plugins.prefixed(plugins.compacted(t("v_kv"), SEQ, _plugins()), "7", _plugins()).select("cf", "key", "value")


for _name in ("hyperbolic", "costclass", "ts", "linucb", "hybrid", "priority"):
    query(f"sim_{_name}")(lambda t, n=_name: bc.simulate(t("v_block"), [(n, 5_000)]))


@query("src_wal_tail", "SELECT seq, cf, key, type, value FROM (SELECT *, row_number() OVER (ORDER BY day, a, b, c, cf, key) - 1 AS seq FROM v_kv) WHERE seq >= 3 * (SELECT count(*) FROM v_kv) // 4")
def _(t):
    """The last quarter of a log, read from a sequence number on."""
    p = path(t.spark, "wal")
    after = wal.append(t("v_kv"), p, [*SEQ, "cf", "key"], 10_000)
    return wal.read(t.spark, p, "seq long, cf string, key long, type string, value long", 3 * after // 4)
