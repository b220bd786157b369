"""Queries on the versioned key log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import kv
from lodestone.plans.registry import query

SEQ = ["day", "a", "b", "c"]
DESC = "day DESC, a DESC, b DESC, c DESC"
NEW = f"nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY {DESC}) AS r FROM v_kv) WHERE r = 1)"
RES = f"{NEW}, rs AS (SELECT cf, key, value FROM nw WHERE type <> 'delete')"
EFF = "ef0 AS (SELECT *, max(CASE WHEN type <> 'merge' THEN row(day, a, b, c) END) OVER (PARTITION BY cf, key) AS base FROM v_kv), ef AS (SELECT * FROM ef0 WHERE base IS NULL OR row(day, a, b, c) >= base)"


def _log(t):
    return t("v_kv")


@query("win_version_resolve", f"WITH {RES} SELECT * FROM rs")
def _(t):
    return kv.resolve(_log(t), SEQ)


@query("flt_snapshot", f"SELECT cf, key, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY {DESC}) AS r FROM v_kv WHERE day <= 9800) WHERE r = 1 AND type <> 'delete'")
def _(t):
    return kv.resolve(kv.visible(_log(t), "day", 9800), SEQ)


for _name, _sql in {"add": "CAST(sum(value) AS BIGINT)", "max": "max(CAST(value AS VARCHAR))", "xor": "bit_xor(value)", "put": "arg_max(value, row(day, a, b, c))", "append": "string_agg(CAST(value AS VARCHAR), ',' ORDER BY day, a, b, c)"}.items():
    _q = {"add": "mrg_add64", "max": "mrg_max", "xor": "mrg_xor", "put": "mrg_put", "append": "mrg_append"}[_name]
    query(_q, f"WITH {EFF} SELECT cf, key, {_sql} AS value FROM ef WHERE type <> 'delete' GROUP BY cf, key")(lambda t, op=_name: kv.merged(_log(t) if op != "max" else _log(t).withColumn("value", F.col("value").cast("string")), SEQ, op))  # the greatest by byte


@query("mrg_sortlist", f"WITH {EFF} SELECT cf, key, string_agg(CAST(value AS VARCHAR), ',' ORDER BY value) AS value FROM ef WHERE type = 'merge' GROUP BY cf, key")
def _(t):
    return kv.merged(_log(t), SEQ, "sortlist", with_base=False)


@query("mrg_base_rules", f"WITH {EFF} SELECT cf, key, count(*) FILTER (type = 'merge') AS operands, count(*) FILTER (type = 'put') AS bases, count(*) FILTER (type = 'delete') AS cuts FROM ef GROUP BY cf, key")
def _(t):
    c = lambda k: F.count_if(F.col("type") == k)
    return kv.effective(_log(t), SEQ).groupBy("cf", "key").agg(c("merge").alias("operands"), c("put").alias("bases"), c("delete").alias("cuts"))


@query("mrg_agg_named", """WITH RECURSIVE o AS (SELECT cf, key, value::DOUBLE AS v, CASE b % 3 WHEN 0 THEN 'sum' WHEN 1 THEN 'max' ELSE 'last' END AS f, row_number() OVER (PARTITION BY cf, key ORDER BY day, a, b, c) AS i FROM v_kv),
  s AS (SELECT cf, key, i, v FROM o WHERE i = 1 UNION ALL SELECT o.cf, o.key, o.i, CASE o.f WHEN 'sum' THEN s.v + o.v WHEN 'max' THEN greatest(s.v, o.v) ELSE o.v END FROM s JOIN o ON o.cf = s.cf AND o.key = s.key AND o.i = s.i + 1)
  SELECT cf, key, arg_max(v, i) AS value FROM s GROUP BY cf, key""")
def _(t):
    f = F.when(F.col("b") % 3 == 0, "sum").when(F.col("b") % 3 == 1, "max").otherwise("last")
    return kv.agg_named(_log(t).withColumn("func", f), SEQ)


@query("mrg_cassandra", "SELECT cf, key, col, value FROM (SELECT cf, key, b % 3 AS col, arg_max(value, row(day, a, b, c)) AS value, arg_max(type, row(day, a, b, c)) AS type, arg_max(day, row(day, a, b, c)) AS day FROM v_kv GROUP BY ALL) WHERE type <> 'delete' AND day + 2000 >= 11000")
def _(t):
    at = F.struct(*SEQ)
    rows = _log(t).withColumn("col", F.col("b") % 3).groupBy("cf", "key", "col").agg(F.max_by("value", at).alias("value"), F.max_by("type", at).alias("type"), F.max_by("day", at).alias("day"))
    return kv.alive(rows.filter("type <> 'delete'"), 2000, 11000, "day").select("cf", "key", "col", "value")


@query("kv_get_merge_operands", f"WITH {EFF} SELECT cf, key, string_agg(CAST(value AS VARCHAR), ',' ORDER BY day, a, b, c) AS operands, count(*) AS n FROM ef WHERE type <> 'delete' GROUP BY cf, key")
def _(t):
    return kv.merge_operands(_log(t), SEQ)


@query("kv_get", f"WITH {RES} SELECT * FROM rs WHERE cf = 'O' AND key = 2")
def _(t):
    return kv.resolve(_log(t).filter("cf = 'O' and key = 2"), SEQ)


@query("kv_multiget", f"WITH {RES} SELECT * FROM rs WHERE key % 100 = 7")
def _(t):
    keys = t("part").filter("p_partkey % 100 = 7").select(F.explode(F.array(F.lit("O"), F.lit("F"))).alias("cf"), F.col("p_partkey").alias("key"))
    return kv.multi_get(_log(t), keys, SEQ)


@query("kv_delete", f"WITH {NEW} SELECT cf, count(*) FILTER (type = 'delete') AS hidden, count(*) FILTER (type <> 'delete') AS alive FROM nw GROUP BY cf")
def _(t):
    n = kv.newest(_log(t), SEQ)
    return n.groupBy("cf").agg(F.count_if(F.col("type") == "delete").alias("hidden"), F.count_if(F.col("type") != "delete").alias("alive"))


RD = "d AS (SELECT cf, min(key) AS lo, max(key) // 8 + min(key) + 1 AS hi, day AS seq FROM v_kv WHERE day % 100 = 0 GROUP BY cf, day)"


@query("jn_rangedel", f"WITH {RD} SELECT cf, key, day, a, b, c FROM v_kv v WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.cf = v.cf AND v.key >= d.lo AND v.key < d.hi AND d.seq > v.day)")
def _(t):
    v = _log(t)
    d = v.filter("day % 100 = 0").groupBy("cf", "day").agg(F.min("key").alias("lo"), (F.floor(F.max("key") / 8) + F.min("key") + 1).alias("hi")).withColumnRenamed("day", "seq")
    return kv.range_deleted(v, d, "day").select("cf", "key", *SEQ)


@query("kv_delete_range", f"WITH {RD} SELECT cf, count(*) AS kept FROM v_kv v WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.cf = v.cf AND v.key >= d.lo AND v.key < d.hi AND d.seq > v.day) GROUP BY cf")
def _(t):
    v = _log(t)
    d = v.filter("day % 100 = 0").groupBy("cf", "day").agg(F.min("key").alias("lo"), (F.floor(F.max("key") / 8) + F.min("key") + 1).alias("hi")).withColumnRenamed("day", "seq")
    return kv.range_deleted(v, d, "day", few=0).groupBy("cf").agg(F.count(F.lit(1)).alias("kept"))


@query("flt_ttl", "SELECT cf, key, day FROM v_kv WHERE NOT (1000 > 0 AND day + 1000 < 11000)")
def _(t):
    return kv.alive(_log(t), 1000, 11000, "day").select("cf", "key", "day")


@query("kv_compact", f"SELECT cf, key, stripe, type, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, key, stripe ORDER BY {DESC}) AS r FROM (SELECT *, (CASE WHEN day > 9800 THEN 1 ELSE 0 END + CASE WHEN day > 10500 THEN 1 ELSE 0 END)::BIGINT AS stripe FROM v_kv)) WHERE r = 1 AND NOT (stripe = 0 AND type = 'delete')")
def _(t):
    return kv.compact(_log(t), SEQ, [9800, 10500], "day").select("cf", "key", "stripe", "type", "value")


@query("kv_trim_history", "SELECT cf, key, day, a, b, c FROM v_kv WHERE day <= 9500")
def _(t):
    return kv.visible(_log(t), "day", 9500).select("cf", "key", *SEQ)


@query("kv_props", "SELECT cf, count(*) AS entries, count(*) FILTER (type = 'delete') AS deletions, min(key) AS lo, max(key) AS hi FROM v_kv GROUP BY cf")
def _(t):
    return _log(t).groupBy("cf").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("type") == "delete").alias("deletions"), F.min("key").alias("lo"), F.max("key").alias("hi"))


@query("cli_approx_size", "SELECT CAST(sum(length(CAST(key AS VARCHAR)) + length(CAST(value AS VARCHAR))) AS BIGINT) AS bytes FROM v_kv WHERE key >= 100 AND key < 300")
def _(t):
    size = lambda c: F.length(F.col(c).cast("string")).cast("long")
    return _log(t).filter("key >= 100 and key < 300").agg(F.sum(size("key") + size("value")).alias("bytes"))


@query("jn_merge_iter", f"WITH u AS (SELECT * FROM v_kv WHERE b <= 3 UNION ALL SELECT * FROM v_kv WHERE b > 3) SELECT cf, key, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY {DESC}) AS r FROM u) WHERE r = 1")
def _(t):
    return kv.newest(_log(t).filter("b <= 3").unionByName(_log(t).filter("b > 3")), SEQ).select("cf", "key", "value")


@query("jn_coalesce_cf", f"WITH {RES}, x AS (SELECT key, CAST(key % 2 AS VARCHAR) AS col, value, CASE cf WHEN 'O' THEN 1 ELSE 2 END AS o FROM rs) SELECT key, col, arg_max(value, o) AS value FROM x GROUP BY key, col")
def _(t):
    return kv.coalesce_families(kv.resolve(_log(t), SEQ).withColumn("col", (F.col("key") % 2).cast("string")), ["O", "F"])


@query("jn_attr_groups", f"WITH {RES} SELECT key, string_agg(cf || '=' || value, ';' ORDER BY cf) AS groups FROM rs GROUP BY key")
def _(t):
    return kv.attribute_groups(kv.resolve(_log(t), SEQ))


@query("jn_batch_db", f"WITH u AS (SELECT *, CASE WHEN b = 7 THEN 1 ELSE 0 END AS layer FROM v_kv) SELECT cf, key, value FROM (SELECT *, row_number() OVER (PARTITION BY cf, key ORDER BY layer DESC, {DESC}) AS r FROM u) WHERE r = 1 AND type <> 'delete'")
def _(t):
    return kv.overlay(_log(t).filter("b <> 7"), _log(t).filter("b = 7"), SEQ)


@query("jn_secondary", f"WITH {RES} SELECT cf, key, value FROM rs WHERE value IN (10, 20, 30)")
def _(t):
    r = kv.resolve(_log(t), SEQ)
    wanted = t.spark.createDataFrame([(10,), (20,), (30,)], "value long")
    return r.join(F.broadcast(wanted), "value").select("cf", "key", "value")


@query("idx_simple", f"WITH {RES} SELECT value, count(*) AS keys FROM rs GROUP BY value")
def _(t):
    return kv.resolve(_log(t), SEQ).groupBy("value").agg(F.count(F.lit(1)).alias("keys"))


VEC = "ok AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings)"
DIST = "round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE))), 6) AS dist"


@query("jn_knn", f"WITH {VEC}, s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, {DIST} FROM ok q JOIN ok c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0) SELECT query_id, vec_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, vec_id) AS r FROM s) WHERE r <= 10")
def _(t):
    from lodestone.operators import vector

    rows = vector.numbered(t("embeddings"))
    return vector.knn(rows, rows.filter("id % 20 = 0"), 10)


LISTS, PROBES, ROUNDS, DIMS = 16, 12, 3, 64  # the given vectors hardly cluster: with 8 probes recall is 0.78, with 12 0.94


def _ivf_sql() -> str:
    """Lloyd rounds one after the other, then the probed lists."""
    a = f"DOUBLE[{DIMS}]"
    far = "array_inner_product(x, x) - 2 * array_inner_product(x, c) + array_inner_product(c, c)"
    sql = f"WITH {VEC}, x AS MATERIALIZED (SELECT rid, vec_id, embedding, CAST(list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)) AS {a}) AS x FROM ok), "
    sql += f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id, x) - 1 AS k, x AS c FROM x ORDER BY k LIMIT {LISTS})"
    for i in range(ROUNDS):
        sql += f""", n{i} AS (SELECT rid, CAST(min([{far}, k])[2] AS BIGINT) AS k FROM x, c{i} GROUP BY rid),
          m{i} AS (SELECT n.k, j, floor(sum(x[j]) / count(*)) AS c FROM n{i} n JOIN x USING (rid), range(1, {DIMS + 1}) t(j) GROUP BY n.k, j),
          c{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(l.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT k, CAST(list(c ORDER BY j) AS {a}) AS c FROM m{i} GROUP BY k) l ON o.k = l.k)"""
    return (
        sql
        + f""", d AS (SELECT rid, vec_id, embedding, k, row_number() OVER (PARTITION BY rid ORDER BY {far}, k) AS p FROM x, c{ROUNDS}),
          s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, {DIST} FROM d q JOIN d c ON q.k = c.k AND q.rid <> c.rid WHERE q.p <= {PROBES} AND c.p = 1 AND q.vec_id % 20 = 0)
          SELECT query_id, vec_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dist, vec_id) AS r FROM s) WHERE r <= 10"""
    )


@query("idx_ivf", _ivf_sql())
def _(t):
    from lodestone.operators import vector

    rows = vector.numbered(t("embeddings"))
    return vector.InvertedFile(rows, LISTS, ROUNDS).search(rows.filter("id % 20 = 0"), 10, PROBES)


@query("fn_l2", "SELECT label, round(avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm2 FROM embeddings GROUP BY label")
def _(t):
    return t("embeddings").groupBy("label").agg(F.round(F.avg(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 6).alias("norm2"))


@query("srt_key_order", f"WITH {RES} SELECT key, value FROM rs WHERE cf = 'F' ORDER BY key DESC LIMIT 50")
def _(t):
    return kv.scan(kv.resolve(_log(t).filter("cf = 'F'"), SEQ).select("key", "value"), limit=50, reverse=True)


@query("srt_seek", f"WITH {RES} SELECT key, value FROM rs WHERE cf = 'O' AND key >= 100 ORDER BY key LIMIT 10")
def _(t):
    return kv.seek(kv.resolve(_log(t).filter("cf = 'O' and key >= 100"), SEQ).select("key", "value"), 100, 10)


@query("srt_seek_for_prev", f"WITH {RES} SELECT key, value FROM rs WHERE cf = 'O' AND key <= 100 ORDER BY key DESC LIMIT 10")
def _(t):
    return kv.seek(kv.resolve(_log(t).filter("cf = 'O' and key <= 100"), SEQ).select("key", "value"), 100, 10, backward=True)


@query("srt_limit_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def _(t):
    return t("orders").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey")


@query("srt_multiscan", f"WITH {RES}, g AS (SELECT * FROM (VALUES (1, 10, 20), (2, 50, 55), (3, 100, 140)) v(range_id, lo, hi)) SELECT CAST(range_id AS BIGINT) AS range_id, key, value FROM rs JOIN g ON key >= lo AND key < hi WHERE cf = 'O'")
def _(t):
    ranges = t.spark.createDataFrame([(1, 10, 20), (2, 50, 55), (3, 100, 140)], "range_id long, lo long, hi long")
    return kv.multi_scan(kv.resolve(_log(t).filter("cf = 'O'"), SEQ), ranges)


ORDERS = {"by_key": "cf, key, {d}", "by_key_reverse": "cf DESC, key DESC, {d}", "by_text": "cf, CAST(key AS VARCHAR), {d}"}


@query("srt_comparators", "WITH " + ", ".join(f"o{i} AS (SELECT '{k}' AS comparator, cf, key, day, value, row_number() OVER (ORDER BY {v.format(d=DESC)}) - 1 AS place FROM v_kv)" for i, (k, v) in enumerate(ORDERS.items())) + " SELECT * FROM o0 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2")
def _(t):
    """Every version's place under each comparator: keys ascending, descending, and by their bytes as text; newest first."""
    from lodestone.operators.order import numbered

    new = [F.desc(s) for s in SEQ]
    by = {"by_key": ["cf", "key"], "by_key_reverse": [F.desc("cf"), F.desc("key")], "by_text": ["cf", F.col("key").cast("string")]}
    each = [numbered(_log(t), [*o, *new]).select(F.lit(name).alias("comparator"), "cf", "key", "day", "value", "place") for name, o in by.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("flt_key_range", "SELECT cf, key, value FROM v_kv WHERE key >= 500 AND key < 520")
def _(t):
    return _log(t).filter("key >= 500 and key < 520").select("cf", "key", "value")


@query("cli_scan", f"WITH {RES} SELECT cf, key, value FROM rs WHERE cf = 'O' AND key >= 20 AND key < 400 ORDER BY key LIMIT 30")
def _(t):
    return kv.scan(kv.resolve(_log(t).filter("cf = 'O'"), SEQ), 20, 400, 30)


@query("flt_prefix", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%'")
def _(t):
    return t("part").filter(F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_brand")


@query("flt_key_may_exist", "SELECT cf, key, day, a, b, c FROM v_kv WHERE key IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def _(t):
    """Versions of the keys of a set: a filter of the set first, then the exact join on what it lets through."""
    from lodestone.operators import bloom

    return bloom.semi_join(_log(t), t("part").filter("p_size < 10").select(F.col("p_partkey").alias("key")), "key").select("cf", "key", *SEQ)


@query("flt_sst_query_filter", "SELECT cf, key, day, a, b, c, value FROM v_kv WHERE key >= 40 AND key < 60 AND day >= 9500")
def _(t):
    """A range of keys read through the zone maps of sorted files."""
    from lodestone.sources import zones
    from lodestone.sources.scratch import path

    p = path(t.spark, "zoned")
    zones.write(_log(t), p, ["key", "day"], ["key", "day"], files=16)
    return zones.read(t.spark, p, {"key": (40, 60), "day": (9500, None)}).select("cf", "key", *SEQ, "value")


@query("flt_compaction", f"WITH {RES} SELECT cf, key, CASE WHEN value > 40 THEN 40 ELSE value END AS value FROM rs WHERE key % 10 <> 0")
def _(t):
    return kv.resolve(_log(t), SEQ).filter("key % 10 <> 0").withColumn("value", F.when(F.col("value") > 40, F.lit(40).cast("long")).otherwise(F.col("value")))


@query("flt_remove_empty", "SELECT doc_id FROM documents WHERE length(text) > 0")
def _(t):
    return t("documents").filter(F.length("text") > 0).select("doc_id")


@query("flt_layered", f"WITH {RES} SELECT cf, key, value FROM rs WHERE value > 0 AND key % 3 = 0")
def _(t):
    return kv.resolve(_log(t), SEQ).filter("value > 0").filter("key % 3 = 0")


@query("flt_wal", "WITH n AS (SELECT *, row_number() OVER (ORDER BY day, a, b, c, cf, key) - 1 AS seq FROM v_kv), s AS (SELECT min(seq) AS stop FROM n WHERE day > 10500 AND value = 50) SELECT seq, cf, key, type, CASE WHEN value > 45 THEN 45 ELSE value END AS value FROM n, s WHERE (stop IS NULL OR seq < stop) AND type <> 'merge'")
def _(t):
    """A log replayed through a filter that ignores merges, replaces large values, and stops at a record."""
    from lodestone.operators.order import numbered

    log = numbered(_log(t), [*SEQ, "cf", "key"], name="seq")
    act = F.when((F.col("day") > 10500) & (F.col("value") == 50), "stop").when(F.col("type") == "merge", "ignore").when(F.col("value") > 45, "replace").otherwise("keep")
    return kv.filtered_log(log, act, {"value": F.lit(45).cast("long")}).select("seq", "cf", "key", "type", "value")


@query("cmp_styles", "SELECT file, ord, size, running FROM (SELECT o_custkey AS file, min(o_orderkey) AS ord, CAST(sum(CAST(o_totalprice AS BIGINT)) AS BIGINT) AS size, CAST(sum(sum(CAST(o_totalprice AS BIGINT))) OVER (ORDER BY min(o_orderkey) DESC, o_custkey) AS BIGINT) AS running FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders) GROUP BY o_custkey) WHERE running <= 50000000")
def _(t):
    files = t("orders").groupBy(F.col("o_custkey").alias("file")).agg(F.min("o_orderkey").alias("ord"), F.sum(F.floor("o_totalprice")).alias("size"))
    return kv.fifo_retention(files, 50_000_000)


@query("cli_dump", "SELECT split_part(p_brand, '#', 1) AS prefix, count(*) AS n, CAST(sum(length(p_brand) + length(p_name)) AS BIGINT) AS bytes FROM part GROUP BY 1")
def _(t):
    return t("part").groupBy(F.split_part("p_brand", F.lit("#"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.length("p_brand") + F.length("p_name")).cast("long")).alias("bytes"))


@query("rel_emulated_table", f"WITH {RES}, p AS (SELECT cf, key, value FROM rs), s AS (SELECT value, cf, key FROM rs WHERE value IS NOT NULL) SELECT count(*) FILTER (p.key IS NULL OR s.key IS NULL) AS unmatched, count(*) AS matched FROM p FULL JOIN s ON p.cf = s.cf AND p.key = s.key AND p.value = s.value")
def _(t):
    p = kv.resolve(_log(t), SEQ)
    s = p.select(F.col("value").alias("v2"), F.col("cf").alias("c2"), F.col("key").alias("k2"))
    j = p.join(s, (F.col("cf") == F.col("c2")) & (F.col("key") == F.col("k2")) & (F.col("value") == F.col("v2")), "full_outer")
    return j.agg(F.count_if(F.col("key").isNull() | F.col("k2").isNull()).alias("unmatched"), F.count(F.lit(1)).alias("matched"))


@query("wc_default", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS default_value FROM events")
def _(t):
    entity = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit(""), F.col("event_type"))).otherwise(F.create_map(F.lit("t"), F.col("event_type")))
    return t("events").select("event_id", kv.default_column(entity).alias("default_value"))


@query("wc_find", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t("events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).alias("k"))


@query("set_options_diff", "SELECT coalesce(a.name, b.name) AS name, left_value, right_value FROM (SELECT p_name AS name, CAST(min(p_size) AS VARCHAR) AS left_value FROM part WHERE p_partkey <= 1500 GROUP BY 1) a FULL JOIN (SELECT p_name AS name, CAST(max(p_size) AS VARCHAR) AS right_value FROM part WHERE p_partkey > 200 GROUP BY 1) b ON a.name = b.name WHERE left_value IS DISTINCT FROM right_value")
def _(t):
    p = t("part")
    a = p.filter("p_partkey <= 1500").groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").cast("string").alias("value"))
    b = p.filter("p_partkey > 200").groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").cast("string").alias("value"))
    return kv.options_diff(a, b)


@query("ins_table_props", "SELECT cf, key // 500 AS file, count(*) AS entries, count(*) FILTER (type = 'delete') AS deletions, min(key) AS lo, max(key) AS hi FROM v_kv GROUP BY ALL")
def _(t):
    return _log(t).groupBy("cf", F.floor(F.col("key") / 500).alias("file")).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("type") == "delete").alias("deletions"), F.min("key").alias("lo"), F.max("key").alias("hi"))


@query("ins_stats_history", "SELECT entity, stat, pos, v FROM v_series WHERE pos BETWEEN 2 AND 5")
def _(t):
    return t("v_series").filter("pos between 2 and 5")


@query("idx_bucketing", "SELECT cf, key, day, a, b, c, value FROM v_kv WHERE key = 7")
def _(t):
    """One key's versions, read from the one bucket of the written log that holds it."""
    from lodestone.sinks import buckets
    from lodestone.sources.scratch import path

    p = path(t.spark, "buckets")
    buckets(_log(t), p, "key", 16)
    return buckets.read(t.spark, p, "key", 16, 7).select("cf", "key", *SEQ, "value")
