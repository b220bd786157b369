"""Queries on functions, sets, graphs, rules, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone import sinks, sources, streaming
from lodestone.operators import graph, rules
from lodestone.plans.registry import query
from lodestone.sources.scratch import path


@query("prj_alias_coalesce", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END), ''), c_name) AS value FROM customer")
def _(t):
    c = t("customer").withColumn("a1", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")))
    return c.select("c_custkey", fn.first_alias(c.columns, ["missing", "a1", "c_name"]).alias("value"))


@query("prj_ensure_cols", "SELECT s_acctbal, CAST(NULL AS DOUBLE) AS r_5, CAST(s_suppkey AS DOUBLE) AS s_suppkey FROM supplier")
def _(t):
    return sources.ensure_columns(t("supplier").withColumn("s_suppkey", F.col("s_suppkey").cast("double")), ["s_acctbal", "r_5", "s_suppkey"])


DRIVES = ", ".join(f"l_quantity + {i} AS {c}" for i, c in enumerate(fn.SMART))


@query("prj_drop_by_model", "WITH d AS (SELECT l_orderkey, l_linenumber, l_returnflag AS model, " + DRIVES + " FROM lineitem) SELECT l_orderkey, l_linenumber, model, " + ", ".join(f"CASE WHEN model NOT IN ({', '.join(repr(m) for m, cs in (('A', fn.DROPPED['MA1']), ('N', fn.DROPPED['MB1'])) if c in cs) or repr('')}) THEN {c} END AS {c}" for c in fn.SMART) + " FROM d")
def _(t):
    """Each model keeps the attributes it reports; those that it drops are null, or gone where all rows are of one model."""
    d = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("model"), *[(F.col("l_quantity") + i).alias(c) for i, c in enumerate(fn.SMART)])
    return fn.drop_by_model(d, "model", {"A": fn.DROPPED["MA1"], "N": fn.DROPPED["MB1"]})


@query("prj_map_features", "SELECT s_suppkey, " + ", ".join({"r_241": "s_acctbal", "r_187": "coalesce(s_nationkey, 0)::DOUBLE"}.get(c, "0.0::DOUBLE") + f" AS {c}" for c in fn.MAPPED) + " FROM supplier")
def _(t):
    s = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("write_count"), F.col("s_nationkey").cast("string").alias("uncorrectable_error"), F.lit("x").alias("erase_error"))
    return fn.map_features(s).select("s_suppkey", *fn.MAPPED)


@query("prj_prefix_cols", "SELECT n_nationkey AS nation_n_nationkey, n_name AS nation_n_name FROM nation")
def _(t):
    return t("nation").select(*[F.col(c).alias(f"nation_{c}") for c in ("n_nationkey", "n_name")])


@query("flt_model_in", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')")
def _(t):
    return t("part").filter(F.col("p_brand").isin("Brand#11", "Brand#22", "Brand#33")).select("p_partkey")


@query("flt_safe_id", r"SELECT page_id, substr(regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g'), 1, 72) AS id FROM pages")
def _(t):
    return t("pages").select("page_id", fn.safe_id(F.col("url")).alias("id"))


@query("fn_parse_series", "SELECT o_custkey, len(list(o_orderkey)) AS n, CAST(sum(o_orderkey) AS DOUBLE) AS total FROM orders GROUP BY 1")
def _(t):
    o = t("orders").groupBy("o_custkey").agg(F.array_join(F.collect_list("o_orderkey"), ";").alias("s"))
    a = fn.parse_series(F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("["), F.regexp_replace("s", ";", ","), F.lit("]"))).otherwise(F.col("s")))
    return o.select("o_custkey", F.size(a).cast("long").alias("n"), F.aggregate(a, F.lit(0.0), lambda x, y: x + y).alias("total"))


@query("fn_norm_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def _(t):
    f = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    return t("orders").select("o_orderkey", fn.norm_date(f).alias("d"))


@query("fn_file_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def _(t):
    return t("orders").select("o_orderkey", fn.file_date(F.concat(F.lit("/data/2017/log_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".csv"))).alias("d"))


@query("fn_slug", "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 128) AS slug FROM part")
def _(t):
    return t("part").select("p_partkey", fn.slug(F.col("p_type")).alias("slug"))


@query("fn_hex", "SELECT c_custkey, hex(c_name) AS h FROM customer")
def _(t):
    return t("customer").select("c_custkey", F.hex(F.col("c_name").cast("binary")).alias("h"))


@query("fn_xor", "SELECT p_partkey, upper(hex(p_name)) AS h FROM part")
def _(t):
    mask = F.unhex(F.lit("FFFF"))
    return t("part").select("p_partkey", F.hex(fn.xor_bytes(fn.xor_bytes(F.col("p_name").cast("binary"), mask), mask)).alias("h"))


@query("fn_app_tag", "SELECT p_partkey, p_brand AS rw, CAST(p_size AS VARCHAR) AS iodepth FROM part")
def _(t):
    job = F.concat(F.lit("[j]\nrw="), F.col("p_brand"), F.lit("\n  iodepth = "), F.col("p_size").cast("string"), F.lit("\n"))
    return t("part").select("p_partkey", fn.fio_value(job, "rw").alias("rw"), fn.fio_value(job, "iodepth").alias("iodepth"))


@query("fn_policy_string", "SELECT p_partkey, 'gc=' || p_brand || ';wl=' || p_type AS policy, p_brand AS gc FROM part")
def _(t):
    p = fn.policy_string(F.col("p_brand"), F.col("p_type"))
    return t("part").select("p_partkey", p.alias("policy"), F.element_at(fn.policies(p), "gc").alias("gc"))


@query("fn_extract_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    text = F.concat(F.lit("answer: "), F.col("props"), F.lit(" done"))
    return t("events").select("event_id", F.get_json_object(fn.extract_json(text), "$.k").alias("k"))


@query("fn_observations", "SELECT event_id, concat_ws(',', CASE WHEN value / 100 < 0.85 THEN 'low_hit' END, CASE WHEN value / 50 > 0.5 THEN 'cache_pressure' END, CASE WHEN value / 80 < 0.4 THEN 'low_inline' END, CASE WHEN user_id > 50 THEN 'iterators' END, CASE WHEN event_id % 2 > 0 THEN 'churn_up' END, CASE WHEN event_id % 3 > 0 THEN 'tail_up' END) AS obs FROM events")
def _(t):
    c = {"hit": F.col("value") / 100, "pressure": F.col("value") / 50, "inline": F.col("value") / 80, "iter": F.col("user_id") - 50, "churn_slope": F.col("event_id") % 2, "tail_slope": F.col("event_id") % 3}
    return t("events").select("event_id", F.array_join(fn.observations(c), ",").alias("obs"))


@query("fn_query_terms", "SELECT doc_id, concat_ws(',', CASE WHEN quality IS NOT NULL THEN 'cache,hit' END, CASE WHEN toxic > 0 THEN 'latency' END) AS terms FROM labels")
def _(t):
    c = {"q": F.col("quality"), "x": F.when(F.col("toxic") > 0, 1)}
    return t("labels").select("doc_id", F.array_join(fn.query_terms(c, {"q": ["cache", "hit"], "x": ["latency"]}), ",").alias("terms"))


@query("fn_value_dist", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.try_element_at(fn.value_distribution(F.col("props")), F.lit("k")).alias("k"))


EVIDENCE = {0: "It degrades the tail", 1: "Latency is reduced", 2: "Lower hit rate, higher cost", 3: "Throughput improves while wear gets worse", 4: "No change"}


@query("fn_fix_verb", """WITH e AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'improves' ELSE 'degrades' END AS v, CASE p_partkey % 5 """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EVIDENCE.items()) + """ END AS ev FROM part)
  SELECT p_partkey, CASE WHEN v = 'degrades' AND regexp_matches(lower(ev), 'improve|decrease|reduced|lower') THEN 'improves' WHEN v = 'improves' AND regexp_matches(lower(ev), 'increase|worse|degrade|higher') THEN 'degrades' ELSE v END AS verb FROM e""")
def _(t):
    p = t("part").withColumn("v", F.when(F.col("p_size") % 2 == 0, "improves").otherwise("degrades")).withColumn("ev", F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv])[(F.col("p_partkey") % 5).cast("int")])
    return p.select("p_partkey", fn.fix_verb(F.col("v"), F.col("ev")).alias("verb"))


TERMS = [(0, "the"), (1, "tion"), (2, "that")]


@query("fn_kg_retrieve", "WITH t AS (SELECT * FROM (VALUES (0, 'the'), (1, 'tion'), (2, 'that')) v(ord, term)), h AS (SELECT ord, term, item_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY ord, term) AS f FROM benchmark JOIN t ON instr(lower(text), term) > 0 WHERE length(text) >= 20) SELECT CAST(ord AS BIGINT) AS ord, term, id FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY id) AS r FROM h WHERE f = 1) WHERE r <= 5")
def _(t):
    return graph.retrieve(t("benchmark").select(F.col("item_id").alias("id"), "text"), t.spark.createDataFrame(TERMS, "ord long, term string"))


@query("fn_flatten_tax", "SELECT r_name AS label, r_name AS path, 1 AS depth FROM region UNION ALL SELECT n_name, r_name || '/' || n_name, 2 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, r_name || '/' || n_name || '/' || s_name, 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    """The paths of a tree given as child and parent: regions, their nations, their suppliers."""
    r = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    s = t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), "s_name")
    return graph.paths(r.union(n).union(s))


@query("set_union_csv", "SELECT n_name AS name, NULL::DOUBLE AS acct FROM nation UNION ALL SELECT s_name, s_acctbal FROM supplier")
def _(t):
    return t("nation").select(F.col("n_name").alias("name")).unionByName(t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acct")), allowMissingColumns=True)


def _triples(t, where="true"):
    s = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    return t("nation").filter(where).select(s.alias("s"), F.lit("in").alias("p"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("o"))


@query("set_graph_union", "SELECT DISTINCT 'n' || n_nationkey AS s, 'in' AS p, 'r' || n_regionkey AS o FROM nation")
def _(t):
    return graph.graph_union(_triples(t, "n_nationkey % 3 < 2"), _triples(t, "n_nationkey % 3 > 0"))


@query("set_dedup_entities", "SELECT p_name, p_type, min(p_partkey) AS p_partkey FROM part GROUP BY ALL")
def _(t):
    return graph.keep_first(t("part").select("p_name", "p_type", "p_partkey"), ["p_name", "p_type"], ["p_partkey"])


@query("set_dedup_concepts", "SELECT p_brand, p_type, min(p_partkey) AS p_partkey FROM part WHERE p_brand <> '' AND p_type <> '' GROUP BY ALL")
def _(t):
    return graph.keep_first(t("part").filter("p_brand <> '' and p_type <> ''").select("p_brand", "p_type", "p_partkey"), ["p_brand", "p_type"], ["p_partkey"])


@query("set_renumber", "WITH e AS (SELECT n_regionkey AS paper, n_name AS k, 'E' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS eid FROM nation) SELECT a.n_regionkey AS paper, x.eid AS s_id, y.eid AS o_id FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_nationkey = a.n_nationkey + 5 LEFT JOIN e x ON x.paper = a.n_regionkey AND x.k = a.n_name LEFT JOIN e y ON y.paper = a.n_regionkey AND y.k = b.n_name")
def _(t):
    n = t("nation").select(F.col("n_regionkey").alias("paper"), F.col("n_name").alias("k"), "n_nationkey")
    b = n.select("paper", F.col("k").alias("o"), (F.col("n_nationkey") - 5).alias("n_nationkey"))
    triples = n.select("paper", F.col("k").alias("s"), "n_nationkey").join(b, ["paper", "n_nationkey"])
    return graph.renumber(n.select("paper", "k"), triples, "k", "paper")[1].select("paper", "s_id", "o_id")


@query("jn_triple_entity", "SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS o FROM nation WHERE n_nationkey < 20 AND (n_regionkey < 3 OR n_nationkey % 2 = 0)")
def _(t):
    tr = _triples(t).withColumn("o_is_literal", F.substring("s", 2, 9).cast("int") % 2 == 0)
    ent = _triples(t, "n_nationkey < 20").select(F.col("s").alias("entity")).union(t("region").filter("r_regionkey < 3").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))))
    return graph.valid_triples(tr, ent).select("s", "o")


@query("jn_taxonomy", "SELECT n_name AS label, coalesce(CASE WHEN n_nationkey < 5 THEN 'path/' || n_nationkey END, CASE WHEN n_nationkey < 12 THEN 'label/' || n_nationkey END) AS uri FROM nation")
def _(t):
    n = t("nation")
    uri = lambda kind, m: n.filter(F.col("n_nationkey") < m).select(F.col("n_name").alias("label"), F.concat(F.lit(kind), F.col("n_nationkey").cast("string")).alias("uri"))
    return graph.taxonomy_lookup(n.select(F.col("n_name").alias("label")), uri("path/", 5), uri("label/", 12))


@query("set_ref_union", "SELECT o_custkey, string_agg(DISTINCT x, ',' ORDER BY x) AS refs FROM (SELECT o_custkey, o_orderstatus AS x FROM orders UNION ALL SELECT o_custkey, substr(o_orderpriority, 1, 1) FROM orders) GROUP BY 1")
def _(t):
    g = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set(F.substring("o_orderpriority", 1, 1)).alias("b"))
    return g.select("o_custkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("refs"))


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select("o_custkey"))


@query("rul_log_regex", "SELECT event_id FROM events WHERE regexp_matches(event_type || ' ' || props, 'error.*[13579]}')")
def _(t):
    lines = t("events").select("event_id", F.concat_ws(" ", "event_type", "props").alias("line"))
    return rules.log_condition(lines, r"error.*[13579]\}").select("event_id")


@query("rul_option_expr", "SELECT p_partkey FROM part WHERE p_size > 20 AND p_retailprice <= p_size * 60")
def _(t):
    return t("part").filter(rules.expression("p_size > 20 and p_retailprice <= p_size*60")).select("p_partkey")


WIDE = "SELECT entity FROM v_series GROUP BY entity HAVING avg(v) FILTER (stat = '1') > 150000 AND avg(v) FILTER (stat = '2') > 140000"


@query("rul_ts_expr", WIDE)
def _(t):
    s = t("v_series").withColumn("stat", F.concat(F.lit("s"), "stat"))
    return rules.series_condition(s, "s1 > 150000 and s2 > 140000", "entity", "avg")


@query("rul_combine", f"SELECT entity FROM ({WIDE}) WHERE entity IN (SELECT entity FROM v_series GROUP BY entity HAVING max(v) FILTER (stat = '3') > 100000)")
def _(t):
    s = t("v_series").withColumn("stat", F.concat(F.lit("s"), "stat"))
    return rules.combine(rules.series_condition(s, "s1 > 150000 and s2 > 140000", "entity", "avg"), rules.series_condition(s, "s3 > 100000", "entity", "max"), by="entity")


@query("rul_burst", "SELECT entity, count(*) AS bursts FROM (SELECT entity, pos, 100 * ((v - lag(v) OVER w) * 60.0 / (pos - lag(pos) OVER w)) / nullif(lag(v) OVER w, 0) AS rate FROM v_series WINDOW w AS (PARTITION BY entity ORDER BY pos)) WHERE round(rate, 6) >= 100 GROUP BY entity")
def _(t):
    from lodestone.operators import series

    return series.rate_change(t("v_series"), ["entity"], 1, 60.0, 100.0).groupBy("entity").agg(F.count(F.lit(1)).alias("bursts"))


@query("jn_rule_overlap", "SELECT DISTINCT a.entity, a.pos AS t1, b.pos AS t2 FROM v_series a JOIN v_series b ON a.entity = b.entity AND abs(a.pos - b.pos) <= 2 WHERE a.v > 200000 AND b.v < 50000")
def _(t):
    s = t("v_series")
    return rules.overlap(s.filter("v > 200000"), s.filter("v < 50000"), "entity", 2)


@query("rul_apply", "SELECT p_name AS name, CASE WHEN p_name = (SELECT min(p_name) FROM part) THEN p_size * 1.5 ELSE p_size END::DOUBLE AS value FROM part")
def _(t):
    p = t("part").select(F.col("p_name").alias("name"), F.col("p_size").cast("double").alias("value"))
    return rules.apply_suggestion(p, p.agg(F.min("name").alias("name")), "increase", 0.5)


# fixed values: shipped conditions by name and expression, here over columns of parts
RULES = [("large", "p_size > 40"), ("dear", "p_retailprice >= 1400 and p_size > 10"), ("small", "p_size*2 <= 20")]


@query("rul_definitions", " UNION ALL ".join(f"SELECT '{n}' AS rule, '{x}' AS condition, count(*) AS matches FROM part WHERE {x}" for n, x in RULES))
def _(t):
    """Each shipped rule with the number of parts for which it holds, in one reading."""
    return rules.matches(t("part"), RULES)


def _growing(t):
    """The events as a folder that a stream reads, two files at a time."""
    p = path(t.spark, "feed")
    t("events").repartition(4).write.parquet(p)
    return t.spark.readStream.schema(t("events").schema).option("maxFilesPerTrigger", 2).parquet(p)


def _streamed(t, stream):
    return streaming.run_complete(stream, path(t.spark, "windows"), path(t.spark, "windows-cp"))


@query("stm_tumbling", "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def _(t):
    return _streamed(t, streaming.tumbling(_growing(t)))


@query("stm_sliding", "SELECT CAST(s AS BIGINT) AS start, count(*) AS n FROM (SELECT unnest([floor(epoch(ts) / 3600) * 3600, floor(epoch(ts) / 3600) * 3600 - 3600]) AS s FROM events) GROUP BY s")
def _(t):
    return _streamed(t, streaming.sliding(_growing(t)))


@query("stm_session", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 86400 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def _(t):
    return _streamed(t, streaming.sessions(_growing(t), "1 day"))


@query("src_fio_gen", "SELECT DISTINCT lower(l_returnflag) AS rw, bs, CAST(d AS BIGINT) AS iodepth FROM lineitem, (SELECT unnest(['4k', '64k', '1m']) AS bs), (SELECT unnest([1, 32]) AS d)")
def _(t):
    """Jobs for every kind of request that the table holds."""
    return sources.fio_grid(t("lineitem").select(F.lower("l_returnflag").alias("rw")).distinct(), ["4k", "64k", "1m"], [1, 32])


@query("src_synth", """WITH r AS (SELECT o_orderkey AS time, ('0x' || substr(md5('1:' || o_orderkey), 1, 8))::BIGINT AS u, ('0x' || substr(md5('2:' || o_orderkey), 1, 8))::BIGINT AS v, ('0x' || substr(md5('3:' || o_orderkey), 1, 8))::BIGINT AS w FROM orders), n AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.2) AS BIGINT) AS hot FROM part)
  SELECT time, CASE WHEN v * 10 < 8 * 4294967296 THEN u % greatest(hot, 1) ELSE hot + u % greatest(n - hot, 1) END AS address, CAST(w * 2 < 4294967296 AS INTEGER) AS type FROM r, n""")
def _(t):
    """A request for each order, eight in ten to the hottest fifth of the parts."""
    return sources.synthetic(t("orders").select(F.col("o_orderkey").alias("time")), t("part").count())


@query("src_parquet_dataset", "SELECT o_orderkey, o_totalprice, NULL::DOUBLE AS missing FROM orders")
def _(t):
    return sources.parquet_columns(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice", "missing"])


@query("src_papers", "SELECT 'paper_' || item_id AS paper, i AS chunk, substr(text || chr(10), i * 50 + 1, 50) AS text FROM benchmark, range(0, 200) t(i) WHERE i * 50 < length(text) + 1")
def _(t):
    """Texts written a file each, read back in chunks with an id from the file's name."""
    p = path(t.spark, "papers")
    t("benchmark").select(F.concat(F.lit("paper "), F.col("item_id").cast("string")).alias("name"), "text").repartition("name").write.partitionBy("name").text(p)
    sinks.named(t.spark, p, "name", ".txt")
    return sources.papers(t.spark, p, 50).select("paper", F.col("chunk").cast("long").alias("chunk"), "text")


@query("ins_log_stats", "SELECT event_id AS ts, 'op.' || k AS stat, v FROM (SELECT event_id, unnest(['p50', 'p99', 'count']) AS k, unnest([CAST(user_id AS DOUBLE), CAST(user_id * 2 AS DOUBLE), CAST(event_id AS DOUBLE)]) AS v FROM events)")
def _(t):
    s = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("op P50 : "), s("user_id"), F.lit(" P99 : "), (F.col("user_id") * 2).cast("string"), F.lit(" COUNT : "), s("event_id"))
    return sources.log_stats(t("events").select(F.col("event_id").alias("ts"), line.alias("line")))


@query("plt_unpivot", "SELECT s_suppkey, 'acct' AS stat, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier")
def _(t):
    w = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("acct"), F.col("s_nationkey").cast("double").alias("nation"))
    return sources.unpivot(w, ["s_suppkey"], "stat", "v")


@query("src_sst", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    """Sorted files read back row by row: all rows are there, each file in order, and files apart."""
    from lodestone.operators.order import pieces

    o = t("orders").select("o_orderkey", "o_totalprice")
    return sinks.verified_rows(o, path(t.spark, "sorted"), "o_orderkey", pieces(o))
