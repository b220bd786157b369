"""Small cases and plain-Python oracles for what SQL cannot check."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone import sinks, sources, streaming
from lodestone.operators import blockcache as bc
from lodestone.operators import drive, graph, kv, rules, scoring, series, trace


def test_empty_windows_are_zero(spark):
    t = spark.createDataFrame([(1, 0, "a", 1, 5, "get"), (2, 80, "a", 1, 5, "set")], "line_no long, ts long, key string, key_size long, value_size long, op string")
    got = {r.w: r for r in trace.window_stats(t).collect()}
    assert len(got) == 8 and got[3].requests == 0 and got[3].throughput == 0 and got[7].update_intensity == 1.0


def test_series_small_cases(spark):
    s = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 5, 5, 9])] + [("b", i, v) for i, v in enumerate([1.0, 1.0, 1.0, 1.0, 50.0])] + [("c", 0, 1.0), ("c", 1, 2.0)], "k string, pos long, v double")
    assert {r.k: r.changepoint for r in series.changepoint(s, ["k"]).collect()}["a"] == 4
    assert {r.k: r.outliers for r in series.outliers(s, ["k"]).collect()}["b"] == 0
    assert {r.k: r.slope for r in series.slope(s, ["k"]).collect()}["c"] is None


def test_merge_over_delete_and_snapshot(spark):
    log = spark.createDataFrame([("d", "k", 1, "put", 5), ("d", "k", 2, "merge", 2), ("d", "k", 3, "delete", 0), ("d", "k", 4, "merge", 3), ("d", "j", 1, "put", 1), ("d", "j", 3, "put", 2)], "cf string, key string, seq long, type string, value long")
    got = {r.key: r.value for r in kv.merged(log, ["seq"], "add").collect()}
    assert got == {"k": 3, "j": 2}
    assert {r.key: r.value for r in kv.resolve(kv.visible(log, "seq", 2), ["seq"]).collect()} == {"k": 2, "j": 1}


def test_range_delete_end_is_exclusive(spark):
    v = spark.createDataFrame([("d", 5, 1), ("d", 3, 3), ("d", 2, 1)], "cf string, key long, seq long")
    d = spark.createDataFrame([("d", 1, 5, 2)], "cf string, lo long, hi long, seq long")
    for few in (10, 0):
        assert {r.key for r in kv.range_deleted(v, d, few=few).collect()} == {5, 3}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["put", "delete", "merge", "merge"]), st.integers(0, 50)), min_size=1, max_size=40), st.lists(st.integers(0, 40), max_size=5), st.integers(0, 99))
def test_merge_states_fold_the_same_in_any_cut(spark, ops, stripes, seed):
    rows = [("d", k, i, kind, v) for i, (k, kind, v) in enumerate(ops)]
    random.Random(seed).shuffle(rows)
    log = spark.createDataFrame(rows, "cf string, key long, seq long, type string, value long").repartition(3)
    for op in ("add", "max", "xor", "put", "append"):
        plain = {r.key: r.value for r in kv.merged(log, ["seq"], op).collect()}
        assert {r.key: r.value for r in kv.merged(log, ["seq"], op, stripes=stripes).collect()} == plain
        assert {r.key: r.value for r in kv.merged(log, ["seq"], op, with_base=False, stripes=stripes).collect()} == {r.key: r.value for r in kv.merged(log, ["seq"], op, with_base=False).collect()}


def test_merges_read_the_log_once(spark):
    log = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr("l_linestatus cf", "l_partkey key", "l_orderkey seq", "'merge' type", "l_suppkey value")
    for df, exchanges in ((kv.merged(log, ["seq"], "add"), 1), (kv.merged(log, ["seq"], "add", stripes=[100]), 2), (kv.newest(log, ["seq"]), 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == exchanges


def test_merge_registry_is_a_value(spark):
    more = kv.MERGES.register("min", lambda seq: F.min("value"))
    assert "min" in more.known and "min" not in kv.MERGES.known


def test_ttl_edge(spark):
    r = spark.createDataFrame([(100,)], "write_time long")
    assert kv.alive(r, 10, 110).count() == 1 and kv.alive(r, 10, 111).count() == 0 and kv.alive(r, 0, 999).count() == 1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["put", "delete", "merge"]), st.integers(-5, 5)), min_size=1, max_size=30))
def test_log_equals_replay(spark, ops):
    state: dict[int, int] = {}
    for k, kind, v in ops:
        if kind == "put":
            state[k] = v
        elif kind == "delete":
            state.pop(k, None)
        else:
            state[k] = state.get(k, 0) + v
    log = spark.createDataFrame([("d", k, i, kind, v) for i, (k, kind, v) in enumerate(ops)], "cf string, key long, seq long, type string, value long")
    assert {r.key: r.value for r in kv.merged(log, ["seq"], "add").collect()} == state


def test_named_aggregation_switches(spark):
    log = spark.createDataFrame([("d", 1, 1, "sum", 2), ("d", 1, 2, "sum", 3), ("d", 1, 3, "mul", 4)], "cf string, key long, seq long, func string, value long")
    assert kv.agg_named(log, ["seq"]).first().value == 20.0


ACCESS = "block long, size long, caller string, level long, btype string, ts long, o1 long, o2 long, o3 long, key_id long, is_hit long"


def _trace(n, blocks, seed, sizes=lambda rnd: rnd.randint(1, 9)):
    rnd = random.Random(seed)
    return [(int(rnd.paretovariate(0.7)) % blocks, sizes(rnd), "c", rnd.randint(1, 7), rnd.choice("FO"), i // 3, i % 3, 0, 0, rnd.randint(0, 4), 1) for i in range(n)]


def _plain(policy, rows, capacity):
    """One cache, step by step: hits of least recent, most recent, least frequent or farthest next use."""
    cache, count, hits = {}, {}, 0
    for i, r in enumerate(rows):
        b, s = r[0], r[1]
        count[b] = count.get(b, 0) + 1
        if b in cache:
            hits += 1
            cache[b] = (cache[b][0], i)
            continue
        if s > capacity:
            continue
        while sum(x for x, _ in cache.values()) + s > capacity:
            ahead = lambda k, i=i: next((j for j in range(i + 1, len(rows)) if rows[j][0] == k), len(rows) + k)
            cache.pop(max(cache, key=ahead) if policy == "opt" else (min if policy == "lru" else max)(cache, key=lambda k: cache[k][1]))
        cache[b] = s, i
    return hits


def test_caches_are_one_cache(spark):
    rows = _trace(1500, 60, 3)
    acc = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), ACCESS)
    names = ("lru", "mru", "fifo", "lfu", "gdsize", "arc", "opt", "ghost", "hyperbolic", "costclass", "ts", "linucb", "hybrid", "priority")
    got = {r.policy: r for r in bc.simulate(acc, [(n, 40) for n in names]).collect()}
    assert len(got) == len(names) and all(r.accesses == 1500 and 0 <= r.hits <= 1500 for r in got.values())
    for n in ("lru", "mru"):
        assert got[n].hits == _plain(n, rows, 40)
    assert got["lru"].hits == next(r.hits for r in bc.simulate(acc, [("lru", 40), ("lru", 90)]).collect() if r.capacity == 40)


def test_farthest_next_use_is_best(spark):
    rows = _trace(900, 40, 5, lambda rnd: 1)
    got = {r.policy: r.hits for r in bc.simulate(spark.createDataFrame(rows, ACCESS), [(n, 10) for n in ("lru", "mru", "fifo", "lfu", "gdsize", "arc", "opt", "ghost", "hyperbolic", "ts", "linucb", "priority")]).collect()}
    assert got["opt"] == _plain("opt", rows, 10) and all(got["opt"] >= h for h in got.values())


def test_lru_is_what_reuse_distances_say(spark):
    rows = [(r[0], 1 + r[0] % 5, *r[2:]) for r in _trace(2000, 70, 9)]  # a block keeps its size
    acc = spark.createDataFrame(rows, ACCESS)
    far = [(r.block, r.distance) for r in bc.reuse_distance(acc, 300).collect()]
    for r in bc.simulate(acc, [("lru", c) for c in (20, 60, 120)]).collect():
        assert r.hits == sum(d + 1 + b % 5 <= r.capacity for b, d in far)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 1000), st.integers(5, 80), st.sampled_from([7, 40, 1000]))
def test_reuse_distance(spark, seed, blocks, chunk):
    rows = _trace(260, blocks, seed)
    want, last = [], {}
    for i, r in enumerate(rows):
        if r[0] in last:
            want.append((r[0], sum({x[0]: x[1] for x in rows[last[r[0]] + 1 : i]}.values())))
        last[r[0]] = i
    got = bc.reuse_distance(spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), ACCESS), chunk)
    assert sorted((r.block, r.distance) for r in got.collect()) == sorted(want)


def test_sampled_simulation_says_so(spark):
    r = bc.simulate(spark.createDataFrame(_trace(2000, 400, 2), ACCESS), [("lru", 400)], rate=0.5).first()
    assert r.rate == 0.5 and 0 < r.accesses < 2000


def test_histogram_limits_start():
    assert bc.histogram_limits(60)[:10] == [1, 2, 3, 4, 6, 10, 15, 22, 34, 51]


def test_hot_set(spark):
    c = spark.createDataFrame([(i, 1000 if i < 10 else 1) for i in range(1000)], "address long, n long")
    got = bc.hot_set(c, least=100).first()
    assert got.is_hot and got.address_share == 0.01


def test_scores(spark):
    claims = spark.createDataFrame([([["IR:AF_r_5"], ["X"], []],)], "c array<array<string>>")
    assert claims.select(scoring.fip(F.col("c"), F.array(F.lit("AF_r_5"))).alias("f")).first().f == round(1 / 3, 6)
    p = spark.createDataFrame([(1, "the cat sat on mats", "the cat on the mats"), (2, "", "x")], "k long, cand string, ref string")
    got = {r.k: r.rouge_l for r in scoring.rouge_l(p, "k").collect()}
    assert got == {1: 0.8, 2: 0.0}


def test_rules_are_a_whitelist():
    import pytest

    for bad in ("__import__('os')", "a > b > c", "1; drop"):
        with pytest.raises(ValueError):
            rules.expression(bad)


def test_functions(spark):
    df = spark.createDataFrame([("[1, 2.5]", "20240102", b"\x0f", b"\xf0\xaa")], "a string, d string, x binary, y binary")
    r = df.select(fn.parse_series(F.col("a")).alias("s"), fn.norm_date(F.col("d")).cast("string").alias("d"), fn.xor_bytes(F.col("x"), F.col("y")).alias("z")).first()
    assert r.s == [1.0, 2.5] and r.d == "2024-01-02" and bytes(r.z) == b"\xff\xaa"


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("1,k,1,2,c,get,0\nbad\n2,k,x,2,c,get,0\n3,j,1,2,c,set,5\n")
    assert sources.trace_csv(spark, str(p)).count() == 2
    assert sources.trace_csv(spark, str(p), max_rows=2).count() == 1
    x = tmp_path / "r.xml"
    x.write_text("<r><Flow><IOPS>12.5</IOPS></Flow><Flow><IOPS>9</IOPS></Flow></r>")
    assert sources.sim_xml(spark, str(x), sources.FLOW_PATHS).first().iops_number == 12.5
    j = tmp_path / "j.fio"
    j.write_text("[global]\nbs=1k\n[a]\nrw=read\nbs=4k\n[b]\nrw=write\n")
    assert [(r.job_name, r.rw, r.bs) for r in sources.fio_jobs(spark, str(j)).orderBy("job_name").collect()] == [("a", "read", "4k"), ("b", "write", None)]
    t = tmp_path / "g.ttl"
    t.write_text('@prefix e: <http://x/> .\ne:a a e:T ;\n  e:p "v; w." , e:b .\n')
    assert {(r.s, r.p, r.o) for r in sources.turtle(spark, str(t)).collect()} == {("e:a", "rdf:type", "e:T"), ("e:a", "e:p", "v; w."), ("e:a", "e:p", "e:b")}
    df = spark.createDataFrame([(1, 2023, "m"), (2, 2024, "m")], "v int, year int, model string")
    sinks.partitioned(df, str(tmp_path / "o"), ["year", "model"])
    assert spark.read.parquet(str(tmp_path / "o")).filter("year = 2024").count() == 1
    for s in (1, 2, 3):
        sinks.snapshot(df, str(tmp_path / "s"), s)
    assert len(sinks.purge(spark, str(tmp_path / "s"), 1)) == 2


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    one = tmp_path / "in"
    one.mkdir()
    (one / "events.parquet").symlink_to(src)
    schema = spark.read.parquet(src).schema
    streaming.run_once(streaming.tumbling(spark.readStream.schema(schema).parquet(str(one)), "1 day", "0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.start, r.event_type): r.n for r in streaming.tumbling(spark.read.parquet(src), "1 day").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 10


def test_drive_windows(spark):
    d = spark.createDataFrame([("x", f"2024-01-{i:02d}", 1, 1, 0) for i in (1, 3, 4, 5)], "drive string, day string, errors long, wear long, flag long").withColumn("day", F.to_date("day"))
    full = drive.gap_fill(d)
    assert [r.errors for r in full.orderBy("day").collect()] == [1, 0, 1, 1, 1]
    assert drive.consecutive(d, 3).count() == 1


def test_graph_retrieve_and_tax(spark):
    lit = spark.createDataFrame([(1, "A long literal on CACHE misses"), (2, "short")], "id long, text string")
    terms = spark.createDataFrame([(0, "cache")], "ord long, term string")
    assert [r.id for r in graph.retrieve(lit, terms).collect()] == [1]
    assert ("b", "a/b") in graph.flatten_taxonomy({"a": ["b"]})
